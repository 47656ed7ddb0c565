"""Reports on winners, scales and paths against numpy and hand-made rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from variantlab.operators import arms as A, sparse as V


def test_disagreements_of_ties_nulls_and_flags(spark):
    rows = [
        ("a", 0, 0.1, True, "x"), ("a", 1, 0.3, False, "y"),  # disagrees
        ("b", 0, 0.3, True, "x"), ("b", 1, 0.3, False, "y"),  # a tie goes to the first row
        ("c", 0, 0.3, False, "x"), ("c", 1, 0.3, True, None),  # and so does this one
        ("d", 0, 0.5, False, "alone"),
        ("e", 0, 0.1, False, "x"), ("e", 1, 0.2, False, "y"),  # no flag
        ("f", 0, None, True, "z" * 70), ("f", 1, 0.0, None, "y"),
        ("g", 0, None, True, "x"), ("g", 1, None, False, "y"),  # nothing is best
        ("h", 0, 0.9, False, "x"), ("h", 1, 0.2, True, "second"), ("h", 2, 0.4, True, "third"),
    ]
    df = spark.createDataFrame(rows, "test_id string, row_ord int, ctr double, won boolean, headline string").repartition(3)
    got = {r.test_id: tuple(r)[1:] for r in A.winner_disagreements(df, "ctr", "won", "headline").collect()}
    assert got == {"a": (0.3, 0.1, "x"), "c": (0.3, 0.3, "N/A"), "f": (0.0, None, "z" * 60), "h": (0.9, 0.2, "second")}
    assert A.winner_disagreements(df.where("false"), "ctr", "won", "headline").count() == 0


def test_scale_diagnostics_equal_numpy(spark):
    rng = np.random.default_rng(4)
    x = np.where(rng.random((80, 7)) < 0.4, rng.normal(size=(80, 7)), 0.0)
    x[:, 2], x[:, 4], x[:, 5] = 0.0, 3.0, x[:, 5] / 1000  # never active, constant, hardly varied
    cells = spark.createDataFrame([(int(i), int(j), float(x[i, j])) for i, j in zip(*np.nonzero(x), strict=True)], "pair_id long, feature int, value double")
    got = {r.kind: r for r in V.scale_diagnostics(cells, 80, 7).collect()}
    deviation, largest = x.std(axis=0), np.abs(x).max(axis=0)
    scales = {"original": None, "standard": np.where(deviation > 1e-12, deviation, 1.0), "largest": largest}
    for kind, s in scales.items():
        by = np.ones(7) if s is None else np.where(s > 0, s, 1.0)
        v = (x / by)[x != 0]
        r = got[kind]
        assert (r.least, r.most, r.mean, r.std) == pytest.approx((v.min(), v.max(), v.mean(), v.std()))
        if s is None:
            assert (r.scale_least, r.scale_most, r.scale_mean, r.small_scales) == (None,) * 4
        else:
            assert (r.scale_least, r.scale_most, r.scale_mean) == pytest.approx((s.min(), s.max(), s.mean())) and r.small_scales == (s < 0.01).sum()
        assert r.dead == 1
    empty = {r.kind: r for r in V.scale_diagnostics(cells.where("false"), 80, 7).collect()}
    assert len(empty) == 3 and all(r.dead == 7 and r.least is None and r.std is None for r in empty.values())
    assert (empty["standard"].scale_mean, empty["largest"].small_scales) == (1.0, 7)


def test_path_rows_take_absent_values_and_fitted_scales(spark):
    rng = np.random.default_rng(9)
    x = np.where(rng.random((120, 5)) < 0.5, np.round(rng.normal(size=(120, 5)), 1), 0.0)
    x[:, 4] = 0.0
    cells = spark.createDataFrame([(int(i), int(j), float(x[i, j])) for i, j in zip(*np.nonzero(x), strict=True)], "pair_id long, feature int, value double").repartition(3)
    rows = spark.range(120).withColumnRenamed("id", "pair_id").withColumn("values", F.lit("kept out"))
    paths = [((0, "<", 0.0), (1, ">=", 0.0)), ((2, "<=", 0.3), (2, ">", -0.5), (4, ">=", 0.0)), ((3, ">", 99.0),), ()]
    got = sorted(tuple(r) for r in V.path_rows(cells, rows, V.scale_table(cells, 120), paths).collect())
    ops = {"<=": np.less_equal, ">": np.greater, "<": np.less, ">=": np.greater_equal}
    scale = np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0)
    want = []
    for number, path in enumerate(paths):
        met, score = np.ones(120, bool), np.zeros(120)
        for f, op, cut in path:
            met &= ops[op](x[:, f], cut)
            score += x[:, f] / scale[f] * (1 if op[0] == ">" else -1)
        want += [(number, int(i), score[i]) for i in np.flatnonzero(met)]
    assert [r[:2] for r in got] == [r[:2] for r in want] and [r[2] for r in got] == pytest.approx([r[2] for r in want], abs=1e-9)
    assert {r[0] for r in got} == {0, 1, 3}
