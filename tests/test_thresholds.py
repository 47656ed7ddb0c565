"""Thresholds, binarisation and small traps against numpy and hand-made rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from variantlab.functions import text as T
from variantlab.operators import arms as A, mob, sparse as V, thresholds as H


def column(spark, columns: dict[int, list[float]]):
    return spark.createDataFrame([(k, f, float(v)) for f, vs in columns.items() for k, v in enumerate(vs)], "pair_id long, feature int, value double").where("value <> 0")


def test_histogram_and_walks_equal_numpy(spark):
    rng = np.random.default_rng(0)
    data = {0: rng.normal(0, 1, 400), 1: np.full(20, 2.5), 2: np.concatenate([rng.exponential(0.2, 300), rng.normal(2, 0.3, 300)]), 3: np.arange(11.0) + 1, 4: np.ones(5)}
    rows = column(spark, {f: list(v) for f, v in data.items()})
    hist = H.histogram(rows, 30)
    got = {}
    for r in hist.collect():
        got.setdefault(r.feature, {})[r.bin] = r.n
    right = {r.feature: r.threshold for r in H.walk_right(hist, 3).collect()}
    outward = {r.feature: r.high for r in H.walk_outward(hist, 3).collect()}
    for f, v in data.items():
        if len(v) < 10:
            assert f not in got
            continue
        n, edges = np.histogram(v, bins=30)
        assert [got[f][k] for k in range(30)] == list(n)
        centres = (edges[:-1] + edges[1:]) / 2
        up = [k for k in range(30 - 3) if min(n[k + 1 : k + 4]) > n[k]]
        near = int(np.argmin(np.abs(centres)))
        assert (f in right) == bool(up) and (not up or abs(right[f] - centres[up[0]]) < 1e-9)
        up = [k for k in up if k >= near]
        assert (f in outward) == bool(up) and (not up or abs(outward[f] - centres[up[0]]) < 1e-9)


def test_binarised_is_inclusive_and_knows_zeros(spark):
    rows = column(spark, {0: [0, 0.5, 1.0, -1.0], 1: [0, 0.2, -0.3, 0]})
    th = spark.createDataFrame([(0, -1.0, 1.0), (1, 0.1, -0.1)], "feature int, low double, high double")
    pairs = spark.range(4).select(F.col("id").alias("pair_id"))
    got = {(r.pair_id, r.feature): r.value for r in H.binarised_with_zeros(rows, th, pairs).collect()}
    assert got == {(2, 0): 1, (3, 0): -1, (0, 1): 1, (1, 1): 1, (2, 1): -1, (3, 1): 1}


def test_population_scale_counts_zeros(spark):
    assert abs(V.scale_table(column(spark, {0: [1, 3, 8]}), 3).first().scale - 2.9439202887759492) < 1e-12
    assert abs(V.scale_table(column(spark, {0: [1, 3, 0, 0]}), 4).first().scale - np.std([1, 3, 0, 0])) < 1e-12


def test_cleaning(spark):
    rows = [("&amp;lt;b&amp;gt;", "<b>"), ("&#39;", "'"), ("&#8217;", ""), ("&eacute;", ""), ("&#x27;", "&#x27;"), ("a b", "a b"), (None, None), ("<p>x</p>  y", "x y")]
    df = spark.createDataFrame(rows, "a string, b string").select(T.clean_text(F.col("a")).alias("c"), "b")
    assert all(r.c == r.b for r in df.collect())


def test_first_of_ties_wins(spark):
    rows = [("t", "x", "l", 4, 1), ("t", "y", "l", 8, 2), ("t", "<b>x</b>", "l", 8, 1), ("u", "z", None, 0, 3), ("u", "z", None, 9, 9), ("v", "q", None, 1, 1)]
    raw = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "row_ord int, clickability_test_id string, headline string, lede string, impressions int, clicks int")
    got = {(r.test_id, r.local_idx): (r.headline, r.best) for r in A.prepare(raw).collect()}
    assert got == {("t", 0): ("x", 1), ("t", 1): ("y", 0), ("t", 2): ("x", 0)}


def test_partitioning_finds_a_planted_change(spark):
    rng = np.random.default_rng(1)
    x, z = rng.normal(size=(600, 2)), rng.normal(size=(600, 3))
    y = np.where(z[:, 1] > 0.3, 2, -2) * x[:, 0] + 0.1 * rng.normal(size=600)
    rows = spark.createDataFrame([(k, float(y[k]), 1.0, x[k].tolist(), z[k].tolist()) for k in range(600)], "pair_id long, y double, w double, x array<double>, z array<double>")
    nodes = mob.grow(rows, 1e-3, depth=1, least=30)
    assert len(nodes) == 3 and nodes[0].feature == 1 and abs(nodes[0].cut - 0.3) < 0.2
    worst = mob.predicted(rows, nodes).agg(F.avg(F.pow(F.col("y") - F.col("p"), F.lit(2))).alias("e")).first().e
    assert worst < 0.5
