"""Rules, partitioning and routing over sparse cells against dense rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from variantlab.operators import mob, models as M, rules as R, sparse as V


def sparse_matrix(n, width, seed, share=0.4):
    rng = np.random.default_rng(seed)
    return np.where(rng.random((n, width)) < share, np.round(rng.normal(size=(n, width)), 1), 0.0), rng


def cells_of(spark, x):
    return spark.createDataFrame([(int(i), int(j), float(x[i, j])) for i, j in zip(*np.nonzero(x), strict=True)], "pair_id long, feature int, value double").repartition(3)


def met(x, rule):
    ops = {"<=": np.less_equal, ">": np.greater, "<": np.less, ">=": np.greater_equal}
    return np.all([ops[op](x[:, f], cut) for f, op, cut in rule], axis=0)


RULES = [((0, ">", 0.2), (1, "<=", 0.5)), ((2, "<=", 0.0),), ((3, "<", 0.0), (0, ">=", 0.0)), ((1, ">", -0.5), (1, "<=", 0.3)), ((4, ">=", 0.0), (5, "<=", 0.0), (0, "<=", 1.0)), ((5, ">", 99.0),), ((5, "<=", 99.0),)]


def test_rules_equal_dense_rows(spark):
    x, _ = sparse_matrix(300, 6, 1)
    cells, rows = cells_of(spark, x), spark.range(300).withColumnRenamed("id", "pair_id")
    got = {(r.pair_id, r.rule) for r in R.exceptions(cells, RULES).collect()}
    want = {(i, k) for k, r in enumerate(RULES) for i in range(300) if met(x, r)[i] != R.met_by_zeros(r)}
    assert got == want
    table = {r.rule: (r.n, r.support) for r in R.supports(cells, rows, RULES).collect()}
    assert table == {k: (met(x, r).sum(), pytest.approx(met(x, r).mean())) for k, r in enumerate(RULES)}


def test_rule_fit_scores_and_table(spark):
    x, rng = sparse_matrix(500, 5, 2, 0.6)
    y = (((x[:, 0] > 0) & (x[:, 1] <= 0)) | (rng.random(500) < 0.1)).astype(float)
    cells = cells_of(spark, x)
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "pair_id long, y double")
    fit = R.rule_fit(cells, rows, 5, 4, 2, 40, 0.003)
    assert fit.weights and all(abs(c) > 0 for c in fit.weights.values())
    margin = fit.intercept + sum(c * x[:, f] for f, c in fit.linear.items()) + sum(c * met(x, fit.rules[k]) for k, c in fit.weights.items())
    got = {r.pair_id: (r.score, r.p) for r in R.rule_scores(fit, cells, rows).collect()}
    assert np.allclose([got[i][0] for i in range(500)], 1 / (1 + np.exp(-margin))) and [got[i][1] for i in range(500)] == (margin > 0).astype(int).tolist()
    assert np.mean([got[i][1] == y[i] for i in range(500)]) > 0.85
    table = R.rule_table(fit, cells, rows).collect()
    text = {fit.text(k): k for k in fit.weights}
    assert len(table) == len(fit.weights) + len(fit.linear)
    for r in table:
        term = met(x, fit.rules[text[r.rule]]) if r.type == "rule" else x[:, int(r.rule[1:])]
        assert r.support == pytest.approx((term != 0).mean()) and r.importance == pytest.approx(abs(r.coef) * term.std())
    assert [r.importance for r in table] == sorted((r.importance for r in table), reverse=True)
    # the optimum over indicators of meeting a rule: the gradient of every term is within the penalty
    terms = {f"f{f}": x[:, f] for f in range(5)} | {fit.text(k): met(x, r).astype(float) for k, r in enumerate(fit.rules)}
    coefs = {f"f{f}": c for f, c in fit.linear.items()} | {fit.text(k): c for k, c in fit.weights.items()}
    error = 1 / (1 + np.exp(-margin)) - y
    for name, term in terms.items():
        if term.std() > 0:
            g = (error * term).mean() / term.std(ddof=1)
            assert abs(g + 0.003 * np.sign(coefs[name])) < 5e-4 if name in coefs else abs(g) < 0.003 + 5e-4


def planted(n=900, seed=4):
    """A slope that changes with sparse feature 1, and within one side with feature 0."""
    x, rng = sparse_matrix(n, 2, seed, 1.0)
    z, _ = sparse_matrix(n, 6, seed + 1, 0.6)
    slope = np.where(z[:, 1] > 0.2, np.where(z[:, 0] > 0, 4.0, 1.0), -2.0)
    return x, z, slope * x[:, 0] + 0.1 * rng.normal(size=n)


def test_partitioning_of_cells_equals_that_of_arrays(spark):
    x, z, y = planted()
    dense = spark.createDataFrame([(k, float(y[k]), 1.0, x[k].tolist(), z[k].tolist()) for k in range(len(y))], "pair_id long, y double, w double, x array<double>, z array<double>")
    cells = cells_of(spark, z).unionByName(spark.createDataFrame([(5, 3, 0.0)], "pair_id long, feature int, value double").where("value <> 0"))
    space = mob.Sparse(cells)
    for grow in (mob.grow, mob.grow_simulated):
        want = grow(dense, 1e-3, depth=2, least=40)
        got = grow(dense.drop("z"), 1e-3, depth=2, least=40, space=space)
        line = lambda nodes: [(n.id, n.depth, n.n, n.feature, n.cut) for n in nodes]
        assert line(got) == line(want) and len(got) >= 5
        assert got[0].feature == 1 and {n.feature for n in got if n.depth == 1} >= {0}
        assert [n.statistic for n in got] == pytest.approx([n.statistic for n in want])
    scores, q = mob.with_scores(dense, [1.0, 0.5], 0.0)
    assert space.screened(scores, q, 6) == mob.Dense().screened(scores, q, 6)
    assert space.testable(scores) == mob.Dense().testable(scores)
    key = lambda df: {(r.feature, r.z): (r.m, pytest.approx(r.s0), pytest.approx(r.s1)) for r in df.collect()}
    assert key(space.by_value(scores, q, [0, 2, 4])) == key(mob.Dense().by_value(scores, q, [0, 2, 4]))


def test_routing_of_cells_to_depth_8(spark):
    z, rng = sparse_matrix(400, 12, 9, 0.5)
    nodes, frontier = [], [0]
    number = 1
    for depth in range(9):
        following = []
        for node in frontier:
            if depth == 8 or (depth > 2 and rng.random() < 0.3):
                nodes.append((node, None, None, None, None))
            else:
                nodes.append((node, int(rng.integers(12)), float(rng.choice([-0.5, -0.1, 0.0, 0.3])), number, number + 1))
                following += [number, number + 1]
                number += 2
        frontier = following
    table = {n[0]: n for n in nodes}

    def leaf(row):
        at = 0
        while table[at][1] is not None:
            at = table[at][3] if row[table[at][1]] <= table[at][2] else table[at][4]
        return at

    tree = spark.createDataFrame(nodes, "node int, feature int, cut double, left_node int, right_node int")
    rows = spark.range(400).select(F.col("id").alias("pair_id"), F.lit("x").alias("feature"))
    got = mob.routed(rows, cells_of(spark, z), tree, 8)
    assert got.columns == ["pair_id", "feature", "leaf"]
    assert {r.pair_id: r.leaf for r in got.collect()} == {i: leaf(z[i]) for i in range(400)}


def test_singular_values_of_a_decaying_spectrum(spark):
    rng = np.random.default_rng(3)
    u, _ = np.linalg.qr(rng.normal(size=(200, 40)))
    v, _ = np.linalg.qr(rng.normal(size=(60, 40)))
    x = u @ np.diag(10.0 * 0.75 ** np.arange(40)) @ v.T
    x[np.abs(x) < 1e-3] = 0
    cells = V.from_arrays(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "pair_id long, v array<double>"), "pair_id", "v")
    rows = M.assembled(cells, spark.range(201).withColumnRenamed("id", "pair_id"), 60).repartition(4)
    table, values, explained = M.right_vectors(rows, 12)
    s, vt = np.linalg.svd(x)[1:]
    assert np.allclose(values, s[:12], rtol=1e-6) and abs(explained - (s[:12] ** 2).sum() / (s**2).sum()) < 1e-6
    got = np.array([r.v for r in table.orderBy("feature").collect()])
    assert np.allclose(np.abs((got * vt[:12].T).sum(axis=0)), 1, atol=1e-5)
    assert M.right_vectors(rows.limit(0), 3)[1] == []
