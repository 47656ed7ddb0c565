"""Models against optimality conditions, numpy, SQL-like searches and planted truths."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from variantlab.operators import mob, models as M, sparse as V, split as S, thresholds as H
from variantlab.sources import files


def frame(spark, x, y, w=None, **more):
    w = np.ones(len(y)) if w is None else w
    rows = [(k, x[k].tolist(), float(y[k]), float(w[k]), *(v[k].item() for v in more.values())) for k in range(len(y))]
    types = ", ".join(f"{c} {'long' if np.issubdtype(v.dtype, np.integer) else 'double'}" for c, v in more.items())
    df = spark.createDataFrame(rows, "pair_id long, x array<double>, y double, w double" + (", " + types if types else ""))
    return df.withColumn("features", array_to_vector("x"))


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    x, w = rng.normal(size=(400, 4)), rng.uniform(0.5, 2, 400)
    return x, w, rng


def test_logistic_meets_its_optimality_conditions(spark, data):
    x, w, rng = data
    y = (x[:, 0] - 0.5 * x[:, 1] + rng.logistic(size=400) > 0).astype(float)
    model = M.logistic(frame(spark, x, y, w), 0.05, 1e-9)
    b, c = model.coefficients.toArray(), model.intercept
    e = w * (1 / (1 + np.exp(-(x @ b + c))) - y)
    assert np.abs(x.T @ e / w.sum() + 0.05 * b).max() < 1e-5 and abs(e.sum() / w.sum()) < 1e-5


def test_lasso_meets_its_optimality_conditions(spark, data):
    x, w, rng = data
    y = 2 * x[:, 0] + 0.3 * x[:, 1] + 0.1 * rng.normal(size=400)
    model = M.lasso(frame(spark, x, y, w), 0.1)
    b, c = model.coefficients.toArray(), model.intercept
    g = x.T @ (w * (y - x @ b - c)) / w.sum()
    assert b[0] > 1.5 and np.abs(g[b != 0] - 0.1 * np.sign(b[b != 0])).max() < 1e-3 and np.abs(g[b == 0]).max(initial=0) <= 0.1 + 1e-3


def test_trees_and_boosting_find_a_planted_interaction(spark, data):
    x, w, _ = data
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    rows = frame(spark, x, y, w)
    fits = {"tree": M.tree(rows, 4, 5), "boosted": M.boosted(rows, 8, 3), "columns": M.boosted(rows, 8, 3, columns="0.7")}
    for name, model in fits.items():
        hit = M.scored(model, rows).agg(F.avg((F.col("p") == F.col("y")).cast("double"))).first()[0]
        assert hit > (0.9 if name == "tree" else 0.85)
    used = dict(M.importances(fits["boosted"]))
    assert used[0] + used[1] > 0.7 and set(used) <= {0, 1, 2, 3}
    stumps = M.boosted(frame(spark, x, (x[:, 2] > 0.3).astype(float)), 5, 1, rate=0.3)
    assert all(f == 2 for t in stumps.trees for _, f, _ in M.top_splits(t.toDebugString))


def test_clusters_of_one_class_get_that_class(spark, data):
    x, _, _ = data
    cluster = np.arange(400) % 3
    y = np.where(cluster == 0, (x[:, 0] > 0).astype(float), np.where(cluster == 1, 1.0, 0.0))
    rows = frame(spark, x, y, cluster=cluster)
    out = M.by_cluster(rows.where("cluster < 2"), rows, lambda t: M.tree(t, 2, 5), [0, 1, 2])
    assert out.count() == 400
    assert out.groupBy("cluster").agg(F.avg((F.col("p") == F.col("y")).cast("double")).alias("a")).where("a < 0.95").count() == 0
    assert {r.score for r in out.where("cluster = 1").collect()} == {1.0} and {r.p for r in out.where("cluster = 2").collect()} == {0}


def test_singular_vectors_and_clusters_equal_numpy(spark):
    rng = np.random.default_rng(5)
    centre = np.repeat(np.eye(6)[:3] * 8, 40, axis=0)
    x = centre + 0.3 * rng.normal(size=(120, 6))
    x[0] = 0
    rows = frame(spark, x, np.zeros(120)).select("pair_id", "features")
    table, values, explained = M.right_vectors(rows, 3)
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(values, s[:3], rtol=1e-6) and abs(explained - (s[:3] ** 2).sum() / (s**2).sum()) < 1e-6
    got = {r.pair_id: np.array(r.features) for r in M.projected(rows, table, 3).collect()}
    assert len(got) == 120 and np.allclose(np.abs([got[k] for k in range(120)]), np.abs(x @ vt[:3].T), atol=1e-6)
    unit = M.normalised(rows.where("pair_id > 0"))
    model = M.clustered(unit, 3, 3)
    label = {r.pair_id: r.prediction for r in model.transform(unit).collect()}
    groups = [{label[k] for k in range(max(1, 40 * g), 40 * g + 40)} for g in range(3)]
    assert all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 3


def test_segments_of_a_planted_residual(spark, data):
    x, w, rng = data
    residual = np.where(x[:, 0] > 0, 1.0, -1.0) + 0.05 * rng.normal(size=400)
    y = np.where(x[:, 0] > 0, 1.0, -1.0) * x[:, 1]
    rows = frame(spark, x, y, w, residual=residual).withColumn("context", F.col("features"))
    train, test = rows.where("pair_id < 300"), rows.where("pair_id >= 300")
    both, mapping = M.segmented(train, rows, depth=1, leaf=20)
    assert sorted(r.segment for r in mapping.collect()) == [0, 1]
    sides = {(r.segment, r.pair_id) for r in both.select("segment", "pair_id").collect()}
    assert len({s for s, k in sides if x[k, 0] > 0.1}) == 1 and len({s for s, k in sides if x[k, 0] < -0.1}) == 1
    table = {r.segment: r for r in M.segment_trees(both.where("pair_id < 300"), both.where("pair_id >= 300"), least=50).collect()}
    assert set(table) == {0, 1} and all(r.train_r2 > 0.5 and r.test_r2 > 0.3 for r in table.values())
    assert sum(r.n_train for r in table.values()) == 300 and sum(r.n_test for r in table.values()) == 100 == test.count()
    assert M.segment_trees(both, both, least=1000).count() == 0


def planted(n, seed):
    """A slope that changes its sign with z1, and its size with z0 within one side."""
    rng = np.random.default_rng(seed)
    x, z = rng.normal(size=(n, 2)), rng.normal(size=(n, 3))
    slope = np.where(z[:, 1] > 0.3, np.where(z[:, 0] > 0, 4.0, 1.0), -2.0)
    return x, z, slope * x[:, 0] + 0.1 * rng.normal(size=n)


def mob_rows(spark, x, z, y):
    return spark.createDataFrame([(k, float(y[k]), 1.0, x[k].tolist(), z[k].tolist()) for k in range(len(y))], "pair_id long, y double, w double, x array<double>, z array<double>")


def test_partitioning_at_two_levels(spark):
    x, z, y = planted(900, 4)
    rows = mob_rows(spark, x, z, y)
    for nodes in (mob.grow(rows, 1e-3, depth=2, least=40), mob.grow_simulated(rows, 1e-3, depth=2, least=40)):
        assert nodes[0].feature == 1 and abs(nodes[0].cut - 0.3) < 0.2
        right = nodes[0].right
        assert right.feature == 0 and abs(right.cut) < 0.3 and nodes[0].left.feature is None
        assert mob.predicted(rows, nodes).agg(F.avg(F.pow(F.col("y") - F.col("p"), F.lit(2))).alias("e")).first().e < 0.6
        assert dict(mob.paths(nodes, {1: "mood", 0: "size"}))[right.left.id].startswith("mood > ")
    flat = x[:, 0] + np.random.default_rng(9).normal(size=900)
    assert len(mob.grow_simulated(mob_rows(spark, x, z, flat), 1e-3, depth=1, least=40)) == 1
    with pytest.raises(ValueError, match="draws"):
        mob.grow_simulated(rows, 1e-3, depth=1, least=40, draws=50)


def test_older_criterion_finds_a_planted_level(spark):
    rng = np.random.default_rng(6)
    x, z = rng.normal(size=(400, 1)), rng.normal(size=(400, 2))
    y = np.where(z[:, 1] > -0.2, 3.0, 0.0) + 0.2 * rng.normal(size=400)
    nodes = mob.grow_by_reduction(mob_rows(spark, x, z, y), 0.01, depth=1, least=30)
    assert len(nodes) == 3 and nodes[0].feature == 1 and abs(nodes[0].cut + 0.2) < 0.1


def test_draws_of_the_null(spark):
    """The 95th percentile of the supremum for one bridge, trimmed at 10 %, is near the published 8.2 to 8.6."""
    got = mob.supremum_draws(spark, 1, 4000).agg(F.percentile("sup", 0.95)).first()[0]
    assert 7.6 < got < 9.0


def test_refit_is_least_squares(spark, data):
    x, w, rng = data
    y = x[:, 0] - 2 * x[:, 2] + rng.normal(size=400)
    rows = frame(spark, x, y, w)
    got, c = mob.refitted(rows, [0.5, 0.0, -1.0, 0.0])
    a = np.column_stack([np.ones(400), x[:, [0, 2]]])
    want = np.linalg.lstsq(a * np.sqrt(w)[:, None], y * np.sqrt(w), rcond=None)[0]
    assert np.allclose([c, got[0], got[2]], want, atol=1e-6) and got[1] == got[3] == 0


def test_alignment_and_leaks_are_errors(spark):
    vectors = spark.createDataFrame([(1, 0, 1.0), (2, 0, 2.0)], "pair_id long, feature int, value double")
    rows = lambda ids: spark.createDataFrame([(i,) for i in ids], "pair_id long")
    assert V.aligned(vectors, rows([1, 2])).count() == 2
    for ids in ([1], [1, 2, 3], [1, 2, 2]):
        with pytest.raises(ValueError, match="metadata"):
            V.aligned(vectors, rows(ids))
    parts = spark.createDataFrame([("a", "train"), ("a", "test"), ("b", "test")], "grp string, part string")
    with pytest.raises(ValueError, match="several parts"):
        S.assert_no_leak(parts, "grp")
    S.assert_no_leak(parts.where("grp = 'b'"), "grp")
    groups = spark.range(50).select(F.col("id").alias("grp"))
    assert S.exact_group_split(groups, "grp", 0.2).where("part = 'test'").count() == 10


def test_encoding_has_a_threshold_for_each_feature_and_a_bias_of_its_own(spark):
    inputs = spark.createDataFrame([(1, 0, 2.0), (2, 1, -1.0)], "pair_id long, k int, value double")
    weights = spark.createDataFrame([(0, 0, 1.0), (0, 1, 1.0), (1, 0, 1.0)], "k int, feature int, w double")
    params = spark.createDataFrame([(0, 0.0, 1.0), (1, 0.0, 5.0), (2, 0.7, 0.5), (3, -0.2, -1.0)], "feature int, b double, theta double")
    got = {(r.pair_id, r.feature): r.value for r in V.encode(inputs, weights, params).collect()}
    assert got == {(1, 0): 2.0, (1, 2): 0.7, (2, 2): 0.7}


def test_percentiles_equal_numpy(spark):
    rng = np.random.default_rng(1)
    data = {0: rng.normal(size=101), 1: np.repeat([1.0, 2.0, 5.0], [7, 1, 2]), 2: np.array([3.0])}
    rows = spark.createDataFrame([(f, float(v)) for f, vs in data.items() for v in vs], "feature int, value double")
    got = {r.feature: (r.p0, r.p1, r.p2) for r in H.percentiles(rows, (0.25, 0.6, 1.0)).collect()}
    for f, v in data.items():
        assert np.allclose(got[f], np.quantile(v, [0.25, 0.6, 1.0]))


def test_dumps_come_back(spark, data):
    x, _, _ = data
    model, path = M.tree(frame(spark, x, (x[:, 1] > 0).astype(float)), 1, 5), files.scratch(spark, "dump")
    files.write_text(spark, model.toDebugString, path)
    back = "\n".join(r[0] for r in spark.read.text(path).collect())
    assert M.top_splits(back) == M.top_splits(model.toDebugString) and M.top_splits(back)[0][1] == 1
