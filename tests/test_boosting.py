"""Boosted trees split by split against a plain version over written-out rows."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from variantlab.operators import boosting as B, metrics as K
from variantlab.operators.boosting import Settings, boost, drawn
from variantlab.sources import files

UNIT = 1 << B.SCALE_BITS


def plain(table, y, w, width, settings):
    """Trees as nested tuples (feature, cut value, absent_left, gain, left, right) or leaf values; table: one dict of values a row."""
    levels = sorted({v for row in table for v in row.values()})
    margin, trees = np.zeros(len(y)), []
    score = lambda g, h: (g / UNIT) * (g / UNIT) / (h / UNIT + settings.l2)

    def grow(rows, depth, mine, g, h):
        G, H = sum(g[r] for r in rows), sum(h[r] for r in rows)
        best = None
        for f in mine if depth and H >= 2 * settings.child * UNIT else ():
            for c, cut in enumerate(levels):
                for side in (True, False):
                    left = [r for r in rows if (table[r][f] <= cut if f in table[r] else side)]
                    lg, lh = sum(g[r] for r in left), sum(h[r] for r in left)
                    if lh < settings.child * UNIT or H - lh < settings.child * UNIT or len(left) == len(rows):
                        continue
                    gain = (score(lg, lh) + score(G - lg, H - lh) - score(G, H)) / 2
                    mark = (gain, -f, -c, side)
                    if gain > B.LEAST_GAIN and (best is None or mark > best[0]):
                        best = mark, f, cut, side, left
        value = -(G / UNIT) / (H / UNIT + settings.l2) * settings.rate
        if best is None:
            for r in rows:
                step[r] = value
            return value
        inside = set(best[4])
        right = [r for r in rows if r not in inside]
        return best[1], best[2], best[3], best[0][0], grow(best[4], depth - 1, mine, g, h), grow(right, depth - 1, mine, g, h)

    for t in range(settings.trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = ([int(x) for x in np.rint(v * w * UNIT)] for v in (p - y, p * (1 - p)))
        mine = [f for f, d in zip(range(width), drawn(np.arange(width), t, settings), strict=True) if d]
        step = np.zeros(len(y))
        trees.append(grow(list(range(len(y))), settings.depth, mine, g, h))
        margin = margin + step
    return trees, 1 / (1 + np.exp(-margin))


def nested(tree, levels, k=0):
    if tree.feature[k] < 0:
        return tree.value[k]
    return tree.feature[k], levels[tree.cut[k]], tree.absent_left[k], tree.gain[k], nested(tree, levels, tree.left[k]), nested(tree, levels, tree.right[k])


def made(n, width, values, seed):
    rng = random.Random(seed)
    table = [{f: rng.choice(values) for f in range(width) if rng.random() < (0.1, 0.5, 0.9)[f % 3]} for _ in range(n)]
    for row in table:  # a copy of another feature: equal gains
        row.pop(width - 1, None)
        if 1 in row:
            row[width - 1] = row[1]
    table[0] = {}
    y = np.array([int(rng.random() < 1 / (1 + math.exp(-(2 * row.get(0, 0) * row.get(2, 0.5) + row.get(1, -1))))) for row in table])
    w = np.array([rng.choice([0.0, 0.3, 1.0, 2.0]) for _ in range(n)])
    return table, y, w


def frames(spark, table, y, w):
    cells = spark.createDataFrame([(i, f, float(v)) for i, row in enumerate(table) for f, v in row.items()], "pair_id long, feature int, value double")
    return cells.repartition(3), spark.createDataFrame([(i, int(a), float(b), "x") for i, (a, b) in enumerate(zip(y, w, strict=True))], "pair_id long, y int, w double, features string").repartition(2)


@pytest.mark.parametrize("values,settings", [((-1, 1), Settings(4, 3, 0.3, 0.7)), ((1,), Settings(3, 6, 0.1, l2=0.0, child=0.2)), ((-2, -1, 0, 3), Settings(2, 2, 1.0, l2=2.0, child=4.0))])
def test_trees_equal_a_plain_version(spark, monkeypatch, values, settings):
    monkeypatch.setattr(B, "BLOCK", 4)  # blocks meet again at the driver
    table, y, w = made(120, 10, values, 3)
    cells, rows = frames(spark, table, y, w)
    model = boost(cells, rows.drop("features"), 10, settings)
    want, score = plain(table, y, w, 10, settings)
    assert [nested(t, model.levels) for t in model.trees] == want
    assert any(isinstance(t, tuple) for t in want)
    got = {r.pair_id: r.score for r in B.predicted(model, cells, rows.drop("features")).collect()}
    assert [got[i] for i in range(len(y))] == pytest.approx(score.tolist(), abs=1e-12)
    nodes = B.node_table(spark, model)
    shares = {r.feature: r.score for r in B.importances(nodes).collect()}
    assert sum(shares.values()) == pytest.approx(1) and set(shares) == set(model.used().tolist())


def test_few_sums_at_once(spark, monkeypatch):
    """A level in several passes gives the same tree."""
    table, y, w = made(100, 9, (-1, 1), 5)
    cells, rows = frames(spark, table, y, w)
    whole = boost(cells, rows, 9, Settings(2, 4))
    monkeypatch.setattr(B, "MOST_SUMS", 20)
    few = boost(cells, rows, 9, Settings(2, 4))
    parts = lambda m: [(nested(t, m.levels), len(t.feature)) for t in m.trees]
    assert parts(whole) == parts(few)


def test_rows_are_sampled_by_tree(spark):
    table, y, w = made(200, 6, (-1, 1), 6)
    cells, rows = frames(spark, table, y, w)
    model = boost(cells, rows, 6, Settings(3, 2, rows=0.5))
    hessians = [t.sums[0][1] for t in model.trees]
    assert len(set(hessians)) == 3 and max(hessians) < 0.7 * 0.25 * w.sum() * UNIT
    for t, tree in enumerate(model.trees[:1]):
        kept = B._sampled(list(range(200)), t, model.settings)
        assert tree.sums[0][1] == int(np.rint(0.25 * w * kept * UNIT).sum())


def test_odd_tables(spark):
    rows = spark.createDataFrame([(1, 1, 1.0), (2, 0, 1.0)], "pair_id long, y int, w double")
    none = spark.createDataFrame([], "pair_id long, feature int, value double")
    model = boost(none, rows, 5)
    assert model.trees == [] and sorted((r.pair_id, r.score, r.p) for r in B.predicted(model, none, rows).collect()) == [(1, 0.5, 0), (2, 0.5, 0)]
    many = spark.createDataFrame([(1, 0, float(k)) for k in range(300)], "pair_id long, feature int, value double")
    with pytest.raises(ValueError):
        boost(many, rows, 1)
    one = spark.createDataFrame([(1, 0, 1.0), (2, 0, 1.0)], "pair_id long, feature int, value double")
    assert [len(t.feature) for t in boost(one, rows, 1, Settings(2, 3, child=0.0)).trees] == [1, 1]


def grouped(spark, table, y, w, group):
    cells, rows = frames(spark, table, y, w)
    keys = spark.createDataFrame([(i, g) for i, g in enumerate(group)], "pair_id long, cluster int")
    return cells, rows.join(keys, "pair_id")


@pytest.mark.parametrize("settings", [Settings(3, 3, 0.3, 0.7), Settings(2, 3, 0.5, rows=0.7), Settings(1, 3, 1.0, l2=0.0, child=3.0, squared=True)])
def test_groups_grow_as_they_would_alone(spark, settings):
    """Trees and scores of each group equal those of a fit on its rows alone; null is a group."""
    table, y, w = made(240, 9, (-1, 1), 8)
    group = [(None, 3, 7)[i % 3] for i in range(len(y))]
    cells, rows = grouped(spark, table, y, w, group)
    model = B.boost_each(cells, rows, 9, "cluster", settings)
    assert list(model.groups) == [None, 3, 7] and model.constant == {}
    got = {r.pair_id: (r.score, r.p, r.features) for r in B.predicted_each(model, cells, rows, "cluster").collect()}
    nodes = B.group_nodes(spark, model, "int").collect()
    for key in model.groups:
        own = rows.where(F.col("cluster").eqNullSafe(F.lit(key).cast("int")))
        alone = boost(cells.join(own.select("pair_id"), "pair_id", "left_semi"), own, 9, settings)
        assert alone.levels == model.levels
        assert [nested(t, model.levels, model.groups[key]) for t in model.trees] == [nested(t, alone.levels) for t in alone.trees]
        assert any(t.used() for t in alone.trees)
        for r in B.predicted(alone, cells, own.drop("features")).collect():
            assert got[r.pair_id] == (pytest.approx(r.score, abs=1e-12), r.p if not settings.squared else pytest.approx(r.p), "x")
        assert sum(n.grp == key for n in nodes) == sum(len(t.feature) for t in alone.trees)


@pytest.mark.parametrize("settings", [Settings(3, 3, 0.3, 0.7), Settings(2, 2, 0.5, rows=0.7)])
def test_a_model_of_all_rows_grows_beside_those_of_groups(spark, settings):
    """Both are what separate fits give; a group of one class has the model of all rows alone."""
    table, y, w = made(160, 9, (-1, 1), 8)
    group = [(None, 3, 7, 9)[i % 4] for i in range(len(y))]
    y = np.array([1 if g == 9 else v for g, v in zip(group, y, strict=True)])
    cells, rows = grouped(spark, table, y, w, group)
    whole, each = B.boost_both(cells, rows, 9, "cluster", settings)
    alone, apart = boost(cells, rows, 9, settings), B.boost_each(cells, rows, 9, "cluster", settings)
    assert whole.trees == alone.trees and whole.levels == alone.levels and whole.groups == alone.groups
    assert each.trees == apart.trees and each.groups == apart.groups == {None: 0, 3: 1, 7: 2} and each.constant == apart.constant == {9: 1.0}
    assert any(t.used() for t in whole.trees) and any(t.used() for t in each.trees)
    single, none = B.boost_both(cells, rows.where("cluster = 9"), 9, "cluster", settings)
    assert single.trees == boost(cells, rows.where("cluster = 9"), 9, settings).trees and none.trees == [] and none.constant == {9: 1.0}


def test_passes_do_not_score_all_trees_anew(spark, monkeypatch):
    """A pass walks the trees since margins were stored, one pass grows a level, the trees do not depend on it, and no chunks are left behind."""
    table, y, w = made(150, 6, (-1, 1), 7)
    cells, rows = frames(spark, table, y, w)
    monkeypatch.setattr(B, "CHUNK_ROWS", 7)
    whole = boost(cells, rows, 6, Settings(7, 2))
    passes, splits, paths = [], B._splits, []
    monkeypatch.setattr(B, "STORED", 2)
    monkeypatch.setattr(B, "_splits", lambda table, model, done, *rest: passes.append(len(model.trees) - done) or splits(table, model, done, *rest))
    monkeypatch.setattr(B, "scratch", lambda *at, f=B.scratch: paths.append(f(*at)) or paths[-1])
    assert boost(cells, rows, 6, Settings(7, 2)).trees == whole.trees
    assert len(passes) == 7 * 2 and max(passes) == 1
    assert len(paths) == 4 and not any(files.exists(spark, p) for p in paths)


def test_groups_of_one_class_and_unknown_groups(spark):
    table, y, w = made(150, 6, (-1, 1), 9)
    group = [i % 5 for i in range(len(y))]
    y = np.array([(1 if g == 1 else 0 if g == 2 else v) for g, v in zip(group, y, strict=True)])
    cells, rows = grouped(spark, table, y, w, group)
    model = B.boost_each(cells, rows.where("cluster < 4"), 6, "cluster", Settings(2, 2))
    assert list(model.groups) == [0, 3] and model.constant == {1: 1.0, 2: 0.0}
    got = B.predicted_each(model, cells, rows, "cluster").collect()
    assert len(got) == len(y)
    assert {(r.cluster, r.score, r.p) for r in got if r.cluster in (1, 2, 4)} == {(1, 1.0, 1), (2, 0.0, 0), (4, 0.0, 0)}
    single = B.boost_each(cells, rows.where("cluster = 1"), 6, "cluster")
    assert single.trees == [] and {r.score for r in B.predicted_each(single, cells, rows, "cluster").collect()} == {0.0, 1.0}
    nothing = B.boost_each(cells, rows.where("false"), 6, "cluster", Settings(squared=True))
    assert nothing.groups == {} and {r.score for r in B.predicted_each(nothing, cells, rows, "cluster").collect()} == {0.0}


def test_too_many_groups(spark, monkeypatch):
    monkeypatch.setattr(B, "MOST_GROUPS", 3)
    table, y, w = made(20, 4, (-1, 1), 1)
    cells, rows = grouped(spark, table, y, w, range(20))
    with pytest.raises(ValueError):
        B.boost_each(cells, rows, 4, "cluster")


def test_regression_tree_takes_weighted_means(spark):
    """One tree of squared loss: every leaf is the weighted mean of its rows, and the first cut the best of all."""
    rng = np.random.default_rng(2)
    table, _, _ = made(200, 5, (-1, 1), 4)
    w = np.array([float(1 + i % 3) for i in range(200)])
    y = np.array([2.0 * (row.get(3, 0) > 0) + 0.5 * row.get(0, 0) for row in table]) + rng.integers(-2, 3, 200) / 8
    cells = spark.createDataFrame([(i, f, float(v)) for i, row in enumerate(table) for f, v in row.items()], "pair_id long, feature int, value double")
    rows = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(y, w, strict=True))], "pair_id long, y double, w double").repartition(3)
    model = boost(cells, rows, 5, Settings(1, 3, 1.0, l2=0.0, child=20.0, squared=True))
    leaf = {r.pair_id: r.leaf for r in B.leaf_of(model, cells, rows).collect()}
    at = np.array([leaf[i] for i in range(200)])
    assert len(set(at)) > 3
    for k in set(at):
        assert model.trees[0].value[k] == pytest.approx(np.average(y[at == k], weights=w[at == k])) and w[at == k].sum() >= 20
    loss = lambda m: (w[m] * (y[m] - np.average(y[m], weights=w[m])) ** 2).sum()
    sides = []
    for f in range(5):
        x = np.array([row.get(f, np.nan) for row in table])
        sides += [m for m in (x <= -1, (x <= -1) | np.isnan(x), x <= 1) if w[m].sum() >= 20 and w[~m].sum() >= 20]
    best = min(loss(m) + loss(~m) for m in sides)
    assert model.trees[0].gain[0] == pytest.approx((loss(np.ones(200, bool)) - best) / 2)
    got = {r.pair_id: r.p for r in B.predicted(model, cells, rows).collect()}
    assert [got[i] for i in range(200)] == pytest.approx([model.trees[0].value[k] for k in at])
    assert {r.leaf for r in B.leaf_of(boost(cells.where("false"), rows, 5), cells, rows).collect()} == {0}


def test_areas_by_group_equal_all_pairs(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(2), rng.randrange(6) / 5, rng.choice([0.5, 1.0, 2.0])) for _ in range(300)] + [("c", 1, 0.5, 1.0)]
    df = spark.createDataFrame(rows, "cluster string, y int, score double, w double").withColumn("p", (F.col("score") > 0.5).cast("int")).repartition(3)
    got = {r.cluster: r for r in K.classification_by(df, "cluster").collect()}
    for key in ("a", "b", None):
        own = [r for r in rows if r[0] == key]
        pos, neg = [r for r in own if r[1]], [r for r in own if not r[1]]
        area = sum(p[3] * n[3] * (1.0 if p[2] > n[2] else 0.5 if p[2] == n[2] else 0.0) for p in pos for n in neg) / (sum(p[3] for p in pos) * sum(n[3] for n in neg))
        assert got[key].auc == pytest.approx(area) and got[key].n == len(own)
        assert got[key].accuracy == pytest.approx(sum(r[1] == (r[2] > 0.5) for r in own) / len(own))
    assert got["c"].auc is None and len(got) == 4
    assert K.classification_by(df.where("false"), "cluster").count() == 0 and K.weighted_auc(df.where("false")).first().auc is None
