"""Quantiles, areas, mixtures and tiled products against numpy."""

from __future__ import annotations

import numpy as np
import pytest

from variantlab.operators import metrics as K, sparse as V, thresholds as H
from variantlab.operators.ordered import quantiles


@pytest.fixture
def many_ranges(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_quantiles_equal_numpy(spark, many_ranges):
    rng = np.random.default_rng(2)
    shares = (0.0, 0.05, 0.5, 0.77, 1.0)
    for values in (rng.normal(size=500), rng.integers(0, 4, 300).astype(float), np.array([7.0]), np.array([1.0, 2.0]), np.repeat([5.0, -1.0], [200, 1])):
        rows = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double").repartition(3)
        assert quantiles(rows, "v", shares) == pytest.approx(np.quantile(values, shares).tolist())
    assert quantiles(spark.createDataFrame([(None,)], "v double"), "v", (0.5, 1.0)) == [None, None]


def test_area_over_many_ranges(spark, many_ranges):
    rng = np.random.default_rng(4)
    y, w = rng.integers(0, 2, 400), rng.uniform(0.1, 2, 400)
    for score in (rng.normal(size=400) + y, np.round(rng.normal(size=400) + y, 1), np.zeros(400)):
        rows = spark.createDataFrame([(int(a), float(s), float(b)) for a, s, b in zip(y, score, w, strict=True)], "y int, score double, w double")
        one, zero = y == 1, y == 0
        above = (score[one][:, None] > score[zero][None]) + 0.5 * (score[one][:, None] == score[zero][None])
        want = (above * w[one][:, None] * w[zero][None]).sum() / (w[one].sum() * w[zero].sum())
        assert K.weighted_auc(rows).first().auc == pytest.approx(want)
    assert K.weighted_auc(rows.where("y = 1")).first().auc is None
    assert K.weighted_auc(rows.limit(0)).first().auc is None


def plain_mixture(x, steps=500):
    """Expectation maximisation over all values, from several cuts; the likeliest end."""
    best = None
    for share in (0.1, 0.25, 0.5, 0.75, 0.9):
        r = np.stack((x <= np.quantile(x, share), x > np.quantile(x, share))) * 0.98 + 0.01
        for _ in range(steps):
            weight = r.sum(axis=1)
            mu = (r * x).sum(axis=1) / weight
            var = np.maximum((r * (x - mu[:, None]) ** 2).sum(axis=1) / weight, 1e-9)
            log = np.log(weight / len(x))[:, None] - (np.log(2 * np.pi * var)[:, None] + (x - mu[:, None]) ** 2 / var[:, None]) / 2
            total = np.logaddexp(*log)
            r = np.exp(log - total)
        if best is None or total.sum() > best[0]:
            best = total.sum(), mu, np.sqrt(var)
    order = np.argsort(best[1])
    return best[1][order], best[2][order]


def test_mixtures_of_all_features_at_once(spark):
    rng = np.random.default_rng(2)
    planted = {0: ((1, 0.1, 300), (3, 0.2, 300)), 1: ((-2, 0.5, 900), (2, 1.0, 100)), 4: ((0.5, 0.05, 50), (0.9, 0.05, 400))}
    data = {f: np.concatenate([rng.normal(m, s, n) for m, s, n in parts]) for f, parts in planted.items()}
    rows = [(k, f, float(v)) for f, x in data.items() for k, v in enumerate(x)] + [(k, 7, 2.0) for k in range(20)] + [(k, 8, float(k)) for k in range(5)]
    got = {r.feature: r for r in H.mixture_fits(spark.createDataFrame(rows, "pair_id long, feature int, value double").repartition(3)).collect()}
    assert set(got) == {0, 1, 4, 7}  # 8 has too few values
    for f, x in data.items():
        mu, deviation = plain_mixture(x)
        step = (x.max() - x.min()) / 512
        r = got[f]
        assert np.allclose((r.low_mean, r.high_mean), mu, atol=3 * step) and np.allclose((r.low_deviation, r.high_deviation), deviation, atol=3 * step)
        assert np.allclose((r.low_mean, r.high_mean), [m for m, _, _ in planted[f]], atol=0.25)
        assert r.threshold == pytest.approx(min(r.low_mean + 2 * r.low_deviation, (r.low_mean + r.high_mean) / 2))
        assert r.low_share == pytest.approx(planted[f][0][2] / len(x), abs=0.03)
    assert np.isfinite(got[7].threshold)


def test_tiles_equal_numpy(spark, monkeypatch):
    monkeypatch.setattr(V, "TILE_ROWS", 7)
    monkeypatch.setattr(V, "TILE_OUTPUTS", 5)
    rng = np.random.default_rng(6)
    x = np.where(rng.random((40, 9)) < 0.5, rng.normal(size=(40, 9)), 0.0)
    x[3] = 0
    w = np.where(rng.random((9, 23)) < 0.6, rng.normal(size=(9, 23)), 0.0)
    w[:, 4] = 0  # an output with a bias alone
    b, theta = rng.normal(size=23) * 0.3, np.abs(rng.normal(size=23)) * 0.2
    b[4] = 1.5
    cells = lambda m, names: spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m), strict=True)], names)
    inputs = cells(x, "pair_id long, k int, value double").unionByName(spark.createDataFrame([(3, 2, 0.0)], "pair_id long, k int, value double"))
    params = spark.createDataFrame([(j, float(b[j]), float(theta[j])) for j in range(23)], "feature int, b double, theta double")
    pre = x @ w + b
    got = {(r.pair_id, r.feature): r.value for r in V.encode(inputs, cells(w, "k int, feature int, w double"), params).collect()}
    want = {(i, j): pre[i, j] for i, j in zip(*np.nonzero((pre > theta) & (pre > 0)), strict=True)}
    assert got == pytest.approx(want) and (3, 4) in got
    codes = cells(np.maximum(pre, 0)[:38], "pair_id long, feature int, value double")
    back, bias = rng.normal(size=(23, 6)), np.array([0.1, 0, 0, 0.2, 0, 0])
    rows = spark.range(40).withColumnRenamed("id", "pair_id")
    biases = spark.createDataFrame([(j, float(v)) for j, v in enumerate(bias) if v], "k int, b double")
    got = {(r.pair_id, r.k): r.value for r in V.decode(codes, cells(back, "feature int, k int, w double"), biases, rows).collect()}
    full = np.vstack([np.maximum(pre, 0)[:38] @ back, np.zeros((2, 6))]) + bias
    assert got == pytest.approx({(i, j): full[i, j] for i, j in zip(*np.nonzero(full), strict=True)})
