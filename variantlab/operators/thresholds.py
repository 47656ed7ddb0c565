"""Histogram-based activation thresholds over non-zero values, and binarisation that knows of implicit zeros."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Features with fewer non-zero values get no threshold.
LEAST_VALUES = 10


def histogram(vectors: DataFrame, bins: int) -> DataFrame:
    """(feature, bin, n, centre, step): equal-width bins from least to most, the last closed, empty bins too; a constant spans half a unit on both sides."""
    span = vectors.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*").alias("total")).where(f"total >= {LEAST_VALUES}")
    flat = F.col("lo") == F.col("hi")
    span = span.select("feature", F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    span = span.withColumn("step", (F.col("hi") - F.col("lo")) / bins)
    at = F.least(F.floor((F.col("value") - F.col("lo")) / F.col("step")), F.lit(bins - 1)).cast("int")
    counts = vectors.join(span, "feature").groupBy("feature", at.alias("bin")).agg(F.count("*").alias("n"))
    grid = span.select("feature", "lo", "step", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return grid.join(counts, ["feature", "bin"], "left").select("feature", "bin", F.coalesce("n", F.lit(0)).alias("n"), (F.col("lo") + (F.col("bin") + 0.5) * F.col("step")).alias("centre"), "step")


def _rising(hist: DataFrame, ahead: int) -> DataFrame:
    by = W.partitionBy("feature").orderBy("bin")
    following = [F.lead("n", j).over(by) for j in range(1, ahead + 1)]
    return hist.withColumn("rises", F.coalesce(F.least(*following) > F.col("n"), F.lit(False)) & following[-1].isNotNull())


def walk_right(hist: DataFrame, ahead: int = 4) -> DataFrame:
    """(feature, threshold): the centre of the first bin that the next bins all exceed."""
    return _rising(hist, ahead).where("rises").groupBy("feature").agg(F.min_by("centre", "bin").alias("threshold"))


def walk_outward(hist: DataFrame, ahead: int = 4) -> DataFrame:
    """(feature, low, high): as walk_right from the bin nearest to 0 on, the first on ties, and mirrored."""
    nearest = F.min(F.struct(F.abs("centre").alias("d"), F.col("bin").alias("b"))).over(W.partitionBy("feature"))
    walk = _rising(hist, ahead).withColumn("zero", nearest["b"]).where("rises AND bin >= zero")
    return walk.groupBy("feature").agg(F.min_by("centre", "bin").alias("high")).select("feature", (-F.col("high")).alias("low"), "high")


def valleys(hist: DataFrame, reach: int, window: int = 9) -> DataFrame:
    """Strict local minima (feature, bin, centre, smooth) of the histogram smoothed by a moving average padded with zeros."""
    half = window // 2
    by = W.partitionBy("feature").orderBy("bin")
    smooth = hist.withColumn("smooth", F.sum("n").over(by.rowsBetween(-half, half)) / float(window))
    lower = [F.coalesce(F.col("smooth") < F.lag("smooth", j).over(by), F.lit(False)) & F.coalesce(F.col("smooth") < F.lead("smooth", j).over(by), F.lit(False)) for j in range(1, reach + 1)]
    deep = lower[0]
    for x in lower[1:]:
        deep = deep & x
    return smooth.withColumn("deep", deep).where("deep").select("feature", "bin", "centre", "smooth")


def valley_context(hist: DataFrame) -> DataFrame:
    """(feature, threshold): the deepest valley."""
    return valleys(hist, 8).groupBy("feature").agg(F.min(F.struct("smooth", "bin", "centre")).alias("m")).select("feature", F.col("m.centre").alias("threshold"))


def valley_difference(hist: DataFrame) -> DataFrame:
    """(feature, low, high): the deepest valley on each side of 0; a lone one is mirrored."""
    pick = lambda c: F.min(F.when(c, F.struct("smooth", "bin", "centre")))["centre"]
    ends = valleys(hist, 10).groupBy("feature").agg(pick(F.col("centre") < 0).alias("neg"), pick(F.col("centre") > 0).alias("pos"))
    return ends.where("neg IS NOT NULL OR pos IS NOT NULL").select("feature", F.coalesce("neg", -F.col("pos")).alias("low"), F.coalesce("pos", -F.col("neg")).alias("high"))


def percentiles(vectors: DataFrame, shares: tuple[float, ...]) -> DataFrame:
    """(feature, p0, p1, ..): exact percentiles of each feature's values by linear interpolation.

    Values are counted first; a running count finds the values at the two ranks around each percentile, so what a
    feature needs is a sort of its distinct values, which spills, and not a buffer of all of them.
    """
    counts = vectors.groupBy("feature", "value").agg(F.count("*").alias("n"))
    by = W.partitionBy("feature")
    ranked = counts.withColumn("upto", F.sum("n").over(by.orderBy("value"))).withColumn("total", F.sum("n").over(by))

    def at(rank: Column) -> Column:
        return F.min(F.when(F.col("upto") > rank, F.col("value")))

    out = []
    for k, share in enumerate(shares):
        place = share * (F.col("total") - 1)
        low, high = F.floor(place), F.ceil(place)
        out.append((at(low) + (at(high) - at(low)) * F.max(place - low)).alias(f"p{k}"))
    return ranked.groupBy("feature").agg(*out)


def elbow(vectors: DataFrame) -> DataFrame:
    return percentiles(vectors, (0.25,)).select("feature", F.col("p0").alias("threshold"))


def central_sigma(vectors: DataFrame) -> DataFrame:
    """(feature, low, high): three deviations, estimated from the quartiles of a normal peak."""
    reach = 3 * (F.col("p1") - F.col("p0")) / 1.349
    return percentiles(vectors, (0.25, 0.75)).select("feature", (-reach).alias("low"), reach.alias("high"))


def binarised(vectors: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(pair_id, feature, value): 1 at or above high, else -1 at or below low; thresholds: feature, low (null: none), high.

    Implicit zeros are compared too: a feature with high <= 0, or low >= 0, has a value in rows that vectors lacks.
    Such features are listed by zero_fires, whose constant holds for all rows without a stored value.
    """
    v = F.when(F.col("value") >= F.col("high"), 1).when(F.col("value") <= F.col("low"), -1).otherwise(0)
    return vectors.join(thresholds, "feature").select("pair_id", "feature", v.cast("byte").alias("value")).where("value <> 0")


def zero_fires(thresholds: DataFrame) -> DataFrame:
    """(feature, value): what an implicit zero becomes, where that is not zero."""
    return thresholds.select("feature", F.when(F.col("high") <= 0, 1).when(F.col("low") >= 0, -1).otherwise(0).cast("byte").alias("value")).where("value <> 0")


def binarised_with_zeros(vectors: DataFrame, thresholds: DataFrame, rows: DataFrame) -> DataFrame:
    """binarised, with the implicit zeros of zero_fires' features written out for all rows (pair_id)."""
    fires = zero_fires(thresholds)
    # one row that holds the features which fire at zero, at most as many as thresholds
    cells = fires.select(F.struct(F.col("feature").cast("int").alias("feature"), "value").alias("f")).agg(F.collect_list("f").alias("fs"))
    stored = vectors.join(F.broadcast(fires.select("feature")), "feature", "left_semi").select("pair_id", "feature")
    implied = rows.select("pair_id").join(F.broadcast(cells)).select("pair_id", F.explode("fs").alias("f")).select("pair_id", "f.feature", "f.value")
    return binarised(vectors, thresholds).unionByName(implied.join(stored, ["pair_id", "feature"], "left_anti"))


def mixture_fits(vectors: DataFrame, bins: int = 512, steps: int = 500) -> DataFrame:
    """(feature, threshold, low_mean, low_deviation, low_share, high_mean, high_deviation): two normal components of every feature's values, all at once.

    Values are counted in bins, and expectation maximisation runs on a feature's bins, of which there are at most bins
    whatever the number of values; it starts from several cuts and keeps the likeliest end. threshold is the smaller of
    the lower component's mean plus two deviations and the midpoint of both means. A bin's values count as spread evenly over it, so means are within a
    bin of those of the values.
    """

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x, n, step = pdf["centre"].to_numpy(), pdf["n"].to_numpy(np.float64), float(pdf["step"].iloc[0])
        total, within = n.sum(), step * step / 12
        mean = (x * n).sum() / total
        floor = max(within, 1e-6 * ((x - mean) ** 2 * n).sum() / total, 1e-300)
        best = None
        order = np.argsort(x)
        upto = np.cumsum(n[order]) / total
        for share in (0.1, 0.25, 0.5, 0.75, 0.9):
            low = np.zeros(len(x))
            low[order] = upto <= max(share, upto[0])
            if low.all():
                low[order[-1]] = 0
            r = np.stack((low, 1 - low)) * 0.98 + 0.01
            last = -np.inf
            for _ in range(steps):
                weight = (r * n).sum(axis=1)
                mu = (r * n * x).sum(axis=1) / weight
                var = np.maximum((r * n * (x - mu[:, None]) ** 2).sum(axis=1) / weight + within, floor)
                log = np.log(weight / total)[:, None] - (np.log(2 * np.pi * var)[:, None] + ((x - mu[:, None]) ** 2 + within) / var[:, None]) / 2
                peak = log.max(axis=0)
                likelihood = (n * (peak + np.log(np.exp(log - peak).sum(axis=0)))).sum()
                r = np.exp(log - peak)
                r /= r.sum(axis=0)
                if likelihood - last < 1e-9 * total:
                    break
                last = likelihood
            if best is None or likelihood > best[0] + 1e-9 * total:
                best = likelihood, mu, np.sqrt(var), weight / total
        _, mu, deviation, share = best
        a, b = np.argsort(mu, kind="stable")
        threshold = min(mu[a] + 2 * deviation[a], (mu[a] + mu[b]) / 2)
        return pd.DataFrame([(int(pdf["feature"].iloc[0]), threshold, mu[a], deviation[a], share[a], mu[b], deviation[b])], columns=[c.split()[0] for c in _FITS.split(", ")])

    counted = histogram(vectors, bins).where("n > 0")
    return counted.groupBy("feature").applyInPandas(fit, _FITS)


_FITS = "feature int, threshold double, low_mean double, low_deviation double, low_share double, high_mean double, high_deviation double"
