"""Long-form sparse features (pair_id, feature, value): building, combining, scaling and profiling. Zeros are implicit, so means and deviations take the number of rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .ordered import quantiles


def from_arrays(rows: DataFrame, key: str, values: str, theta: float | None = None) -> DataFrame:
    """(pair_id, feature, value) of an array column; with theta, only values above it stay (a thresholded rectifier)."""
    each = rows.select(F.col(key).alias("pair_id"), F.posexplode(F.col(values).cast("array<double>")).alias("feature", "value"))
    return each.where(F.col("value") > theta) if theta is not None else each.where("value <> 0")


#: Rows and outputs of a tile.
TILE_ROWS, TILE_OUTPUTS = 512, 512


def _tiles(values: DataFrame, rows: DataFrame, weights: DataFrame, outputs: DataFrame, finish: str) -> DataFrame:
    """(pair_id, out, value): values (pair_id, k, value) times weights (k, out, w) plus outputs' b, by tiles of rows and outputs.

    rows (pair_id) and outputs (out, b, theta) are all rows and outputs of the product. A tile is one dense product of its
    rows' and its outputs' inputs, so what is shuffled are rows, once for each block of outputs, and weights, once for
    each block of rows; no input meets a weight as a row. finish: above keeps values over theta and 0, other those other than 0.
    """
    r, o = (max(1, -(-df.count() // size)) for df, size in ((rows, TILE_ROWS), (outputs, TILE_OUTPUTS)))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cell = lambda a, b: F.collect_list(F.struct(F.col(a).cast("int").alias("k"), F.col(b).cast("double").alias("v")))
    left = rows.select("pair_id").join(values.groupBy("pair_id").agg(cell("k", "value").alias("c")), "pair_id", "left")
    left = left.select(block("pair_id", r).alias("r"), every(o).alias("o"), F.col("pair_id").cast("long").alias("pair_id"), F.col("c.k").alias("k"), F.col("c.v").alias("v"))
    right = outputs.join(weights.groupBy("out").agg(cell("k", "w").alias("c")), "out", "left")
    right = right.select(every(r).alias("r"), block("out", o).alias("o"), F.col("out").cast("int").alias("out"), F.col("b").cast("double").alias("b"), F.col("theta").cast("double").alias("theta"), F.col("c.k").alias("k"), F.col("c.v").alias("v"))

    def matrix(pdf: pd.DataFrame, inputs: np.ndarray) -> np.ndarray:
        out = np.zeros((len(pdf), len(inputs)))
        for i, (k, v) in enumerate(zip(pdf["k"], pdf["v"], strict=True)):
            if k is not None and len(k):
                k, v = np.asarray(k), np.asarray(v)
                at = np.minimum(np.searchsorted(inputs, k), len(inputs) - 1) if len(inputs) else np.zeros(len(k), int)
                hit = inputs[at] == k if len(inputs) else np.zeros(len(k), bool)
                np.add.at(out[i], at[hit], v[hit])
        return out

    def product(rows: pd.DataFrame, columns: pd.DataFrame) -> pd.DataFrame:
        lists = [np.asarray(k) for k in rows["k"] if k is not None and len(k)]
        inputs = np.unique(np.concatenate(lists)) if lists else np.zeros(0, np.int64)
        out = matrix(rows, inputs) @ matrix(columns, inputs).T + columns["b"].to_numpy()[None]
        i, j = np.nonzero((out > columns["theta"].to_numpy()[None]) & (out > 0) if finish == "above" else out != 0)
        return pd.DataFrame({"pair_id": rows["pair_id"].to_numpy()[i], "out": columns["out"].to_numpy()[j], "value": out[i, j]})

    return left.groupBy("r", "o").cogroup(right.groupBy("r", "o")).applyInPandas(product, "pair_id long, out int, value double")


def encode(inputs: DataFrame, weights: DataFrame, params: DataFrame) -> DataFrame:
    """inputs (pair_id, k, value) times weights (k, feature, w) plus bias, kept where positive and above the feature's own threshold; params: feature, b, theta."""
    found = _tiles(inputs, inputs.select("pair_id").distinct(), weights.select("k", F.col("feature").alias("out"), "w"), params.select(F.col("feature").alias("out"), "b", "theta"), "above")
    return found.select("pair_id", F.col("out").alias("feature"), "value")


def decode(codes: DataFrame, weights: DataFrame, bias: DataFrame, rows: DataFrame) -> DataFrame:
    """(pair_id, k, value): codes (pair_id, feature, value) times weights (feature, k, w) plus bias (k, b), for every row (pair_id), one without codes too; zeros are left out."""
    values = codes.select("pair_id", F.col("feature").alias("k"), "value")
    sides = weights.select(F.col("feature").alias("k"), F.col("k").alias("out"), "w")
    outputs = sides.select("out").unionByName(bias.select(F.col("k").alias("out"))).distinct().join(bias.select(F.col("k").alias("out"), "b"), "out", "left")
    outputs = outputs.select("out", F.coalesce("b", F.lit(0.0)).alias("b"), F.lit(0.0).alias("theta"))
    return _tiles(values, rows.select("pair_id").distinct(), sides, outputs, "other").select("pair_id", F.col("out").alias("k"), "value")


def forward(inputs: DataFrame, encoder: DataFrame, params: DataFrame, decoder: DataFrame, bias: DataFrame, skip: DataFrame | None = None) -> DataFrame:
    """Encode and decode, plus an affine skip of the inputs by skip (k, out, w) if there is one."""
    out = decode(encode(inputs, encoder, params), decoder, bias, inputs.select("pair_id").distinct())
    if skip is None:
        return out
    direct = inputs.join(skip, "k").groupBy("pair_id", F.col("out").alias("k")).agg(F.sum(F.col("value") * F.col("w")).alias("value"))
    return out.unionByName(direct).groupBy("pair_id", "k").agg(F.sum("value").alias("value"))


def is_content(pos: Column, prefix: int, length: Column, most: int) -> Column:
    """Whether the token at pos is of the content that follows a prefix; content that ends beyond most tokens has none."""
    return (pos >= prefix) & (pos < length + prefix) & (length + prefix <= most)


def flagged_fallbacks(vectors: DataFrame, rows: DataFrame) -> DataFrame:
    """rows (pair_id, ..) with is_fallback: whether vectors has nothing for the row, which thus counts as zeros."""
    found = vectors.select("pair_id").distinct().withColumn("found", F.lit(True))
    return rows.join(found, "pair_id", "left").withColumn("is_fallback", F.col("found").isNull()).drop("found")


def subset(vectors: DataFrame, wanted: DataFrame) -> DataFrame:
    """The features that wanted (feature) lists."""
    return vectors.join(wanted.select("feature").distinct(), "feature", "left_semi")


def without_dead(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """vectors with features numbered anew without gaps, and the numbers (feature, old). A width of features is ranked in one window."""
    numbers = vectors.select(F.col("feature").alias("old")).distinct().select((F.row_number().over(W.orderBy("old")) - 1).alias("feature"), "old")
    return vectors.withColumnRenamed("feature", "old").join(numbers, "old").select("pair_id", "feature", "value"), numbers


def just_below(vectors: DataFrame, thresholds: DataFrame, k: int = 3, least: int = 3) -> DataFrame:
    """The k largest positive values below each feature's threshold (feature, threshold), of features with at least least of them."""
    below = vectors.join(thresholds, "feature").where("value > 0 AND value < threshold")
    by = W.partitionBy("feature")
    ranked = below.withColumn("n", F.count("*").over(by)).where(f"n >= {least}")
    return top_k(ranked.drop("n"), ["feature"], "value", k, "pair_id")


def aligned(vectors: DataFrame, rows: DataFrame) -> DataFrame:
    """vectors joined with the metadata rows (pair_id, ..) of all pairs; a pair of one side only, or of two rows, is an error."""
    both = vectors.select("pair_id").distinct().withColumn("v", F.lit(1)).join(rows.groupBy("pair_id").agg(F.count("*").alias("r")), "pair_id", "full")
    no_row, no_vector, twice = both.agg(F.count_if(F.col("r").isNull()), F.count_if(F.col("v").isNull()), F.count_if(F.col("r") > 1)).first()
    if no_row or no_vector or twice:
        raise ValueError(f"{no_row} vectors without metadata, {no_vector} rows without a vector, {twice} pairs with several rows")
    return vectors.join(rows, "pair_id")


def max_pool(tokens: DataFrame) -> DataFrame:
    """The largest value of each feature over the content tokens (pair_id, feature, value, content) of a text."""
    return tokens.where("content").groupBy("pair_id", "feature").agg(F.max("value").alias("value")).where("value <> 0")


def mean_pool(tokens: DataFrame, k: int) -> DataFrame:
    """The k features of the largest mean over a text's tokens (pair_id, feature, value)."""
    means = tokens.groupBy("pair_id", "feature").agg(F.avg("value").alias("value"))
    return top_k(means, ["pair_id"], "value", k)


def context_and_difference(sides: DataFrame, width: int) -> DataFrame:
    """Both halves of each pair from signed vectors (pair_id, sign, feature, value): the mean below width, the difference from width on; one shuffle."""
    both = sides.groupBy("pair_id", "feature").agg((F.sum("value") / 2).alias("ctx"), F.sum(F.col("sign") * F.col("value")).alias("diff"))
    parts = F.array(F.struct(F.col("feature").alias("feature"), F.col("ctx").alias("value")), F.struct((F.col("feature") + width).alias("feature"), F.col("diff").alias("value")))
    return both.select("pair_id", F.explode(parts).alias("x")).select("pair_id", "x.feature", "x.value").where("value <> 0")


def with_label(vectors: DataFrame, labels: DataFrame, width: int) -> DataFrame:
    """The label (pair_id, label) as one more feature."""
    return vectors.unionByName(labels.select("pair_id", F.lit(width).alias("feature"), F.col("label").cast("double").alias("value")))


def scale_table(vectors: DataFrame, n_rows: Column | int) -> DataFrame:
    """(feature, scale, largest): population deviation with implicit zeros, and the largest absolute value."""
    n = n_rows if isinstance(n_rows, Column) else F.lit(n_rows)
    mean = F.sum("value") / n
    return vectors.groupBy("feature").agg(F.sqrt(F.greatest(F.lit(0.0), F.sum(F.col("value") * F.col("value")) / n - mean * mean)).alias("scale"), F.max(F.abs("value")).alias("largest"))


def scaled(vectors: DataFrame, scales: DataFrame, by: str = "scale", floor: float = 0.0) -> DataFrame:
    """Values over their feature's scale; features without one stay as they are."""
    s = F.greatest(F.col(by), F.lit(floor))
    return vectors.join(scales.select("feature", by), "feature").withColumn("value", F.when(s > 0, F.col("value") / s).otherwise(F.col("value"))).drop(by)


def scale_diagnostics(vectors: DataFrame, n_rows: Column | int, width: int, small: float = 0.01) -> DataFrame:
    """(kind, least, most, mean, std, scale_least, scale_most, scale_mean, small_scales, dead) of the non-zero values as they are, over deviations, and over largest absolute values.

    Values after scaling follow from each feature's count, sums and range, so cells are read once and shuffled as partial
    sums. A deviation of 0 up to rounding, also that of a feature without values, scales by 1; such a feature's largest value is 0.
    Without values least, most, mean and std are null.
    """
    n, v = n_rows if isinstance(n_rows, Column) else F.lit(n_rows), F.col("value")
    sums = vectors.where("value <> 0").groupBy("feature").agg(F.count("*").alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("ss"), F.min(v).alias("lo"), F.max(v).alias("hi"))
    square = F.col("ss") / n
    variance = square - (F.col("s") / n) * (F.col("s") / n)
    scales = {"original": F.lit(None).cast("double"), "standard": F.when(variance > 1e-12 * square, F.sqrt(variance)).otherwise(1.0), "largest": F.greatest(F.abs("lo"), F.abs("hi"))}
    each = F.inline(F.array(*[F.struct(F.lit(kind).alias("kind"), F.coalesce(s, F.lit(1.0)).alias("by"), s.alias("scale")) for kind, s in scales.items()]))
    rows = sums.select("*", each)
    kinds = rows.sparkSession.createDataFrame([("original", None), ("standard", 1.0), ("largest", 0.0)], "kind string, of_dead double")
    by, s = F.col("by"), F.col("scale")
    found = rows.groupBy("kind").agg(F.count("*").alias("live"), F.sum("n").alias("n"), F.min(F.col("lo") / by).alias("least"), F.max(F.col("hi") / by).alias("most"), F.sum(F.col("s") / by).alias("s"), F.sum(F.col("ss") / by / by).alias("ss"), F.min(s).alias("lo"), F.max(s).alias("hi"), F.sum(s).alias("total"), F.count_if(s < small).alias("low"))
    dead = F.lit(width) - F.coalesce("live", F.lit(0))
    other, mean = F.when(dead > 0, F.col("of_dead")), F.col("s") / F.col("n")
    return kinds.join(found, "kind", "left").select(
        "kind", "least", "most", mean.alias("mean"), F.when(F.col("n") > 0, F.sqrt(F.greatest(F.lit(0.0), F.col("ss") / F.col("n") - mean * mean))).alias("std"), F.least("lo", other).alias("scale_least"), F.greatest("hi", other).alias("scale_most"),
        ((F.coalesce("total", F.lit(0.0)) + dead * F.col("of_dead")) / width).alias("scale_mean"), F.when(F.col("of_dead").isNotNull(), F.coalesce("low", F.lit(0)) + F.when(F.col("of_dead") < small, dead).otherwise(0)).alias("small_scales"), dead.alias("dead"),
    )


Path = tuple[tuple[int, str, float], ...]


def path_rows(vectors: DataFrame, rows: DataFrame, scales: DataFrame, paths: list[Path], floor: float = 1e-10) -> DataFrame:
    """(path, pair_id, score) of all rows (pair_id) that meet every condition (feature, operator, cut) of a path, absent values as 0.

    The score adds a condition's value over its feature's scale (of scale_table, fitted on all rows), less it for
    < and <=. A scale of 0 or none is 1, smaller ones than floor are floor. Only cells of the paths' features are read on,
    and only their scales reach the driver; a path without conditions is met by all, with score 0.
    """
    features = sorted({f for path in paths for f, _, _ in path})
    scale = {r.feature: r.scale for r in scales.where(F.col("feature").isin(features)).collect()}
    cells = vectors.where(F.col("feature").isin(features)).groupBy("pair_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("feature").cast("int"), F.col("value").cast("double")))).alias("values"))
    known = rows.select("pair_id").join(cells, "pair_id", "left")
    found = []
    for number, path in enumerate(paths):
        met, score = F.lit(True), F.lit(0.0)
        for feature, op, cut in path:
            v = F.coalesce(F.try_element_at("values", F.lit(feature)), F.lit(0.0))
            met = met & {"<=": v <= cut, ">": v > cut, "<": v < cut, ">=": v >= cut}[op]
            part = v / max(scale.get(feature) or 1.0, floor)
            score = score + part if op in (">", ">=") else score - part
        found.append(F.struct(F.lit(number).alias("path"), met.alias("met"), score.alias("score")))
    return known.select("pair_id", F.inline(F.array(*found))).where("met").select("path", "pair_id", "score")


def row_profile(vectors: DataFrame, rows: DataFrame) -> DataFrame:
    """(pair_id, nnz, norm) of every row of rows (pair_id), zero rows too."""
    found = vectors.groupBy("pair_id").agg(F.count("*").alias("nnz"), F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
    return rows.select("pair_id").join(found, "pair_id", "left").na.fill(0, ["nnz"]).na.fill(0.0, ["norm"])


def row_summary(profile: DataFrame) -> DataFrame:
    """Least, median and 95th percentile of row_profile's nnz and norm, and the rows without values; percentiles come from ranges of counted values."""
    names = ("least", "median", "p95")
    cols = [F.lit(x).cast("double").alias(f"{c}_{n}") for c in ("nnz", "norm") for n, x in zip(names, quantiles(profile, c, (0.0, 0.5, 0.95)), strict=True)]
    return profile.agg(F.count_if(F.col("nnz") == 0).alias("zero_rows"), F.count("*").alias("n_rows")).select(*cols, "zero_rows", "n_rows")


def sparsity(vectors: DataFrame, n_rows: int, width: int) -> DataFrame:
    v = F.col("value")
    return vectors.agg(F.count("*").alias("nnz"), (F.count("*") / (float(n_rows) * width)).alias("density"), (F.lit(width) - F.countDistinct("feature")).alias("dead"), F.count_if(v > 0).alias("positive"), F.count_if(v < 0).alias("negative"), F.min(v).alias("least"), F.max(v).alias("most"))


def column_stats(vectors: DataFrame, groups: DataFrame) -> DataFrame:
    """(grp, feature, mean, total, squares, variance) over all rows of a group, zeros included; groups: pair_id, grp."""
    sizes = groups.groupBy("grp").agg(F.count("*").alias("n"))
    sums = vectors.join(groups, "pair_id").groupBy("grp", "feature").agg(F.sum("value").alias("total"), F.sum(F.col("value") * F.col("value")).alias("squares"))
    mean = F.col("total") / F.col("n")
    return sums.join(sizes, "grp").select("grp", "feature", mean.alias("mean"), "total", "squares", (F.col("squares") / F.col("n") - mean * mean).alias("variance"))


def distinctive(stats: DataFrame, overall: DataFrame, k: int) -> DataFrame:
    """The k features of each group whose mean exceeds the overall mean most."""
    joined = stats.select("grp", "feature", "mean").join(overall.select("feature", F.col("mean").alias("all_mean")), "feature")
    return top_k(joined.withColumn("gap", F.col("mean") - F.col("all_mean")), ["grp"], "gap", k, "feature")


def top_k(df: DataFrame, keys: list[str], value: str, k: int, tie: str = "feature", ascending: bool = False) -> DataFrame:
    """The k largest (or smallest) rows of each key, ties by tie."""
    order = F.asc(value) if ascending else F.desc(value)
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(order, tie))).where(f"rank <= {k}")


def top_overall(df: DataFrame, value: str, k: int, tie: str = "feature") -> DataFrame:
    """The k largest rows of all, ties by tie."""
    return df.orderBy(F.desc(value), tie).limit(k)


def importance_by_space(importances: DataFrame, width: int) -> DataFrame:
    """(space, n, mean) of importances (feature, score): features below width, and those from width on."""
    return importances.groupBy(F.when(F.col("feature") >= width, "diff").otherwise("ctx").alias("space")).agg(F.count("*").alias("n"), F.avg("score").alias("mean"))


def active_features(coefficients: DataFrame) -> DataFrame:
    """The features with a coefficient other than 0 in any model of coefficients (model, feature, coef)."""
    return coefficients.where("coef <> 0").select("feature").distinct()


def coefficient_spread(coefficients: DataFrame, k: int = 30) -> DataFrame:
    """(feature, variance) of the k active features whose coefficients (model, feature, coef) vary most between models; absent ones are 0."""
    n = coefficients.agg(F.countDistinct("model")).first()[0]
    mean = F.sum("coef") / n
    spread = coefficients.where("coef <> 0").groupBy("feature").agg(F.greatest(F.lit(0.0), F.sum(F.col("coef") * F.col("coef")) / n - mean * mean).alias("variance"))
    return top_overall(spread, "variance", k)


def top_positive_or_absolute(vectors: DataFrame, k: int) -> DataFrame:
    """The k largest positive values of each feature; of features without one, the k largest by absolute value."""
    by = W.partitionBy("feature")
    flagged = vectors.withColumn("any", F.max(F.col("value") > 0).over(by)).where("value > 0 OR NOT any")
    return flagged.withColumn("rank", F.row_number().over(by.orderBy(F.desc(F.abs("value")), "pair_id"))).where(f"rank <= {k}").drop("any")


def split_points(z: DataFrame) -> DataFrame:
    """Candidate cuts of (z, w, r): distinct z with running counts and sums of w, w r and w r^2, and the midpoint to the next z. Rows are summed by z before the window."""
    each = z.groupBy("feature", "z").agg(F.count("*").cast("double").alias("n"), F.sum("w").alias("w"), F.sum(F.col("w") * F.col("r")).alias("wr"), F.sum(F.col("w") * F.col("r") * F.col("r")).alias("wrr"))
    by = W.partitionBy("feature").orderBy("z")
    run = by.rowsBetween(W.unboundedPreceding, 0)
    return each.select("feature", "z", ((F.col("z") + F.lead("z").over(by)) / 2).alias("cut"), *[F.sum(c).over(run).alias(f"sum_{c}") for c in ("n", "w", "wr", "wrr")])
