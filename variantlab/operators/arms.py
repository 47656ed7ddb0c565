"""Arms of tests: column resolution, first-wins deduplication, groups, winners and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.rates import rate
from ..functions.text import clean_text
from .ordered import quantiles

#: The columns of a raw package table.
RAW = ("clickability_test_id", "headline", "lede", "impressions", "clicks")


def resolve_columns(df: DataFrame, wanted: tuple[str, ...] = RAW) -> DataFrame:
    """df with the wanted columns under these names; a column may be spelt without underscores. Missing ones are an error.

    The underscore-free spelling must agree in case, as a first look for it is case-sensitive.
    """
    bare = {c.replace("_", "") for c in df.columns}
    found, missing = [], []
    for name in wanted:
        if name in df.columns:
            found.append(name)
            continue
        like = [c for c in df.columns if c.replace("_", "").lower() == name.replace("_", "").lower()]
        if name.replace("_", "") in bare and like:
            found.append(like[0])
        else:
            missing.append(name)
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")
    return df.select(*[F.col(f"`{f}`").alias(n) for f, n in zip(found, wanted, strict=True)], *[c for c in df.columns if c == "row_ord"])


def keep_first(df: DataFrame, keys: list[str], order: str = "row_ord") -> DataFrame:
    """The first row of each key, null equal to null. order makes it definite, which dropDuplicates is not."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(order))).where("__n = 1").drop("__n")


def multi_row_groups(df: DataFrame, key: str) -> DataFrame:
    """Rows of groups of more than one row; a null key is no group."""
    return df.where(F.col(key).isNotNull()).withColumn("__n", F.count("*").over(W.partitionBy(key))).where("__n > 1").drop("__n")


def local_index(key: str, order: str = "row_ord") -> Column:
    return (F.row_number().over(W.partitionBy(key).orderBy(order)) - 1).cast("int")


def best_flag(key: str, value: str, order: str = "row_ord") -> Column:
    """1 for the row of the largest value, the first of tied ones."""
    return (F.row_number().over(W.partitionBy(key).orderBy(F.desc(value), order)) == 1).cast("int")


def prepare(raw: DataFrame) -> DataFrame:
    """The clean arm table from raw packages with row_ord: dedup, group filter, cleaning, ctr, best, local_idx; in this order.

    One exchange by test serves the deduplication's group filter, the winner and the index.
    """
    rows = resolve_columns(raw).withColumnRenamed("clickability_test_id", "test_id")
    rows = multi_row_groups(keep_first(rows.repartition("test_id"), ["test_id", "headline", "lede"]), "test_id")
    rows = rows.withColumn("headline", clean_text(F.col("headline"))).withColumn("lede", clean_text(F.col("lede")))
    rows = rows.withColumn("ctr", rate(F.col("clicks"), F.col("impressions")))
    return rows.withColumn("best", best_flag("test_id", "ctr")).withColumn("local_idx", local_index("test_id"))


def best_and_worst(arms: DataFrame, key: str = "test_id", value: str = "ctr") -> DataFrame:
    """Both ends of each group, first on ties; groups whose ends are one row or that have one row give none."""
    by = W.partitionBy(key)
    ranked = arms.withColumn("__top", F.row_number().over(by.orderBy(F.desc(value), "row_ord"))).withColumn("__low", F.row_number().over(by.orderBy(value, "row_ord")))
    ends = ranked.where("(__top = 1) <> (__low = 1)")
    return ends.withColumn("role", F.when(F.col("__top") == 1, "best").otherwise("worst")).drop("__top", "__low")


def rate_profile(arms: DataFrame, value: str = "ctr") -> DataFrame:
    """Moments, median and zeros; the exact median comes from ranges of counted values."""
    v = F.col(value)
    (median,) = quantiles(arms, value, (0.5,))
    return arms.agg(F.count(v).alias("n"), F.min(v).alias("least"), F.max(v).alias("most"), F.avg(v).alias("mean"), F.lit(median).cast("double").alias("median"), F.stddev_pop(v).alias("std"), F.count_if(v == 0).alias("zeros"))


def group_sizes(df: DataFrame, key: str) -> DataFrame:
    sizes = df.groupBy(key).count()
    return sizes.agg(F.count("*").alias("groups"), F.count_if(F.col("count") == 1).alias("single"), F.count_if(F.col("count") > 1).alias("multi"), F.max("count").alias("largest"))


def winner_agreement(arms: DataFrame, value: str, flag: str, key: str = "test_id") -> DataFrame:
    """How often the row of the largest value carries flag, over groups of more than one row."""
    rows = multi_row_groups(arms, key).withColumn("__best", best_flag(key, value)).where("__best = 1")
    return rows.agg(F.count("*").alias("groups"), F.count_if(F.col(flag)).alias("agree"), F.coalesce(F.try_divide(F.count_if(F.col(flag)), F.count("*")), F.lit(0.0)).alias("rate"))


def winner_disagreements(arms: DataFrame, value: str, flag: str, text: str, key: str = "test_id", order: str = "row_ord", most: int = 60) -> DataFrame:
    """(key, best_value, flagged_value, flagged_text) of each group of more than one row whose row of the largest value lacks flag.

    Of equal values the first row in order is the best, of several flagged rows the first is taken, and groups without
    a flagged row are left out. Null values are never best; a null text is 'N/A', longer ones are cut to most characters.
    Rows are reduced by partial aggregates, so that a large group is not gathered.
    """
    best = F.min(F.when(F.col(value).isNotNull(), F.struct((-F.col(value)).alias("v"), F.col(order).alias("o"), F.coalesce(F.col(flag), F.lit(False)).alias("f"))))
    flagged = F.min(F.when(F.col(flag), F.struct(F.col(order).alias("o"), F.col(value).alias("v"), F.col(text).alias("t"))))
    found = arms.groupBy(key).agg(F.count("*").alias("n"), best.alias("best"), flagged.alias("flagged")).where("n > 1 AND NOT best.f AND flagged IS NOT NULL")
    return found.select(key, (-F.col("best.v")).alias("best_value"), F.col("flagged.v").alias("flagged_value"), F.coalesce(F.substring("flagged.t", 1, most), F.lit("N/A")).alias("flagged_text"))


def distinct_profile(df: DataFrame, key: str, value: Column) -> DataFrame:
    """Distinct values by group, profiled over groups with more than one."""
    counts = df.groupBy(key).agg(F.countDistinct(value).alias("n"))
    many = F.when(F.col("n") > 1, F.col("n"))
    return counts.agg(F.count("*").alias("groups"), F.count(many).alias("varied"), F.mean(many).alias("mean"), F.median(many).alias("median"), F.min(many).alias("least"), F.max(many).alias("most"))


def number_profile(df: DataFrame, value: Column, percents: tuple[float, ...] = (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)) -> DataFrame:
    """Exact percentiles by linear interpolation, with moments. The value is computed once for each row and counted, so the percentiles take distinct values with their counts."""
    counts = df.select(value.alias("v")).groupBy("v").agg(F.count("*").alias("k"))
    v, k = F.col("v"), F.col("k")
    n = F.coalesce(F.sum(F.when(v.isNotNull(), k)), F.lit(0))
    mean = F.try_divide(F.sum(v * k), n)
    spread = F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.sum(v.cast("double") * v * k), n) - mean * mean))
    cols = [n.alias("n"), mean.alias("mean"), spread.alias("std"), F.min(v).alias("least"), F.max(v).alias("most")]
    shares = F.percentile("v", F.array(*[F.lit(float(p)) for p in percents]), k).alias("ps")
    names = [F.col("ps")[i].alias(f"p{round(p * 100)}") for i, p in enumerate(percents)]
    return counts.agg(*cols, shares).select("n", "mean", "std", "least", "most", *names)


def exceedance(df: DataFrame, value: Column, limits: list[float]) -> DataFrame:
    """(limit, n, percent) of values strictly above each limit, in one pass."""
    total = F.count("*")
    rows = F.array(*[F.struct(F.lit(float(x)).alias("limit"), F.count_if(value > x).alias("n"), (100.0 * F.count_if(value > x) / total).alias("percent")) for x in limits])
    return df.agg(rows.alias("rows")).select(F.inline("rows"))


def fixed_bins(df: DataFrame, value: Column, edges: list[float]) -> DataFrame:
    """(low, high, n) for bins [low, high), the last without end."""
    bins = [(a, b) for a, b in zip(edges, [*edges[1:], None], strict=True)]
    rows = F.array(*[F.struct(F.lit(float(a)).alias("low"), F.lit(None if b is None else float(b)).cast("double").alias("high"), F.count_if((value >= a) & (F.lit(True) if b is None else value < b)).alias("n")) for a, b in bins])
    return df.agg(rows.alias("rows")).select(F.inline("rows"))


def label_distribution(df: DataFrame, label: str) -> DataFrame:
    """(label, n, share) of each value."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    return counts.select("label", "n", (F.col("n") / F.sum("n").over(W.partitionBy())).alias("share"))


def cluster_sizes(df: DataFrame) -> DataFrame:
    """(cluster, n_train, n_test, n) of rows (cluster, part)."""
    train = F.count_if(F.col("part") == "train")
    return df.groupBy("cluster").agg(train.alias("n_train"), (F.count("*") - train).alias("n_test"), F.count("*").alias("n"))


def with_segment(df: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    """df with the segment of its key, -1 for keys that mapping (key, segment) lacks."""
    return df.join(mapping.select(key, "segment"), key, "left").withColumn("segment", F.coalesce("segment", F.lit(-1)))


def segment_stats(df: DataFrame, least: int = 0) -> DataFrame:
    """(segment, n_train, n_test, mean, std) of y over each segment's training rows (segment, part, y); smaller segments than least are left out."""
    train = F.when(F.col("part") == "train", F.col("y"))
    stats = df.groupBy("segment").agg(F.count(train).alias("n_train"), F.count_if(F.col("part") != "train").alias("n_test"), F.avg(train).alias("mean"), F.stddev_pop(train).alias("std"))
    return stats.where(f"n_train >= {least}")
