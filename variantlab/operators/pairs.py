"""Pairs of arms within tests, sampled and oriented by hash, with labels, targets and weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import rates
from ..functions.text import filled

ARM = ("id", "headline", "ctr", "clicks", "impressions")


def _arm(arms: DataFrame, end: str) -> DataFrame:
    cols = [F.col("local_idx").alias(f"id_{end}")] + [F.col(c).alias(f"{c}_{end}") for c in ARM[1:]]
    return arms.select("test_id", *cols)


def all_pairs(arms: DataFrame) -> DataFrame:
    """All i < j pairs of a test with different rates and texts on both sides. A test has few arms, so the join is small by key."""
    fine = arms.where(filled(F.col("headline")) & F.col("test_id").isNotNull())
    pairs = _arm(fine, "first").join(_arm(fine, "second"), "test_id").where("id_first < id_second")
    return pairs.where("ctr_first <> ctr_second")


def pair_hash(seed: int, *columns: str) -> Column:
    """An md5 over the seed and the columns; it does not depend on the engine."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def sample_pairs(pairs: DataFrame, most: int | None, seed: int = 42) -> DataFrame:
    """At most most pairs of each test, chosen by hash; 0 or None keeps all."""
    if not most:
        return pairs
    order = W.partitionBy("test_id").orderBy(pair_hash(seed, "test_id", "id_first", "id_second"), "id_first", "id_second")
    return pairs.withColumn("__n", F.row_number().over(order)).where(f"__n <= {most}").drop("__n")


def orient(pairs: DataFrame, seed: int = 42) -> DataFrame:
    """Swaps first and second where the last hexadecimal digit of the pair's hash is odd."""
    odd = F.conv(F.substring(pair_hash(seed + 1, "test_id", "id_first", "id_second"), 32, 1), 16, 10).cast("int") % 2 == 1
    swap = pairs.withColumn("__odd", odd)
    cols = []
    for c in ARM:
        a, b = F.col(f"{c}_first"), F.col(f"{c}_second")
        cols += [F.when(F.col("__odd"), b).otherwise(a).alias(f"{c}_first"), F.when(F.col("__odd"), a).otherwise(b).alias(f"{c}_second")]
    return swap.select("test_id", *cols)


def weighted(pairs: DataFrame) -> DataFrame:
    """pairs with better_label, the three weights, the logit target and its smoothed form."""
    ca, cb = F.col("ctr_first"), F.col("ctr_second")
    na, nb, ia, ib = (F.col(c) for c in ("clicks_first", "clicks_second", "impressions_first", "impressions_second"))
    return pairs.withColumns({
        "better_label": (ca > cb).cast("int"),
        "weight_diff": rates.weight_diff(ca, cb),
        "weight_logit": rates.weight_logit(ca, cb),
        "weight_beta": rates.weight_beta(na, ia, nb, ib),
        "target_logit_diff": rates.signed_target(ca, cb),
        "target_smoothed": rates.smoothed_target(na, ia, nb, ib),
        "weight_sqrt_min_impr": rates.sqrt_least_impressions(ia, ib),
    })


def enriched(pairs: DataFrame, arms: DataFrame) -> DataFrame:
    """Counts of both arms looked up by (test_id, local_idx). A pair without both keeps target 0 and weight 0, flagged in is_miss."""
    a = arms.select("test_id", F.col("local_idx").alias("id_first"), F.col("clicks").alias("ca"), F.col("impressions").alias("ia"), F.col("ctr").alias("ra"))
    b = arms.select("test_id", F.col("local_idx").alias("id_second"), F.col("clicks").alias("cb"), F.col("impressions").alias("ib"), F.col("ctr").alias("rb"))
    joined = pairs.select("test_id", "id_first", "id_second").join(a, ["test_id", "id_first"], "left").join(b, ["test_id", "id_second"], "left")
    miss = F.col("ra").isNull() | F.col("rb").isNull()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return joined.select(
        "test_id", "id_first", "id_second", zero("ca").alias("clicks_first"), zero("cb").alias("clicks_second"), zero("ia").alias("impressions_first"), zero("ib").alias("impressions_second"),
        F.when(miss, 0.0).otherwise(rates.signed_target(F.col("ra"), F.col("rb"))).alias("target_logit_diff"),
        F.when(miss, 0.0).otherwise(rates.sqrt_least_impressions(F.col("ia"), F.col("ib"))).alias("weight_sqrt_min_impr"), miss.alias("is_miss"),
    )


def headline_lookup(keys: DataFrame, arms: DataFrame) -> DataFrame:
    """keys (test_id, local_idx, ..) with the headline, <unknown> where there is none."""
    return keys.join(arms.select("test_id", "local_idx", "headline"), ["test_id", "local_idx"], "left").withColumn("headline", F.coalesce("headline", F.lit("<unknown>")))


def best_worst_pairs(arms: DataFrame) -> DataFrame:
    """One pair of the best and the worst arm of each test that has both, with texts."""
    from .arms import best_and_worst

    ends = best_and_worst(arms)
    best, worst = _arm(ends.where("role = 'best'"), "first"), _arm(ends.where("role = 'worst'"), "second")
    return best.join(worst, "test_id").where(filled(F.col("headline_first")) & filled(F.col("headline_second")))


def mirrored(vectors: DataFrame) -> DataFrame:
    """Long-form deltas (pair_id, feature, value) twice: as they are with label 1 and negated with label 0."""
    both = F.explode(F.array(F.lit(1), F.lit(-1))).alias("sign")
    return vectors.select("*", both).withColumn("value", F.col("value") * F.col("sign")).withColumn("label", (F.col("sign") == 1).cast("int"))
