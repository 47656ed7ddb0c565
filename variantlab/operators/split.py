"""Leak-free splits by group and checks on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def hash_share(key: Column, seed: int = 42) -> Column:
    """A number in [0, 1) that the key and the seed decide: the first 12 hexadecimal digits of an md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string"))), 1, 12), 16, 10).cast("double") / float(16**12)


def group_split(df: DataFrame, key: str, test: float = 0.2, validation: float = 0.0, seed: int = 42) -> DataFrame:
    """df with part (train, validation, test) of each row's group; about these shares of groups. No sort or collect of groups is needed."""
    share = hash_share(F.col(key), seed)
    return df.withColumn("part", F.when(share < test, "test").when(share < test + validation, "validation").otherwise("train"))


def exact_group_split(df: DataFrame, key: str, test: float = 0.2, seed: int = 42) -> DataFrame:
    """As group_split, with exactly ceil(test * groups) test groups: the hash of that rank is the cut. Groups are ranked by a range sort."""
    shares = df.select(key).distinct().select(hash_share(F.col(key), seed).alias("s"))
    cut = shares.agg(F.percentile_disc(F.lit(test)).withinGroup(F.asc("s")) if hasattr(F, "percentile_disc") else F.expr(f"percentile_disc({test}) WITHIN GROUP (ORDER BY s)")).first()[0]
    return df.withColumn("part", F.when(hash_share(F.col(key), seed) <= F.lit(cut), "test").otherwise("train"))


def leaking_groups(df: DataFrame, key: str) -> DataFrame:
    """Groups with rows in more than one part: there must be none."""
    return df.groupBy(key).agg(F.countDistinct("part").alias("parts")).where("parts > 1")


def assert_no_leak(df: DataFrame, key: str) -> None:
    found = leaking_groups(df, key).limit(3).collect()
    if found:
        raise ValueError(f"groups in several parts: {[r[0] for r in found]}")
