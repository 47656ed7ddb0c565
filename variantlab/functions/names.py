"""Feature spaces and feature names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def space(feature: Column, width: int) -> Column:
    """Features below width are of the context space, the others of the diff space."""
    return F.when(feature >= width, "diff").otherwise("ctx")


def space_index(feature: Column, width: int) -> Column:
    return feature % width


def named(features: DataFrame, names: DataFrame, width: int, style: str = "under", length: int = 60) -> DataFrame:
    """features (feature, ..) with a name from names (index, description), left joined; styles: under, colon, plain."""
    sub = space_index(F.col("feature"), width)
    text = F.substring(F.coalesce("description", F.lit("")), 1, length)
    prefix = space(F.col("feature"), width)
    forms = {
        "under": F.concat_ws("_", prefix, sub.cast("string"), text),
        "colon": F.concat(prefix, F.lit("_f"), sub.cast("string"), F.lit(": "), text),
        "plain": F.concat(F.lit("f_"), sub.cast("string"), F.lit(": "), text),
    }
    joined = features.withColumn("index", sub).join(names.select("index", "description"), "index", "left")
    return joined.withColumn("name", forms[style]).drop("description").withColumnRenamed("index", "space_index")


def missing_names(features: DataFrame, names: DataFrame, width: int) -> DataFrame:
    joined = features.select(space_index(F.col("feature"), width).alias("index")).join(names, "index", "left")
    return joined.agg(F.count_if(F.col("description").isNull()).alias("missing"), F.count("*").alias("features"))


def dashboard_url(base: str, feature: Column) -> Column:
    return F.format_string(base + "/%d", feature.cast("long"))
