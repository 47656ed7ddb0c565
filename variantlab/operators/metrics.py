"""Weighted and unweighted metrics of predictions (y, p, score, w), as aggregates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .ordered import ranged


def accuracy(y: Column, p: Column, w: Column) -> list[Column]:
    hit = (y == p).cast("double")
    return [F.avg(hit).alias("accuracy"), (F.sum(w * hit) / F.sum(w)).alias("weighted_accuracy")]


def f1_of(y: Column, p: Column, label: int) -> Column:
    """F1 of one class, 0 where nothing is of the class and nothing predicted."""
    both, either = F.count_if((y == label) & (p == label)), F.count_if(y == label) + F.count_if(p == label)
    return F.coalesce(F.try_divide(2.0 * both, either.cast("double")), F.lit(0.0))


def _classified() -> list[Column]:
    y, p, w = F.col("y"), F.col("p"), F.col("w")
    one, zero = f1_of(y, p, 1), f1_of(y, p, 0)
    return [*accuracy(y, p, w), one.alias("f1_binary"), ((one + zero) / 2).alias("f1_macro")]


def classification(df: DataFrame) -> DataFrame:
    return df.agg(*_classified())


def classification_by(df: DataFrame, key: str) -> DataFrame:
    """(key, n, classification's metrics, auc) of each value of key; auc is null with one class."""
    found = df.groupBy(key).agg(F.count("*").alias("n"), *_classified())
    areas = weighted_auc_by(df, key).select(F.col(key).alias("__key"), "auc")
    return found.join(areas, F.col(key).eqNullSafe(F.col("__key")), "left").drop("__key")


def report(df: DataFrame) -> DataFrame:
    """(label, precision, recall, f1, support) of both classes, in one pass."""
    y, p = F.col("y"), F.col("p")
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    rows = [F.struct(F.lit(c).alias("label"), share(F.count_if((y == c) & (p == c)), F.count_if(p == c)).alias("precision"), share(F.count_if((y == c) & (p == c)), F.count_if(y == c)).alias("recall"), f1_of(y, p, c).alias("f1"), F.count_if(y == c).alias("support")) for c in (0, 1)]
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def weighted_auc(df: DataFrame) -> DataFrame:
    """Area under the weighted ROC curve, tied scores as one step; null with one class."""
    return weighted_auc_by(df.withColumn("__all", F.lit(0)), "__all").agg(F.max("auc").alias("auc"))


def weighted_auc_by(df: DataFrame, key: str) -> DataFrame:
    """(key, auc) of each value of key, as weighted_auc. Scores are summed, then dealt into ranges of key and score; each range
    gives an area for each key in it, and what lies below it is added from the few rows of the ranges."""
    steps = df.groupBy(F.col(key).alias("key"), F.col("score").cast("double").alias("score")).agg(F.sum(F.when(F.col("y") == 1, F.col("w")).otherwise(0.0)).cast("double").alias("pos"), F.sum(F.when(F.col("y") == 1, 0.0).otherwise(F.col("w"))).cast("double").alias("neg"))
    names = ("first", "pos", "neg", "area")

    def run(batches):
        done, open_key, at = [], None, None
        for batch in batches:
            keys = batch.column("key").to_pylist()
            score, pos, neg = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("score", "pos", "neg"))
            cuts = [k for k in range(len(keys)) if k == 0 or keys[k] != keys[k - 1]]
            for a, b in zip(cuts, [*cuts[1:], len(keys)], strict=True):
                if at is None or keys[a] != open_key:
                    open_key, at = keys[a], [float(score[a]), 0.0, 0.0, 0.0]
                    done.append((open_key, at))
                p, n = pos[a:b], neg[a:b]
                at[3] += float((p * (at[2] + np.cumsum(n) - n / 2)).sum())
                at[1], at[2] = at[1] + float(p.sum()), at[2] + float(n.sum())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], kind), *[pa.array([x[i] for _, x in done], pa.float64()) for i in range(4)]], names=["key", *names])

    kind = to_arrow_type(steps.schema["key"].dataType)
    rows = ranged(steps, "key", "score").mapInArrow(run, f"key {steps.schema['key'].dataType.simpleString()}, first double, pos double, neg double, area double")
    below = F.coalesce(F.sum("neg").over(W.partitionBy("key").orderBy("first").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    return rows.withColumn("area", F.col("area") + F.col("pos") * below).groupBy(F.col("key").alias(key)).agg(F.try_divide(F.sum("area"), F.sum("pos") * F.sum("neg")).alias("auc"))


def deltas(metrics: DataFrame, base: str) -> DataFrame:
    """(model, metric, delta): each model's metrics (model, ..) less those of the model base."""
    names = [c for c in metrics.columns if c != "model"]
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names])).alias("m")
    long = metrics.select("model", cells).select("model", "m.metric", "m.value")
    own = long.where(F.col("model") == base).select("metric", F.col("value").alias("base"))
    return long.where(F.col("model") != base).join(own, "metric").select("model", "metric", (F.col("value") - F.col("base")).alias("delta"))


def regression(df: DataFrame) -> DataFrame:
    """R2, MAE and RMSE of (y, p), and R2 weighted by w. Sums are enough, so there is one pass."""
    y, w, e = F.col("y"), F.col("w"), F.col("y") - F.col("p")
    spread = F.sum(y * y) - F.sum(y) * F.sum(y) / F.count("*")
    weighted = F.sum(w * y * y) - F.sum(w * y) * F.sum(w * y) / F.sum(w)
    return df.agg((1 - F.sum(e * e) / spread).alias("r2"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (1 - F.sum(w * e * e) / weighted).alias("weighted_r2"))


def leaf_r2(df: DataFrame, least: int = 10) -> DataFrame:
    """R2 of each leaf (leaf, y, p) with more than least rows, else null."""
    e = F.col("y") - F.col("p")
    spread = F.sum(F.col("y") * F.col("y")) - F.sum("y") * F.sum("y") / F.count("*")
    return df.groupBy("leaf").agg(F.count("*").alias("n"), F.when(F.count("*") > least, 1 - F.try_divide(F.sum(e * e), spread)).alias("r2"))
