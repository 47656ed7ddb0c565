"""Interpretable models through Spark ML: linear, trees, boosting, clusters; features enter as sparse vectors."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.types import StructField, StructType


def assembled(vectors: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """rows (pair_id, ..) with a sparse vector column features; rows without values get an empty vector. Cells are sorted in the JVM and become vectors in Arrow batches."""
    names = rows.columns

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            vector = pa.StructArray.from_arrays([pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, width, np.int32)), batch.column("__index"), batch.column("__value")], names=["type", "size", "indices", "values"])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], vector], names=[*names, "features"])

    cell = F.struct(F.col("feature").cast("int").alias("f"), F.col("value").cast("double").alias("v"))
    cells = vectors.groupBy("pair_id").agg(F.array_sort(F.collect_list(cell)).alias("__cells"))
    lists = rows.join(cells, "pair_id", "left").withColumn("__cells", F.coalesce("__cells", F.array().cast("array<struct<f:int,v:double>>")))
    lists = lists.select(*names, F.col("__cells.f").alias("__index"), F.col("__cells.v").alias("__value"))
    return lists.mapInArrow(run, StructType([*rows.schema, StructField("features", VectorUDT())]))


def logistic(train: DataFrame, l2: float = 1e-4, tol: float = 1e-4):
    return LogisticRegression(labelCol="y", weightCol="w", regParam=l2, elasticNetParam=0.0, maxIter=200, tol=tol, standardization=False).fit(train)


def tree(train: DataFrame, depth: int = 8, leaf: int = 20):
    return DecisionTreeClassifier(labelCol="y", weightCol="w", maxDepth=depth, minInstancesPerNode=leaf, seed=42).fit(train)


def boosted(train: DataFrame, trees: int = 100, depth: int = 6, rate: float = 0.1, columns: str = "all", rows: float = 1.0):
    """Boosted trees; columns is the share of features tried at each node (not each tree). Stumps: depth 1."""
    return GBTClassifier(labelCol="y", weightCol="w", maxIter=trees, maxDepth=depth, stepSize=rate, featureSubsetStrategy=columns, subsamplingRate=rows, seed=42).fit(train)


def lasso(train: DataFrame, alpha: float = 0.01):
    """Weighted squared error over twice the weight, plus alpha times the absolute coefficients."""
    return LinearRegression(labelCol="y", weightCol="w", regParam=alpha, elasticNetParam=1.0, standardization=False, maxIter=500).fit(train)


def scored(model, rows: DataFrame) -> DataFrame:
    """rows with p and score."""
    out = model.transform(rows)
    return out.select(*rows.columns, F.col("prediction").cast("int").alias("p"), vector_to_array("probability")[1].alias("score"))


def by_cluster(train: DataFrame, test: DataFrame, fit, clusters: list[int]) -> DataFrame:
    """Predictions of one model for each cluster; a cluster of one class predicts that class. The clusters are few (k of k-means)."""
    parts = None
    share = {r["cluster"]: r["m"] for r in train.groupBy("cluster").agg(F.avg("y").alias("m")).collect()}
    for c in clusters:
        rest, m = test.where(F.col("cluster") == c), share.get(c)
        if m is None or m in (0.0, 1.0):
            level = float(m or 0.0)
            out = rest.withColumn("p", F.lit(int(level))).withColumn("score", F.lit(level))
        else:
            out = scored(fit(train.where(F.col("cluster") == c)), rest)
        parts = out if parts is None else parts.unionByName(out)
    return parts


def importances(model) -> list[tuple[int, float]]:
    """(feature, importance) of features that a tree model uses."""
    v = model.featureImportances
    return [(int(i), float(x)) for i, x in zip(v.indices, v.values, strict=True) if x]


def coefficients(spark: SparkSession, models: dict[str, object]) -> DataFrame:
    """(model, feature, coef) of fitted linear models; sparse.active_features and sparse.coefficient_spread take it."""
    cells = [(name, j, float(c)) for name, m in models.items() for j, c in enumerate(m.coefficients.toArray())]
    return spark.createDataFrame(cells, "model string, feature int, coef double")


_IF = re.compile(r"(If|Else) \(feature (\d+) (<=|>) (-?[\d.eE+-]+)\)")


def rule_paths(debug: str) -> list[tuple[tuple[int, str, float], ...]]:
    """All paths (feature, operator, cut) to inner nodes and leaves of a printed tree, without the root's empty one."""
    path: list[tuple[int, tuple[int, str, float]]] = []
    found = []
    for line in debug.split("\n"):
        m = _IF.search(line)
        if not m:
            continue
        depth = len(line) - len(line.lstrip())
        while path and path[-1][0] >= depth:
            path.pop()
        path.append((depth, (int(m[2]), m[3], float(m[4]))))
        found.append(tuple(p for _, p in path))
    return list(dict.fromkeys(found))


def path_predicate(values: Column, path: tuple[tuple[int, str, float], ...]) -> Column:
    """Whether an array of values, implicit zeros written out, meets all conditions of a path."""
    met = F.lit(True)
    for feature, op, cut in path:
        v = values[feature]
        met = met & {"<=": v <= cut, ">": v > cut, "<": v < cut, ">=": v >= cut}[op]
    return met


def path_score(values: Column, scales: list[float], path: tuple[tuple[int, str, float], ...]) -> Column:
    """The signed sum of scaled values along a path: positive where above a cut is asked for."""
    total = F.lit(0.0)
    for feature, op, _ in path:
        part = values[feature] / max(scales[feature], 1e-10)
        total = total + part if op in (">", ">=") else total - part
    return total


def normalised(rows: DataFrame) -> DataFrame:
    return Normalizer(inputCol="features", outputCol="unit", p=2.0).transform(rows).drop("features").withColumnRenamed("unit", "features")


def _entries(batch: pa.RecordBatch, column: str = "features") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) of a batch of vectors, sparse or dense."""
    vectors = batch.column(column)
    kind, index, value = (vectors.field(c) for c in ("type", "indices", "values"))
    count = np.asarray(value.value_lengths())
    row = np.repeat(np.arange(batch.num_rows), count)
    dense = np.repeat(np.asarray(kind) == 1, count)
    feature = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    feature[~dense] = np.asarray(index.flatten())
    return row, feature, np.asarray(value.flatten())


def _times(rows: DataFrame, basis: np.ndarray, gram: bool) -> np.ndarray:
    """A'A basis, or basis' A'A basis if gram, for the matrix A of rows' features: one pass, sums of tasks are added up in Spark.

    A batch is multiplied column by column of the basis, which travels with the task: features times its columns numbers."""
    width, k = basis.shape

    def run(batches):
        total = np.zeros((k if gram else width, k))
        for batch in batches:
            row, feature, value = _entries(batch)
            y = np.stack([np.bincount(row, weights=value * basis[feature, j], minlength=batch.num_rows) for j in range(k)], axis=1)
            if gram:
                total += y.T @ y
            else:
                for j in range(k):
                    total[:, j] += np.bincount(feature, weights=value * y[row, j], minlength=width)
        at = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(list(total[at]), pa.list_(pa.float64()))], names=["at", "v"])

    sums = rows.select("features").mapInArrow(run, "at int, v array<double>")
    out = np.zeros((k if gram else width, k))
    for r in sums.groupBy("at").agg(F.array(*[F.sum(F.col("v")[j]) for j in range(k)]).alias("v")).collect():
        out[r.at] = r.v
    return out


#: Vectors beyond the wanted ones, and power steps, of the randomised range finder.
SPARE, STEPS = 10, 8


def right_vectors(rows: DataFrame, k: int, seed: int = 7) -> tuple[DataFrame, list[float], float]:
    """The k leading right singular vectors (feature, v) of uncentred rows, v an array, the singular values, and the share of the squared norm that they explain.

    A random basis is multiplied by A'A and made orthogonal again, STEPS times; the small matrix of what A does to it has
    the singular values and turns it to the vectors. The driver holds features times (k + SPARE) numbers.
    """
    first = rows.select(F.col("features")).first()
    width = first[0].size if first else 0
    size = min(width, k + SPARE)
    basis = np.random.default_rng(seed).standard_normal((width, size))
    for _ in range(STEPS if size else 0):
        basis, _ = np.linalg.qr(_times(rows, basis, False))
    level, turn = np.linalg.eigh(_times(rows, basis, True)) if size else (np.zeros(0), np.zeros((0, 0)))
    order = np.argsort(level)[::-1][:k]
    values = np.sqrt(np.maximum(level[order], 0)).tolist()
    v = basis @ turn[:, order]
    table = rows.sparkSession.createDataFrame([(j, [float(x) for x in r]) for j, r in enumerate(v)], "feature int, v array<double>")
    total = _squares(rows)
    return table, values, sum(s * s for s in values) / total if total else 0.0


def _squares(rows: DataFrame) -> float:
    return rows.select(F.aggregate(vector_to_array("features"), F.lit(0.0), lambda a, x: a + x * x).alias("q")).agg(F.sum("q")).first()[0] or 0.0


def reduced(rows: DataFrame, k: int) -> tuple[DataFrame, list[float]]:
    """rows (pair_id, features) projected on the k leading right singular vectors, uncentred, with the singular values."""
    table, values, _ = right_vectors(rows, k)
    return projected(rows, table, len(values)), values


def projected(rows: DataFrame, table: DataFrame, k: int) -> DataFrame:
    """rows with features times the vectors of table (feature, v); a row of zeros stays one of zeros."""
    cells = rows.select("pair_id", F.posexplode(vector_to_array("features")).alias("feature", "value")).where("value <> 0")
    sums = cells.join(table, "feature").groupBy("pair_id").agg(F.array(*[F.sum(F.col("value") * F.col("v")[j]) for j in range(k)]).alias("sums"))
    zeros = F.array(*[F.lit(0.0)] * k)
    return rows.drop("features").join(sums, "pair_id", "left").withColumn("features", array_to_vector(F.coalesce("sums", zeros))).drop("sums")


def clustered(train: DataFrame, k: int = 10, starts: int = 10):
    """The k-means model of least cost over several starts."""
    fits = [KMeans(k=k, seed=s, maxIter=50).fit(train) for s in range(starts)]
    return min(fits, key=lambda m: m.summary.trainingCost)


def regression_tree(train: DataFrame, depth: int, leaf: int, features: str = "features", label: str = "y", gain: float = 0.0):
    return DecisionTreeRegressor(featuresCol=features, labelCol=label, weightCol="w", maxDepth=depth, minInstancesPerNode=leaf, minInfoGain=gain, leafCol="leaf", seed=42).fit(train)


def segmented(train: DataFrame, rows: DataFrame, depth: int = 4, leaf: int = 200, gain: float = 0.001) -> tuple[DataFrame, DataFrame]:
    """Segments of rows by a tree of train's residuals on the context: (rows with segment, mapping of leaf to segment).

    Both tables have context (a vector), residual and w; segments are the leaves that train reaches, numbered from 0,
    and rows of any other leaf are in segment -1.
    """
    model = regression_tree(train, depth, leaf, "context", "residual", gain)
    leaves = lambda df: model.transform(df).drop("prediction")
    found = leaves(train).select("leaf").distinct()
    mapping = found.select("leaf", (F.row_number().over(W.orderBy("leaf")) - 1).alias("segment"))  # at most 2^depth leaves
    return leaves(rows).join(mapping, "leaf", "left").withColumn("segment", F.coalesce("segment", F.lit(-1))), mapping


def segment_trees(train: DataFrame, test: DataFrame, depth: int = 3, leaf: int = 50, least: int = 50) -> DataFrame:
    """(segment, n_train, n_test, train_r2, test_r2) of a tree of y on the features for each segment with at least least training rows; test_r2 is null for 10 test rows or fewer."""
    sizes = {r["segment"]: r["count"] for r in train.groupBy("segment").count().collect()}  # at most 2^depth segments
    parts = None
    for segment in sorted(s for s, n in sizes.items() if n >= least):
        own = train.where(F.col("segment") == segment)
        model = regression_tree(own.drop("leaf"), depth, leaf)
        scored = lambda df, part: model.transform(df.drop("leaf")).select("y", F.col("prediction").alias("p"), F.lit(part).alias("part"))
        both = scored(own, "train").unionByName(scored(test.where(F.col("segment") == segment), "test"))
        fits = both.groupBy("part").agg(F.count("*").alias("n"), (1 - F.try_divide(F.sum((F.col("y") - F.col("p")) ** 2), F.sum(F.col("y") ** 2) - F.sum("y") ** 2 / F.count("*"))).alias("r2"))
        pick = lambda part, c: F.max(F.when(F.col("part") == part, F.col(c)))
        row = fits.agg(F.lit(segment).alias("segment"), pick("train", "n").alias("n_train"), F.coalesce(pick("test", "n"), F.lit(0)).alias("n_test"), pick("train", "r2").alias("train_r2"), pick("test", "r2").alias("test_r2"))
        row = row.withColumn("test_r2", F.when(F.col("n_test") > 10, F.col("test_r2")))
        parts = row if parts is None else parts.unionByName(row)
    return parts if parts is not None else train.sparkSession.createDataFrame([], "segment int, n_train long, n_test long, train_r2 double, test_r2 double")


def top_splits(debug: str, levels: int = 4) -> list[tuple[int, int, float]]:
    """(depth, feature, cut) of the first levels of a printed tree."""
    paths = [p for p in rule_paths(debug) if len(p) <= levels and p[-1][1] == "<="]
    return [(len(p) - 1, p[-1][0], p[-1][2]) for p in paths]
