"""Helpers that the operators share: the shared folder, stored tables, size-checked joins and components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A stored table of at most this many rows and bytes (as written, compressed) may be broadcast.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 24 << 20


_OWN: dict[str, str] = {}
_STORED = "_stored_at"


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset and all runs in one process, as in tests, a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path
    if not spark.sparkContext.master.partition("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="variantlab-")
    return _OWN[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read from there: lineage ends, executors may be lost."""
    spark = df.sparkSession
    path = new_path(spark, name)
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(schema).parquet(path)
    setattr(out, _STORED, path)
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store, if it is there."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def dropped(df: DataFrame) -> None:
    """Deletes a stored table that nothing reads any more."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        remove(df.sparkSession, folder)


def small(table: DataFrame) -> bool:
    """Whether a table that stored() returned is within both bounds; rows come from the files' footers."""
    spark, path = table.sparkSession, getattr(table, _STORED)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    size = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    return size <= BROADCAST_BYTES and table.count() <= BROADCAST_ROWS


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df lacks, whatever the case of its own: the given ones, longer where they are taken."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def keyed(df: DataFrame, keys: DataFrame, on: str | list[str], how: str) -> DataFrame:
    """A join with keys that broadcasts them only where they are stored and small; else both sides are shuffled. Keys that are not stored yet are."""
    keys = keys if hasattr(keys, _STORED) else stored(keys, "keys")
    return df.join(F.broadcast(keys) if small(keys) else keys, on, how)


def picked(rows: DataFrame, numbers: DataFrame, on: str, keep: bool = True) -> DataFrame:
    """The rows whose number (column on: 0 or more, numbered as they lie) is among numbers (column on); with keep=False, the others.

    Rows are not shuffled, however many the numbers: these go to them as bits, 64 to a word, and words beyond BROADCAST_ROWS
    go in ranges, each to the rows of its range.
    """
    word, bits = fresh(rows, "word", "bits")
    at, bit = F.expr(f"shiftright({on}, 6)"), F.expr(f"CAST({on} & 63 AS int)")
    words = stored(numbers.groupBy(at.alias(word)).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST({on} & 63 AS int))")).alias(bits)), "bits")
    parts = -(-words.count() // max(1, BROADCAST_ROWS))
    cuts = [int(x) for x in words.approxQuantile(word, [k / parts for k in range(1, parts)], 0.1 / parts)] if parts > 1 else []
    out = None
    for low, high in zip([0, *cuts], [*cuts, 1 << 57], strict=True):
        inside = rows.where(F.col(on).between(low << 6, (high << 6) - 1)).withColumn(word, at) if cuts else rows.withColumn(word, at)
        met = inside.join(F.broadcast(words.where(F.col(word).between(low, high - 1))), word, "inner" if keep else "left")
        found = met.where(F.coalesce(F.getbit(bits, bit), F.lit(0)) == int(keep)).drop(word, bits)
        out = found if out is None else out.unionByName(found)
    return out


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b) as (node, root): root is the smallest node reachable.

    Alternates large-star and small-star steps, so the rounds grow with the logarithm of the longest chain.
    Neighbours are never gathered: each step takes minima with a partial aggregate and joins them back.
    """
    state = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        mark = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        both = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        after = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(joined.select("a", F.col("m").alias("b")))
        after = stored(after.where("a <> b").distinct(), "edges")
        dropped(state)
        state = after
    roots = state.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.unionByName(state.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def word_text(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))
