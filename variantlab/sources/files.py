"""Sources and sinks: CSV packages, sharded sparse tables, importances, metrics, names and kept artifacts."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

_OWN: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir; where that is unset and all runs in one process, in a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = _OWN.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="variantlab-"))
    return f"{path}/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store, if it is there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with header, quotes and line breaks in quotes, with a stated schema."""
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, quote='"', escape='"')


def quoted_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, record, value): records of quoted text by number, line breaks within quotes kept; any number of tasks share a file.

    Lines are read by byte ranges, whose order is known. A line begins a record if the quotes before it are even: those
    of earlier ranges come from a sum for each range, those of its own from a running sum. Lines that are a record go on
    as they are; only pieces of longer records are brought together.
    """
    at = scratch(spark, "lines")
    found = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"), F.monotonically_increasing_id().alias("place"), "value")
    found.withColumn("quotes", F.char_length("value") - F.char_length(F.replace("value", F.lit('"'), F.lit("")))).write.parquet(at)
    lines = spark.read.parquet(at)

    def before(rows: DataFrame, column: str, name: str) -> DataFrame:
        """The sum of column over a file's earlier ranges, of which there is a row each."""
        sums = rows.groupBy("file", "range").agg(F.sum(column).alias(name))
        return sums.select("file", "range", (F.sum(name).over(W.partitionBy("file").orderBy("range")) - F.col(name)).alias(name))

    own = W.partitionBy("file", "range").orderBy("place")
    lines = lines.join(F.broadcast(before(lines, "quotes", "earlier")), ["file", "range"])
    lines = lines.withColumn("begins", ((F.col("earlier") + F.sum("quotes").over(own) - F.col("quotes")) % 2 == 0).cast("int"))
    lines = lines.join(F.broadcast(before(lines, "begins", "records")), ["file", "range"]).withColumn("record", F.col("records") + F.sum("begins").over(own))
    whole = (F.col("begins") == 1) & (F.col("quotes") % 2 == 0)
    pieces = lines.where(~whole).groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("range", "place", "value"))).alias("parts"))
    joined = pieces.select("file", "record", F.array_join(F.col("parts.value"), "\n").alias("value"))
    return lines.where(whole).select("file", "record", "value").unionByName(joined)


def read_csv_ranges(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """As read_csv, with files shared between tasks."""
    text = F.regexp_replace("value", "\r$", "")
    records = quoted_records(spark, path).where("record > 1").select(text.alias("value")).where("value <> ''")
    return records.select(F.from_csv("value", F.lit(schema), {"quote": '"', "escape": '"'}).alias("row")).select("row.*")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True, quote='"', escape='"', quoteAll=True)


def physical_lines(spark: SparkSession, path: str) -> int:
    """Lines of all files under path less one header for each file; quoted line breaks count as lines."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("f"))
    return lines.agg(F.count("*") - F.countDistinct("f")).first()[0]


def write_shards(df: DataFrame, path: str, rows_a_file: int = 5000) -> None:
    df.write.option("maxRecordsPerFile", rows_a_file).mode("append").parquet(path)


def read_shards(spark: SparkSession, path: str, columns: list[str] | None = None, first: int | None = None) -> DataFrame:
    """All shards, or the first ones by name, and all columns, or some."""
    df = spark.read.parquet(path)
    if first is not None:
        df = spark.read.schema(df.schema).parquet(*sorted(df.inputFiles())[:first])
    return df.select(*columns) if columns else df


def write_by_feature(vectors: DataFrame, path: str, row_group_bytes: int = 4 << 20) -> None:
    """Vectors (pair_id, feature, value) in ranges of features and sorted by feature, in small row groups whose statistics tell which features they hold."""
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    vectors.repartitionByRange(tasks, "feature").sortWithinPartitions("feature", "pair_id").write.option("parquet.block.size", row_group_bytes).parquet(path)


def read_features(spark: SparkSession, path: str, features: list[int]) -> DataFrame:
    """The cells of some features, which are pushed down to files and row groups."""
    return spark.read.parquet(path).where(F.col("feature").isin([int(f) for f in features]))


def write_vectors(vectors: DataFrame, labels: DataFrame, path: str, rows_a_file: int = 5000) -> None:
    """Vectors (pair_id, feature, value) and labels (pair_id, label, ..) side by side; read_vectors gives both back."""
    write_shards(vectors, f"{path}/vectors", rows_a_file)
    write_shards(labels, f"{path}/labels", rows_a_file)


def read_vectors(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return read_shards(spark, f"{path}/vectors"), read_shards(spark, f"{path}/labels")


def write_importances(df: DataFrame, path: str) -> None:
    """feature: score lines of non-zero scores, largest first."""
    lines = df.where("score <> 0").orderBy(F.desc("score"), "feature").select(F.concat(F.col("feature").cast("string"), F.lit(": "), F.col("score").cast("string")))
    lines.coalesce(1).write.text(path)


def read_importances(spark: SparkSession, path: str) -> DataFrame:
    """(feature, score) of feature: score lines; blank lines are skipped, only the first colon splits."""
    parts = F.split("value", ":", 2)
    return spark.read.text(path).where(F.trim("value") != "").select(F.trim(parts[0]).cast("int").alias("feature"), F.trim(parts[1]).cast("double").alias("score")).orderBy("feature")


def write_metrics(spark: SparkSession, metrics: dict[str, float], path: str) -> None:
    spark.createDataFrame([(json.dumps(metrics),)], "value string").coalesce(1).write.text(path)


def read_metrics(spark: SparkSession, path: str) -> dict[str, float]:
    return json.loads("".join(r[0] for r in spark.read.text(path).collect()))


def read_names(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(index, description) by number from a JSON list, or from gzip or plain JSON lines; other fields, such as long arrays, are not read."""
    rows = spark.read.schema("index string, description string").option("multiLine", not lines).json(path)
    return rows.select(F.col("index").cast("int").alias("index"), "description").orderBy("index")


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A model's dump, for example."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)


def kept(spark: SparkSession, path: str, key: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table made once and read afterwards; key names whatever it depends on, such as split and settings."""
    at = f"{path}/{key}"
    if not exists(spark, f"{at}/_SUCCESS"):
        make().write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)
