"""Token ids as ORC: stripes with integer run-length encoding, row indexes and Bloom filters on document ids.

Documents are range-partitioned and sorted by doc_id before they are encoded, so that files, stripes and row
groups hold disjoint doc_id ranges: a lookup by id prunes by statistics and Bloom filters, and a scan splits by stripe.
Rows are numbered as they are written, so rows of one doc_id keep their places in the file.

Defined results: null and empty texts hold the end id alone; a null doc_id sorts first; repeated rows are kept;
very long texts are encoded whole; other columns are ignored; an empty table writes files without rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .encoding import encoded

ORC_OPTIONS = {
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.row.index.stride": "1000",
    "orc.encoding.strategy": "COMPRESSION",
    "compression": "zstd",
    "orc.compression.zstd.level": "1",
}


_COLUMNS = ["doc_id", "place", "n_tokens", "token_ids"]
_SCHEMA = "doc_id long, place long, n_tokens long, token_ids array<int>"


def write_token_orc(docs: DataFrame, path: str, tokenizer: str, end_id: int, stripe_bytes: int = 16 << 20) -> None:
    """Writes (doc_id, place, n_tokens, token_ids) in ascending doc_id order; place numbers the rows of a task, which writes one file after another."""
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        place = 0
        for part, ids in encoded(batches, tokenizer):
            size = np.array([len(x) + 1 for x in ids])
            flat = np.full(int(size.sum()), end_id, np.int32)
            stops = np.cumsum(size)
            own = np.ones(len(flat), bool)
            own[stops - 1] = False
            flat[own] = np.concatenate(ids)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], stops)).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.arange(place, place + len(ids))), pa.array(size.astype(np.int64)), lists], names=_COLUMNS)
            place += len(ids)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = rows.repartitionByRange(tasks, "doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(run, _SCHEMA).write.options(**ORC_OPTIONS).option("orc.stripe.size", stripe_bytes).orc(path)


def read_token_orc(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_SCHEMA).orc(path)


def token_digests(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 from the files' own ids, which are read once; the totals of files come from their column n_tokens."""

    def run(batches):
        for batch in batches:
            lists = batch.column("token_ids")
            flat = np.asarray(lists.flatten()).astype("<u4")
            size = np.asarray(lists.value_lengths())
            stops = np.cumsum(size)
            if (size != np.asarray(batch.column("n_tokens"))).any():
                raise ValueError("n_tokens is not the number of a row's ids")
            crc = [zlib.crc32(flat[b - n : b]) for b, n in zip(stops.tolist(), size.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("doc_id"), batch.column("place"), pa.array(size.astype(np.int64)), pa.array(crc, pa.int64())], names=["file", "doc_id", "place", "n_tokens", "ids_crc32"])

    named = files.select(F.col("_metadata.file_name").alias("file"), *_COLUMNS)
    each = named.mapInArrow(run, "file string, doc_id long, place long, n_tokens long, ids_crc32 long")
    totals = named.groupBy("file").agg(F.sum("n_tokens").alias("total"), F.min("doc_id").alias("first"))
    before = totals.select("file", (F.sum("total").over(W.orderBy(F.col("first").asc_nulls_first(), "file")) - F.col("total")).alias("before"))
    own = F.sum("n_tokens").over(W.partitionBy("file").orderBy("place").rowsBetween(W.unboundedPreceding, 0)) - F.col("n_tokens")
    return each.withColumn("own", own).join(before, "file").select("doc_id", (F.col("before") + F.col("own")).alias("start"), "n_tokens", "ids_crc32")
