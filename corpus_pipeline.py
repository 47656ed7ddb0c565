"""The corpus pipeline: toxicity, n-gram Jaccard join, benchmark decontamination, secret scans, best-fit packing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the
columns of documents. Toxic documents go, one document of each group of near copies stays (the smallest doc_id),
contaminated documents go, secrets are replaced in the text, and what is left is packed into sequences.

Defined results of every stage: decisions are on rows, not ids, so null ids, repeated ids and repeated rows are
decided each (of a group of near copies one row stays, also of equal rows); null and empty texts are kept by all stages
but toxicity, which scores them as texts without words, and are never near copies, contaminated or changed; very
long texts are taken whole; extra columns stay as they are, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from variantlab.llm.decontaminate import decontaminate
from variantlab.llm.frames import fresh, picked, stored
from variantlab.llm.jaccard_join import jaccard_components
from variantlab.llm.packing import pack
from variantlab.llm.secret_scan import redacted, secret_spans
from variantlab.llm.toxicity import toxicity


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs stored with a number for each row, since ids may be null, repeated or stand for several texts, and the number's column."""
    (row,) = fresh(docs, "row")
    return stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered"), row


def _by_row(rows: DataFrame, row: str) -> DataFrame:
    """rows as an operator's input, whose doc_id is the row's number."""
    return rows.select(F.col(row).alias("doc_id"), "text")


def _without(rows: DataFrame, rejected: DataFrame, row: str) -> DataFrame:
    return picked(rows, rejected.select(row), row, keep=False).drop(row)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic."""
    rows, row = _numbered(docs)
    named = rows.select("doc_id", "text", F.col(row).alias("__row"))
    found = toxicity(named, spark.read.parquet(f"{sf_dir}/labels.parquet"), named_by=("__row",))
    return _without(rows, found.where("predicted = 1").select(F.col("__row").alias(row)), row)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies: the smallest id, null ids last, and of equal ids the first row."""
    rows, row = _numbered(docs)
    groups = jaccard_components(_by_row(rows, row), numbered=True).select(F.col("doc_id").alias("row"), F.col("component_id").alias("group"))
    ids = rows.select(F.col(row).alias("row"), F.col("doc_id").isNull().alias("last"), "doc_id")
    groups = stored(ids.join(groups, "row"), "groups")
    first = groups.groupBy("group").agg(F.min(F.struct("last", "doc_id", "row")).alias("first"), F.count("*").alias("n")).where("n > 1")
    return _without(rows, groups.join(first, "group").where("row <> first.row").select(F.col("row").alias(row)), row)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of the benchmark."""
    rows, row = _numbered(docs)
    found = decontaminate(_by_row(rows, row), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(rows, found.where("contaminated").select(F.col("doc_id").alias(row)), row)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced; n_chars follows the text."""
    out = redacted(docs, stored(secret_spans(docs), "spans"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.char_length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return out


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each token piece's place in a sequence."""
    packed = pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=0, capacity=2048)
    pieces = packed.pieces.select("uid", "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pieces.join(packed.layout, "uid").drop("uid")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("ngram_jaccard_join", jaccard_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("secret_scan", secrets_stage),
    ("best_fit_packing", packing_stage),
]

#: SQL can't express the learned and the iterative stages; tests hold the stages against brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents, each result stored before the next stage reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
