"""Token counts of whole texts; huge texts by overlap resynchronisation.

A text of up to chunk characters is encoded as it is. A longer one is cut into overlapping chunks that
tasks encode separately with offsets. Two neighbours are spliced at a position of their overlap where both
start a token and that is proven stable: the adjacent characters occur side by side in no vocabulary piece,
so no merge of the whole text can cross it (it is never beside characters that normalisation changes), and either side's tokens do not depend on the other.
Where an overlap holds no such position, the text is cut again with a wider overlap, at last into one chunk.

Defined results: null and empty texts have 0 bytes and 0 tokens; every row gives one row, repeated rows too;
a null doc_id is kept; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .frames import stored, word_text

CHUNK = 32_768
OVERLAP = 256
_KEPT: dict = {}


def _model(path: str):
    """The processor and the pairs of characters that stand side by side in some piece, kept between tasks."""
    if path not in _KEPT:
        import sentencepiece

        tool = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [tool.id_to_piece(i) for i in range(tool.get_piece_size()) if not (tool.is_control(i) or tool.is_byte(i) or tool.is_unknown(i))]
        _KEPT[path] = tool, {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
    return _KEPT[path]


def stable(text: str, at: int, pairs: set[str]) -> bool:
    """Whether no piece can cross from text[at - 1] to text[at]; spaces are written as the model writes them.

    Both characters must be their own normal form, and the second no mark of the first: else pieces hold other characters than the text.
    """
    two = text[at - 1 : at + 1]
    return two.replace(" ", "▁") not in pairs and unicodedata.is_normalized("NFKC", two) and not unicodedata.combining(text[at])


def _counts(docs: DataFrame, path: str) -> DataFrame:
    def run(batches):
        tool, _ = _model(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                n = [len(ids) for ids in tool.encode(part.column("text").to_pylist(), num_threads=1)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return docs.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")


def chunks(texts: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(key, i, start, part): part i holds chunk characters from i * chunk on and the overlap after them; the last is longer than the overlap.

    A text is cut once, from left to right, and a part is put together from its own piece and those that the overlap reaches.
    """
    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0))
    last = F.greatest(F.lit(0), F.floor((F.char_length("text") - 1 - overlap) / chunk)).cast("int")
    following = 1 + -(-overlap // chunk)
    part = lambda i: F.substring(F.array_join(F.slice(F.col("pieces"), i + 1, following), ""), 1, min(chunk + overlap, 2**31 - 1))
    cut = texts.select("key", pieces.alias("pieces"), last.alias("last"))
    each = cut.select("key", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("last")), part)).alias("i", "part"))
    return each.select("key", "i", (F.col("i") * F.lit(chunk).cast("long")).alias("start"), "part")


def _encode_chunks(parts: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """Each chunk's token count, and stable token starts in its head (head) and beyond its own characters (tail), with the tokens before them."""

    def run(batches):
        tool, pairs = _model(path)
        mark = pa.list_(pa.struct([("at", pa.int64()), ("before", pa.int64())]))
        for batch in batches:
            out = [], [], []
            for start, text in zip(batch.column("start").to_pylist(), batch.column("part").to_pylist(), strict=True):
                offsets = tool.encode(text, return_type="offset_mapping")["offsets"]
                head, tail = [], []
                for n, (a, _) in enumerate(offsets):
                    if a and (a < overlap or a >= chunk) and offsets[n - 1][1] == a and stable(text, a, pairs):
                        if a < overlap:
                            head.append({"at": start + a, "before": n})
                        if a >= chunk:
                            tail.append({"at": start + a, "before": n})
                for col, v in zip(out, (len(offsets), head, tail), strict=True):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("i"), pa.array(out[0], pa.int64()), pa.array(out[1], mark), pa.array(out[2], mark)], names=["key", "i", "n", "head", "tail"])

    marks = "array<struct<at:bigint,before:bigint>>"
    return parts.mapInArrow(run, f"key string, i int, n long, head {marks}, tail {marks}")


def spliced(texts: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """(key, n_tokens) of long texts (key, text); n_tokens is null where some neighbours have no common stable start."""
    parts = chunks(texts, chunk, overlap)
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = _encode_chunks(parts.repartition(tasks, "key", "i"), path, chunk, overlap)
    by = W.partitionBy("key").orderBy("i")
    joined = each.withColumn("next", F.lead("head").over(by)).withColumn("at", F.expr("array_min(array_intersect(tail.at, next.at))"))
    cut = joined.withColumn("stop", F.expr("CASE WHEN next IS NULL THEN n ELSE get(filter(tail, x -> x.at = at), 0).before END"))
    cut = cut.withColumn("from", F.lag("at").over(by)).withColumn("skip", F.expr("CASE WHEN i = 0 THEN 0 ELSE get(filter(head, x -> x.at = from), 0).before END"))
    return cut.groupBy("key").agg(F.when(F.count_if(F.col("stop").isNull() | F.col("skip").isNull()) == 0, F.sum(F.col("stop") - F.col("skip"))).alias("n_tokens"))


def token_counts(docs: DataFrame, path: str, limit: int = 4096, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of each document."""
    text = word_text()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    short = _counts(rows.where(F.char_length("text") <= chunk), path)
    long = rows.where(F.char_length("text") > chunk).withColumn("key", F.sha2("text", 256))
    texts = stored(long.groupBy("key").agg(F.first("text").alias("text")), "long")
    known, todo, width = None, texts, overlap
    while not todo.isEmpty():
        got = stored(spliced(todo, path, chunk, width), "spliced")
        good = got.where("n_tokens IS NOT NULL")
        known = good if known is None else known.unionByName(good)
        todo = todo.join(got.where("n_tokens IS NULL").select("key"), "key", "left_semi")
        width *= 8
    out = short
    if known is not None:
        out = short.unionByName(long.select("key", "doc_id", "n_bytes").join(known, "key").select("doc_id", "n_bytes", "n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
