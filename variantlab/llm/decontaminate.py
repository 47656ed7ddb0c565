"""Benchmark decontamination over a distributed positional inverted index, in DataFrame operations only.

The index stores postings (uid, doc_id, pos, term) of the training words that occur in the benchmark, with one
row (term -1, pos = number of words) for each document. A window of benchmark words is matched from its rarest
term on: that term's postings give the possible starts, the postings of the next rarest terms, adjusted by
their offsets, thin them out, and the remaining terms are met in the documents that are left.

Words: A-Z lower-cased, runs of characters other than ASCII that is not a letter or digit.

Defined results: null text, empty text and text without words have n_words 0 and no hits; repeated rows are
matched each; a null doc_id is kept; an item with null or no words has no window; rows that repeat an item_id add
to its windows; an item with a null id is matched and hits, but is not named or counted; other columns are ignored;
empty tables give empty or hitless results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .frames import keyed, stored, word_text

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Terms of a window whose postings are intersected one after another, the rarest first, before the rest is met.
RARE = 3


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def lowered(term: Column) -> Column:
    """A-Z in lower case; lower() does just that to ASCII, and quickly."""
    return F.when(F.octet_length(term) == F.char_length(term), F.lower(term)).otherwise(F.translate(term, _UPPER, _LOWER))


def item_words(benchmark: DataFrame) -> DataFrame:
    """(item_id, w) of each benchmark row: its words in order."""
    return benchmark.select("item_id", F.transform(words(word_text()), lowered).alias("w"))


def item_terms(benchmark: DataFrame) -> DataFrame:
    """(item_id, pos, word) of all benchmark words."""
    return item_words(benchmark).select("item_id", F.posexplode("w").alias("pos", "word"))


def windows(items: DataFrame, width: int) -> DataFrame:
    """(win, item_id, offset, word, n): runs of width words of items (item_id, w); a shorter item is one window. win is the text of the window."""
    last = F.greatest(F.lit(0), F.size("w") - width)
    each = items.where(F.size("w") > 0).select("item_id", "w", F.explode(F.sequence(F.lit(0), last)).alias("at"))
    each = each.select("item_id", F.slice("w", F.col("at") + 1, F.lit(width)).alias("w")).withColumn("win", F.array_join("w", " ")).dropDuplicates(["item_id", "win"])
    return each.select("win", "item_id", F.size("w").alias("n"), F.posexplode("w").alias("offset", "word"))


def build_index(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Stores the postings of docs for vocabulary (word, term): uid, doc_id, pos, term."""
    ends = F.array_append(words(word_text()), F.lit(" "))
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), ends.alias("w"))
    each = rows.select("uid", "doc_id", F.posexplode("w").alias("pos", "word")).withColumn("word", lowered(F.col("word")))
    known = vocabulary.unionByName(vocabulary.sparkSession.createDataFrame([(" ", -1)], "word string, term long"))
    return stored(keyed(each, known, "word", "inner").select("uid", "doc_id", "pos", "term"), "postings")


def phrase_matches(index: DataFrame, wins: DataFrame) -> DataFrame:
    """(uid, start, n, win) of every occurrence of windows (win, n, offset, term) in the index."""
    wins = wins.select("win", "n", "offset", "term").distinct()
    terms = wins.select("term").distinct()
    freq = keyed(index, terms, "term", "left_semi").groupBy("term").agg(F.count("*").alias("freq"))
    ranked = wins.join(freq, "term", "left").withColumn("known", F.count("freq").over(W.partitionBy("win"))).where("known = n")
    ranked = stored(ranked.withColumn("rank", F.row_number().over(W.partitionBy("win").orderBy("freq", "offset"))).select("win", "n", "offset", "term", "rank"), "ranked")
    rare = stored(keyed(index.select("uid", "pos", "term"), ranked.where(f"rank <= {RARE}").select("term").distinct(), "term", "left_semi"), "rare")
    first = ranked.where("rank = 1").select("win", "n", "offset", "term")
    found = keyed(rare, first, "term", "inner").select("uid", (F.col("pos") - F.col("offset")).alias("start"), "win", "n").where("start >= 0")
    for rank in range(2, RARE + 1):
        following = ranked.where(f"rank = {rank}").select("win", "offset", "term")
        ask = keyed(found, following, "win", "left").withColumn("pos", F.col("start") + F.col("offset"))
        short = ask.where("term IS NULL").select("uid", "start", "win", "n")
        found = ask.join(rare, ["uid", "pos", "term"], "left_semi").select("uid", "start", "win", "n").unionByName(short)
    found = stored(found, "found")
    left = ranked.where(f"rank > {RARE}").select("win", "offset", "term")
    ask = keyed(found, left, "win", "inner").select("uid", "start", "win", "n", (F.col("start") + F.col("offset")).alias("pos"), "term")
    there = keyed(index.select("uid", "pos", "term"), found.select("uid").distinct(), "uid", "left_semi")
    there = keyed(there, left.select("term").distinct(), "term", "left_semi")
    met = ask.join(there, ["uid", "pos", "term"]).groupBy("uid", "start", "win", "n").count().where(f"count = n - {RARE}").drop("count")
    return met.unionByName(found.where(f"n <= {RARE}")).distinct()


def proximity_matches(index: DataFrame, pairs: DataFrame, within: int) -> DataFrame:
    """(uid, name, pos_a, pos_b): pairs (name, term_a, term_b) of terms at most within words apart, by blocks of positions."""
    block = F.floor(F.col("pos") / within)
    one = keyed(index.select("uid", "pos", F.col("term").alias("term_a")), pairs, "term_a", "inner")
    one = one.select("uid", "name", "term_b", F.col("pos").alias("pos_a"), F.explode(F.array(block - 1, block, block + 1)).alias("block"))
    two = index.select("uid", F.col("pos").alias("pos_b"), F.col("term").alias("term_b"), block.alias("block"))
    two = keyed(two, pairs.select("term_b").distinct(), "term_b", "left_semi")
    return one.join(two, ["uid", "term_b", "block"]).where(f"pos_a <> pos_b AND abs(pos_a - pos_b) <= {within}").select("uid", "name", "pos_a", "pos_b").distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each document."""
    items = stored(item_words(benchmark), "items")
    # a stored id is unique and long at any size, and Parquet's dictionaries keep it short
    vocabulary = stored(items.select(F.explode("w").alias("word")).distinct().select("word", F.monotonically_increasing_id().alias("term")), "vocabulary")
    index = build_index(docs, vocabulary)
    wins = stored(windows(items, width).join(vocabulary, "word"), "windows")
    found = stored(phrase_matches(index, wins), "matches")
    spans = found.groupBy("uid", "start").agg(F.max("n").alias("n"))
    before = W.partitionBy("uid").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    reach = F.greatest(F.col("start"), F.coalesce(F.max(F.col("start") + F.col("n")).over(before), F.lit(0)))
    hits = spans.withColumn("fresh", F.greatest(F.lit(0), F.col("start") + F.col("n") - reach)).groupBy("uid").agg(F.sum("fresh").cast("long").alias("n_hit"))
    items = keyed(found.select("uid", "win").distinct(), wins.select("win", "item_id").distinct(), "win", "inner").select("uid", F.col("item_id").cast("string").alias("item")).distinct()
    items = items.groupBy("uid").agg(F.array_sort(F.collect_list("item")).alias("items"))
    rows = index.where("term = -1").select("uid", "doc_id", F.col("pos").cast("long").alias("n_words"))
    out = keyed(rows, hits.join(items, "uid"), "uid", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )
