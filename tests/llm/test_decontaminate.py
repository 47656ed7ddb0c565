"""Decontamination against a search through every document."""

from __future__ import annotations

import hashlib
import re

from variantlab.llm.decontaminate import build_index, decontaminate, item_terms, proximity_matches
from variantlab.llm.queries import op4_decontamination

from .fixtures import DOCS, odd_docs, odd_texts

import pytest
from pyspark.sql import functions as F


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, bench):
    wins: dict = {}
    for item, text in bench:
        w = words(text)
        for k in range(max(0, len(w) - 10) + 1 if w else 0):
            wins.setdefault(tuple(w[k : k + 10]), set()).add(item)
    sizes = {len(w) for w in wins}
    out = []
    for i, text in docs:
        w = words(text)
        hit, items = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (t := tuple(w[k : k + n])) in wins:
                    hit.update(range(k, k + n))
                    items |= wins[t]
        named = sorted(str(x) for x in items if x is not None)
        out.append((i, len(w), len(hit), len(named), hashlib.sha256(",".join(named).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()), key=str)


def test_whole_table(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    bench = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    got = rows_of(op4_decontamination(spark, sf_dir))
    assert got == brute(docs, bench)
    assert any(r[5] for r in got)


def test_odd_rows(spark):
    docs = odd_texts()
    base = docs[5][1].split()
    bench = [(1, None), (2, ""), (3, "!!!"), (4, "one two"), (5, "ONE, two"), (6, " ".join(base[3:30])), (6, " ".join(base[3:30])), (7, "same same same"),
             (8, "same " * 12), (None, " ".join(base[40:52])), (9, "Straße 日本語"), (10, "hola"), (11, "a b a b a b a b a b a b"), (12, "unknown words here")]
    docs += [(100, "a b " * 30), (101, "x a b a b a b a b a b a"), (102, "one two one, TWO"), (103, "hola"), (103, "hola")]
    table = spark.createDataFrame(bench, "item_id long, text string").withColumn("word", F.lit("clash")).withColumn("pos", F.lit(1))
    assert rows_of(decontaminate(odd_docs(spark, docs), table)) == brute(docs, bench)


@pytest.mark.parametrize("limit", [0, 2])
def test_sides_beyond_the_limit(spark, monkeypatch, limit):
    monkeypatch.setattr("variantlab.llm.frames.BROADCAST_ROWS", limit)
    docs = odd_texts()
    base = docs[5][1].split()
    bench = [(k, " ".join(base[k : k + 14])) for k in range(0, 100, 20)] + [(200, "one two"), (201, "words that nobody has")]
    want = brute(docs, bench)
    items = spark.createDataFrame(bench, "item_id long, text string").repartition(3)
    assert rows_of(decontaminate(odd_docs(spark, docs), items)) == want
    assert any(r[5] for r in want)


def test_empty(spark):
    docs, bench = spark.createDataFrame([], DOCS), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate(docs, bench).collect() == []
    full = odd_docs(spark, [(1, "a b c"), (2, None)])
    assert rows_of(decontaminate(full, bench)) == brute([(1, "a b c"), (2, None)], [])
    assert decontaminate(docs, spark.createDataFrame([(1, "a b")], "item_id long, text string")).collect() == []


def test_proximity(spark):
    docs = odd_docs(spark, [(1, "a x x b a"), (2, "b x x x x x a"), (3, "a a b")])
    terms = item_terms(spark.createDataFrame([(1, "a b")], "item_id long, text string")).select("word").distinct().withColumn("term", F.when(F.col("word") == "a", 1).otherwise(2).cast("long"))
    index = build_index(docs, terms)
    pairs = spark.createDataFrame([("ab", 1, 2)], "name string, term_a int, term_b int")
    got = {(r.doc_id, r.pos_a, r.pos_b) for r in proximity_matches(index, pairs, 3).join(index.where("term = -1").select("uid", "doc_id"), "uid").collect()}
    assert got == {(1, 0, 3), (1, 4, 3), (3, 0, 2), (3, 1, 2)}
