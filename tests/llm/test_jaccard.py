"""The n-gram Jaccard join against a comparison of all pairs."""

from __future__ import annotations

import random
import re

import pytest

from variantlab.llm import jaccard_join
from variantlab.llm.jaccard_join import jaccard_components
from variantlab.llm.queries import op3_ngram_jaccard_join
from variantlab.llm.words import shingle_sets

from .fixtures import DOCS, odd_docs, odd_texts, sentence


def shingles(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(rows):
    """Sorted (doc_id, n_shingles, component_id); the sets' shared shingles are counted pair by pair."""
    sets = [shingles(t) for _, t in rows]
    distinct = list(dict.fromkeys(s for s in sets if s))
    index = {s: k for k, s in enumerate(distinct)}
    parent = list(range(len(distinct)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    by: dict = {}
    for k, s in enumerate(distinct):
        for x in s:
            by.setdefault(x, []).append(k)
    shared: dict = {}
    for members in by.values():
        for p, a in enumerate(members):
            for b in members[p + 1 :]:
                shared[a, b] = shared.get((a, b), 0) + 1
    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(distinct[a]) + len(distinct[b]) - n):
            parent[find(a)] = find(b)
    least: dict = {}
    for (i, _), s in zip(rows, sets, strict=True):
        if s:
            root = find(index[s])
            old = least.get(root)
            least[root] = i if old is None else old if i is None else min(old, i)
    return sorted(((i, len(s), least[find(index[s])] if s else i) for (i, _), s in zip(rows, sets, strict=True)), key=str)


def test_whole_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in op3_ngram_jaccard_join(spark, sf_dir).select("doc_id", "n_shingles", "component_id").collect()), key=str)
    assert got == brute(rows)


@pytest.mark.parametrize("seed", [1])
def test_odd_rows(spark, seed):
    rows = odd_texts(seed)
    got = sorted((tuple(r) for r in jaccard_components(odd_docs(spark, rows)).collect()), key=str)
    assert got == brute(rows)


def test_ids_that_name_several_texts_or_none(spark):
    """One id with two texts, of which one is a copy, and near copies that only null-id rows hold."""
    rng = random.Random(3)
    near = lambda t, k: " ".join([*t.split()[:k], "other", *t.split()[k + 1 :]])
    one, two, three, four = (sentence(rng, 80) for _ in range(4))
    rows = [(3, one), (5, one), (5, two), (9, near(two, 30)), (7, three), (None, near(three, 20)), (None, near(three, 20)), (None, four), (None, near(four, 70)), (11, one), (11, one)]
    got = sorted((tuple(r) for r in jaccard_components(odd_docs(spark, rows)).collect()), key=str)
    assert got == brute(rows)


def test_long_lists_and_chains(spark):
    """Hundreds of variants that drift from one text, so that links chain, and a passage that many texts share."""
    rng = random.Random(5)
    words = sentence(rng, 100).split()
    rows, passage = [], sentence(rng, 60)
    for k in range(300):
        words[rng.randrange(100)] = f"n{k}"
        rows.append((k, " ".join(words)))
    for k in range(300, 450):
        rows.append((k, passage + " " + sentence(rng, rng.randrange(5, 60))))
    for k in range(450, 600):
        rows.append((k, passage + " " + " ".join(f"t{rng.randrange(3)}" for _ in range(rng.randrange(3, 9)))))
    got = sorted((tuple(r) for r in jaccard_components(odd_docs(spark, rows)).collect()), key=str)
    assert got == brute(rows)


def test_sides_beyond_the_limit(spark, monkeypatch):
    monkeypatch.setattr("variantlab.llm.frames.BROADCAST_ROWS", 0)
    rows = odd_texts(4)
    got = sorted((tuple(r) for r in jaccard_components(odd_docs(spark, rows)).collect()), key=str)
    assert got == brute(rows)


def test_verified_pairs_follow_a_group_of_near_copies(spark, monkeypatch):
    """Twice the near copies of one text, 1 to 6 words changed in each: the pairs compared, those with centres included, stay in proportion."""
    seen = {}

    def counted(name):
        own = getattr(jaccard_join, name)

        def run(pairs, *more):
            seen[name] = seen.get(name, 0) + pairs.count()
            return own(pairs, *more)

        monkeypatch.setattr(jaccard_join, name, run)

    for name in ("linked", "_apart", "plausible", "_differences"):
        counted(name)
    figures = []
    for m in (300, 600):
        rng = random.Random(7)
        base = [f"b{k}" for k in range(120)]
        rows = []
        for k in range(m):
            words = list(base)
            for _ in range(1 + k % 6):
                words[rng.randrange(120)] = f"e{rng.randrange(10**9)}"
            rows.append((k, " ".join(words)))
        seen.clear()
        got = sorted((tuple(r) for r in jaccard_components(odd_docs(spark, rows)).collect()), key=str)
        assert got == brute(rows)
        figures.append(dict(seen))
    compared = [f["linked"] + f["_apart"] + f["plausible"] for f in figures]
    assert compared[1] <= 600 and sum(figures[1].values()) <= 2.5 * sum(figures[0].values())


def test_groups_spread_thinly_make_no_long_lists(spark, monkeypatch):
    """Passages of 30 texts each, of which a partition holds one: their elements are known as heavy, and none is in a prefix."""
    rng = random.Random(13)
    passages = [sentence(rng, 30, 10**6) for _ in range(12)]
    rows = [(30 * m + k, f"{sentence(rng, 40, 10**6)} {passage} {sentence(rng, 40, 10**6)}") for m in range(30) for k, passage in enumerate(passages)]
    rows += [(5000 + k, rows[k][1] + " end") for k in range(0, 360, 45)]
    seen = []

    def lists(long, *more, own=jaccard_join._long_lists):
        seen.append(long.count())
        return own(long, *more)

    monkeypatch.setattr(jaccard_join, "_long_lists", lists)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(30, "doc_id")
        got = sorted((tuple(r) for r in jaccard_components(docs).collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == brute(rows)
    assert seen == []


def test_keys_are_counted_whole(spark, monkeypatch):
    """Elements of more than LONG_LIST texts, and no others, however few are sorted at once."""
    monkeypatch.setattr(jaccard_join, "COUNTED", 50)
    rng = random.Random(17)
    common = [sentence(rng, 8, 10**6) for _ in range(3)]
    texts = [common[0] + " " + sentence(rng, 20, 10**6) + (" " + common[1] if k < 25 else "") + (" " + common[2] if k < 24 else "") for k in range(60)]
    counts: dict = {}
    for s in shingle_sets(texts, 5):
        for x in s.tolist():
            counts[x] = counts.get(x, 0) + 1
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "uid long, text string").repartition(3)
    for least in (35, 64):
        monkeypatch.setattr(jaccard_join, "LEAST_KEY_BITS", least)
        keys, levels, bits = jaccard_join.heavy_elements(docs, 5, sum(counts.values()))
        want = sorted((x >> (64 - bits), n) for x, n in counts.items() if n > 24)
        assert keys.tolist() == [x for x, _ in want]
        assert all((m > n) <= (a >= b) for (_, m), a in zip(want, levels.tolist(), strict=True) for (_, n), b in zip(want, levels.tolist(), strict=True))


def boilerplate(n, seed):
    """Texts of a random half of 30 sentences in their order, and near copies of some of them."""
    rng = random.Random(seed)
    sentences = [sentence(rng, 10) for _ in range(30)]
    rows = []
    for k in range(n):
        words = " ".join(sentences[i] for i in sorted(rng.sample(range(30), 15))).split()
        if k % 40 == 39:
            words = rows[rng.randrange(k)][1].split()
            for _ in range(rng.randrange(3)):
                words[rng.randrange(len(words))] = f"n{k}"
        rows.append((k, " ".join(words)))
    return rows


def test_boilerplate_is_not_compared_pair_by_pair(spark, monkeypatch):
    """Twice and four times the texts of shared sentences: comparisons stay in proportion to them."""
    seen = []
    for name in ("linked", "_apart", "plausible", "_differences"):

        def run(pairs, *more, own=getattr(jaccard_join, name)):
            seen.append(pairs.count())
            return own(pairs, *more)

        monkeypatch.setattr(jaccard_join, name, run)
    figures = []
    for n in (300, 600, 1200):
        seen.clear()
        rows = boilerplate(n, 3)
        got = sorted((tuple(r) for r in jaccard_components(odd_docs(spark, rows)).collect()), key=str)
        assert got == brute(rows)
        figures.append(sum(seen))
    assert figures[2] < 0.1 * 1200 * 1199 / 2
    assert figures[1] <= 2.5 * figures[0] and figures[2] <= 2.5 * figures[1]


def test_combinations_of_few_elements(spark, monkeypatch):
    """Short lists count as long ones, so that most pairs are met under combinations and in the lists that these leave."""
    monkeypatch.setattr(jaccard_join, "LONG_LIST", 3)
    monkeypatch.setattr(jaccard_join, "TAKEN", 1.0)
    monkeypatch.setattr(jaccard_join, "FEW", 2)
    monkeypatch.setattr(jaccard_join, "_elements_in", lambda lists: 0)
    rows = boilerplate(120, 8) + [(k + 500, t) for k, t in odd_texts(5) if k is not None and k < 50]
    got = sorted((tuple(r) for r in jaccard_components(odd_docs(spark, rows)).collect()), key=str)
    assert got == brute(rows)


def test_nested_groups_of_near_copies(spark):
    """Three groups of near copies whose texts share most words with each other, so that they share long lists too."""
    rng = random.Random(11)
    common, rows = sentence(rng, 90).split(), []
    own = [sentence(rng, 25).split() for _ in range(3)]
    for k in range(240):
        words = common + own[k % 3]
        for _ in range(rng.randrange(7)):
            words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
        rows.append((k, " ".join(words)))
    got = sorted((tuple(r) for r in jaccard_components(odd_docs(spark, rows)).collect()), key=str)
    assert got == brute(rows)


def test_empty(spark):
    assert jaccard_components(spark.createDataFrame([], DOCS)).collect() == []


@pytest.mark.parametrize("words", range(8))
def test_few_words_alone_in_a_batch(words):
    """Batches that hold 0 to 7 words together, in one text or several."""
    text = " ".join("abcdefg"[:words])
    assert [len(s) for s in shingle_sets([text], 5)] == [max(1, words - 4) if words else 0]
    assert [len(s) for s in shingle_sets([text, None, text, ""], 5)] == 2 * [max(1, words - 4) if words else 0, 0]


def test_few_words_alone_in_a_partition(spark):
    rows = [(0, "a b c"), (1, "d e f"), (2, "A b c"), (3, "a b c d"), (4, "a b c d e f"), (5, ""), (6, "x")]
    docs = odd_docs(spark, rows).repartitionByRange(len(rows), "doc_id")
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(docs).collect()) == brute(rows)
