"""Periodic runs against a comparison of all words at all distances."""

from __future__ import annotations

import random

import numpy as np

from variantlab.llm.tandem_runs import Shortest, SuffixTree, _numbered, periodic_runs

from .fixtures import DOCS, odd_docs, odd_texts


def plain(words, least=6, times=4):
    """(start, length, period): stretches of words that equal the one q on, for all q; the smallest q of a stretch stays."""
    found, n = {}, len(words)
    for q in range(1, n // times + 1):
        start = None
        for i in range(n - q + 1):
            if i < n - q and words[i] == words[i + q]:
                start = i if start is None else start
            elif start is not None:
                if i + q - start >= max(least, times * q):
                    found.setdefault((start, i + q - start), q)
                start = None
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def words_with_runs(rng, n, vocabulary):
    words = []
    while len(words) < n:
        if rng.random() < 0.4:
            period = [f"p{rng.randrange(vocabulary)}" for _ in range(rng.choice([1, 1, 2, 3, 4, 5, 7, 12]))]
            words += (period * rng.randrange(2, 9))[: rng.randrange(3, 70)]
        else:
            words += [f"p{rng.randrange(vocabulary)}" for _ in range(rng.randrange(1, 30))]
    return words[:n]


def test_runs_equal_all_distances():
    rng = random.Random(3)
    cases = [words_with_runs(rng, rng.randrange(1, 160), rng.choice([1, 2, 3, 30])) for _ in range(300)]
    cases += [["a"] * k for k in range(12)] + [list("ab" * 9 + "a"), list("aab" * 8 + "aa"), list("abaab" * 4), list("a" * 50 + "b" + "a" * 50)]
    for least, times in ((6, 4), (2, 2), (5, 3), (1, 6)):
        shortest = Shortest(least, times)
        for words in cases:
            s = _numbered([w.encode() for w in words], 0)
            stretches = shortest.stretches(s, np.zeros(min(1, len(s)), np.int64)) if len(s) else []
            assert shortest.runs(s, stretches) == plain(words, least, times), (least, times, words)


def test_tree_has_the_branching_repeats():
    rng = random.Random(8)
    for _ in range(200):
        s = np.array([rng.randrange(rng.choice([1, 2, 3])) for _ in range(rng.randrange(1, 40))])
        place, period = SuffixTree(s).branching()
        n = len(s)
        want = {(p, d) for d in range(1, n // 2 + 1) for p in range(n - 2 * d + 1) if (s[p : p + d] == s[p + d : p + 2 * d]).all() and (p + 2 * d == n or s[p + d] != s[p + 2 * d])}
        assert set(zip(place.tolist(), period.tolist(), strict=True)) == want and len(place) == len(want)


def test_trees_are_built_on_few_words():
    rng = random.Random(4)
    words = [f"w{min(rng.randrange(1, 4000), rng.randrange(1, 4000))}" for _ in range(30_000)]
    words[9000:9000] = ["x", "y", "z"] * 6
    shortest = Shortest(6, 4)
    stretches = shortest.stretches(_numbered([w.encode() for w in words], 0), np.zeros(1, np.int64))
    assert sum(b - a for a, b in stretches) < 300
    assert any(a <= 9000 and b >= 9018 for a, b in stretches)


def test_odd_rows(spark):
    rng = random.Random(9)
    rows = odd_texts() + [(100 + k, " ".join(words_with_runs(rng, 90, 4))) for k in range(30)]
    rows += [(200, "\x0b a\t\na a\x0c a\x0da  a a\x85a a"), (201, "Ä " * 6 + "\xa0b"), (202, "x y " * 40_000 + "z"), (203, "a A " * 12), (None, "q " * 9), (None, "q " * 9), (15, "t " * 7)]
    got = periodic_runs(odd_docs(spark, rows).repartition(4)).collect()
    assert len(got) == len(rows)
    want = []
    for i, text in rows:
        words = [w.decode() for w in (text or "").encode().split()]
        runs = [(0, 80_000, 2)] if i == 202 else plain(words) if len(words) < 5000 else []
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        want.append((i, len(words), runs, " ".join(w for k, w in enumerate(words) if k not in gone)))
    key = lambda r: (r[0] is None, r[0] or 0, r[3])
    assert sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got), key=key) == sorted(want, key=key)


def test_empty_table(spark):
    out = periodic_runs(spark.createDataFrame([], DOCS))
    assert out.columns == ["doc_id", "n_words", "runs", "collapsed"] and out.count() == 0
