"""Removed byte strings against a dictionary of all windows."""

from __future__ import annotations

import random

import numpy as np
import pytest

from variantlab.llm import suffix_dedup
from variantlab.llm.suffix_dedup import Hashed, Suffixes, stretches, without_repeats

from .fixtures import DOCS, odd_docs, odd_texts, sentence


def plain(rows, length):
    """(n_bytes, removed, kept) of each row, rows in the order of doc_id, nulls last."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k))
    seen, out = set(), [None] * len(rows)
    for k in order:
        text = (rows[k][1] or "").encode()
        gone = np.zeros(len(text), bool)
        for s in range(len(text) - length + 1):
            w = text[s : s + length]
            if w in seen:
                gone[s : s + length] = True
            seen.add(w)
        edge = np.flatnonzero(np.diff(np.concatenate(([0], gone, [0])))).tolist()
        out[k] = (len(text), list(zip(edge[0::2], edge[1::2], strict=True)), bytes(np.frombuffer(text, np.uint8)[~gone]))
    return out


def held(spark, rows, length=100, parts=3):
    got = without_repeats(odd_docs(spark, rows).repartition(parts), length).collect()
    want = [(i, *w) for (i, _), w in zip(rows, plain(rows, length), strict=True)]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(((r.doc_id, r.n_bytes, [tuple(x) for x in r.removed], bytes(r.kept)) for r in got), key=key) == sorted(want, key=key)
    return got


def shared_passages(seed, n=60):
    """Texts of common passages, near copies, periodic stretches and lines shorter than a window in different surroundings."""
    rng = random.Random(seed)
    passages = [sentence(rng, rng.randrange(10, 60)) for _ in range(8)]
    line = sentence(rng, 12, 50)
    rows = []
    for k in range(n):
        parts = [sentence(rng, rng.randrange(0, 40)) for _ in range(3)]
        parts += rng.sample(passages, rng.randrange(0, 4)) + [line] * rng.randrange(0, 2)
        if rng.random() < 0.2:
            parts.append(rng.choice(["a", "ab", "xyz é "]) * rng.randrange(50, 200))
        rng.shuffle(parts)
        text = " ".join(parts)
        if rng.random() < 0.3 and rows:
            text = rng.choice(rows)[1]
            at = rng.randrange(len(text) + 1)
            text = text[:at] + rng.choice(["", "Z", "zz"]) + text[at:]
        rows.append((k, text))
    rng.shuffle(rows)
    return rows


def test_removed_bytes_equal_all_windows(spark):
    held(spark, shared_passages(1))
    held(spark, shared_passages(2), length=37)
    assert any(r.removed for r in held(spark, shared_passages(3), parts=1))


def test_odd_rows(spark):
    rows = [r for r in odd_texts() if r[0] != 11]
    rows += [(300, "short"), (301, "p" * 99), (302, "p" * 100), (303, "p" * 101), (304, "q" * 400), (None, "q" * 250), (None, "q" * 250), (304, "q" * 400), (305, "é" * 120), (-4, "\x00" * 150)]
    held(spark, rows)


def test_heavy_keys_change_nothing(spark, monkeypatch):
    """A line shorter than a window in many surroundings: its keys are cut into windows."""
    rng = random.Random(6)
    line = sentence(rng, 14, 40)[:80]
    rows = [(k, f"{sentence(rng, 15)} {line} {sentence(rng, 15)}") for k in range(300)] + [(k, f"{sentence(rng, 15)} {line}{line}!") for k in range(300, 340)]
    monkeypatch.setattr(suffix_dedup, "LOCAL_HEAVY", 3)
    monkeypatch.setattr(suffix_dedup, "HEAVY", 20)
    monkeypatch.setattr(suffix_dedup, "REDUCED", 500)
    heavy, total = suffix_dedup.heavy_keys(suffix_dedup.named(odd_docs(spark, rows)), 100)
    assert len(heavy) and total > 1000
    held(spark, rows)


def test_pieces_of_long_texts(spark):
    rng = random.Random(5)
    long = sentence(rng, 90_000)
    assert len(long) > suffix_dedup.PIECE + 1000
    middle = long[suffix_dedup.PIECE - 300 : suffix_dedup.PIECE + 300]
    held(spark, [(1, long), (2, "x" + middle + "y"), (3, long[5:2000] + middle)])


def test_empty_tables(spark):
    for rows in ([], [(1, None)], [(1, ""), (2, "short")]):
        held(spark, rows)
    out = without_repeats(spark.createDataFrame([], DOCS))
    assert out.columns == ["doc_id", "n_bytes", "removed", "kept"] and out.count() == 0


def test_equal_windows_have_equal_keys():
    rng = random.Random(7)
    text = "".join(rng.choice("ab ") for _ in range(3000)) + "abc" * 200
    data = np.frombuffer((text + "tail" * 20 + text[500:1500]).encode(), np.uint8)
    start, windows, key, _ = stretches(data, np.array([len(data)]), 60, np.zeros(0, np.uint64))
    assert windows.sum() == len(data) - 59 and (start[1:] == (start + windows)[:-1]).all()
    keys = np.repeat(key, windows)
    by_window = {}
    for s in range(len(data) - 59):
        assert by_window.setdefault(data[s : s + 60].tobytes(), keys[s]) == keys[s]


@pytest.mark.parametrize("misled", [False, True])
def test_suffix_sort(monkeypatch, misled):
    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    data[1000:1500] = data[:500]
    text = Hashed(data)
    if misled:  # hashes that call many strings equal
        monkeypatch.setattr(Hashed, "of", lambda self, a, b: self.data[np.minimum(a, len(self.data) - 1)].astype(np.uint64))
    place = np.arange(len(data) - 20)
    group = rng.integers(0, 9, len(place)) * (rng.random(len(place)) < 0.5)
    suffixes = Suffixes(text, place, group, np.random.default_rng(1).permutation(len(place)), 20)
    seen, want = set(), set()
    rank = dict(zip(suffixes.index.tolist(), suffixes.rank.tolist(), strict=True))
    for k in sorted(range(len(place)), key=lambda k: rank[k]):
        w = (group[k], data[k : k + 20].tobytes())
        if w in seen:
            want.add(k)
        seen.add(w)
    assert set(suffixes.repeats().tolist()) == want and want
    row = suffixes.sort()
    assert sorted(row.tolist()) == list(range(len(place)))
    if not misled:
        assert suffixes.classes(row) is not None
        assert row.tolist() == suffixes.by_bytes().tolist()
    else:
        assert suffixes.classes(row) is None
