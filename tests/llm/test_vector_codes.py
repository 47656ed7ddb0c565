"""Vector codes against a plain version of learning and coding, and VA-file bounds against all distances."""

from __future__ import annotations

import math
import random

import numpy as np

from variantlab.llm.vector_codes import LIMIT, Cells, compressed, decoded

VECTORS = "vec_id long, embedding array<double>, label int, code string, error long, key long, none boolean, v int"


def plain(rows, parts, entries, rounds):
    """(vec_id, code, error) by comparing every part with every entry, and the entries."""
    kept = [(i, v) for i, v, _ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    width = -(-len(kept[0][1]) // parts)
    cut = [[max(-LIMIT, min(LIMIT, math.floor(256 * x))) for x in v] for _, v in kept]
    cut = [[(v + [0] * (parts * width))[p * width : (p + 1) * width] for p in range(parts)] for v in cut]
    books = [[v[p] for v in cut[:entries]] for p in range(parts)]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    best = lambda p, x: min((square(x, e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        after = [list(b) for b in books]
        for p in range(parts):
            own = {}
            for v in cut:
                own.setdefault(best(p, v[p])[1], []).append(v[p])
            for k, vs in own.items():
                after[p][k] = [sum(c) // len(vs) for c in zip(*vs, strict=True)]
        books = after
    found = [[best(p, v[p]) for p in range(parts)] for v in cut]
    return [(i, "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f)) for (i, _), f in zip(kept, found, strict=True)], books


def hostile(n, width, seed=5):
    rng = random.Random(seed)
    rows = [(k, [rng.choice([rng.gauss(0, 0.2), rng.randrange(-3, 3) / 4]) for _ in range(width)], rng.choice([None, 1, 2])) for k in range(n)]
    rows += [rows[3], rows[3], (7, rows[9][1], None), (None, rows[5][1], 4), (None, rows[6][1], None)]
    rows += [(500, None, 1), (501, [], 1), (502, [0.0] * (width - 1), 1), (503, [float("nan")] + [0.0] * (width - 1), 1), (504, [float("-inf")] + [0.0] * (width - 1), 2)]
    rows += [(505, [None] + [0.0] * (width - 1), 2), (506, [0.0] * width, 9), (507, [1e30] + [-1e300] * (width - 1), 9), (508, [-1e-300] * width, 3)]
    rng.shuffle(rows)
    return rows


def held(spark, rows, parts, entries, rounds=2):
    table = spark.createDataFrame([(*r, "x", 1, None, None, 2) for r in rows], VECTORS).repartition(3)
    codes, books = compressed(table, parts, entries, rounds)
    got = codes.collect()
    want, entries_ = plain(rows, parts, entries, rounds)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r.vec_id, r.code, r.error) for r in got), key=key) == sorted(want, key=key)
    flat = [x for book in entries_ for e in book for x in e]
    if len(got[0].code) == 2 * parts and books.length % parts == 0:
        assert books.numbers() == flat
    for label in {r.label for r in got}:
        assert {r.label_error for r in got if r.label == label} == {sum(r.error for r in got if r.label == label)}
    return codes, books


def test_codes_equal_a_plain_version(spark):
    held(spark, hostile(150, 8), 4, 16)
    held(spark, hostile(40, 6), 2, 64, 3)


def test_length_that_is_no_multiple_of_the_parts(spark):
    _, books = held(spark, hostile(60, 7), 3, 8)
    assert books.length == 7 and len(books.numbers()) == 7 * 8


def test_decoded_vectors_are_as_far_as_the_error_says(spark):
    rows = [(k, v, label) for k, v, label in hostile(80, 8) if v and len(v) == 8 and all(x is not None and abs(x) < 100 for x in v)]
    codes, books = held(spark, rows, 4, 16)
    vectors = {r[0]: r[1] for r in rows if r[0] is not None and [x[0] for x in rows].count(r[0]) == 1}
    for r in decoded(codes, books).collect():
        if r.vec_id in vectors:
            assert sum((math.floor(256 * x) - 256 * y) ** 2 for x, y in zip(vectors[r.vec_id], r.v, strict=True)) == r.error


def test_empty_tables(spark):
    for rows in ([], [(1, None, 1)], [(1, [float("nan")], None)]):
        codes, books = compressed(spark.createDataFrame([(*r, "x", 1, None, None, 2) for r in rows], VECTORS))
        assert codes.count() == 0 and books.numbers() == []
        assert decoded(codes, books).count() == 0


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(2)
    for entries in (rng.integers(-300, 300, (64, 4)), rng.integers(-2, 2, (64, 4)), rng.integers(-9, 9, (1, 3)), np.zeros((5, 0), np.int64), rng.integers(-LIMIT, LIMIT, (64, 4))):
        cells = Cells(entries)
        spread = max(1, int(np.abs(entries).max(initial=0)))
        parts = np.clip(rng.normal(0, spread, (500, entries.shape[1])).astype(np.int64), -LIMIT, LIMIT)
        every = ((parts[:, None] - entries[None]) ** 2).sum(axis=2)
        low, high = cells.bounds(parts)
        assert (low <= every).all() and (every <= high).all()
        entry, distance, refined = cells.nearest(parts)
        assert (entry == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
        if len(entries) == 64 and spread > 2:
            assert refined < 0.4 * every.size
