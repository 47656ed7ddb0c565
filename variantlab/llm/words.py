"""Vectorised word and shingle hashing, used inside Arrow tasks.

Words are maximal runs of bytes other than space and 0x09-0x0D, with A-Z lower-cased.
A word hashes to 64 bits by a polynomial over its bytes and a finaliser; equal words
always get equal hashes, different words collide with a chance of about 2**-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

PIECE_BYTES = 1 << 20
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_ROUND = (_U(0xFF51AFD7ED558CCD), _U(0xC4CEB9FE1A85EC53))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> _U(33))
    x = x * _ROUND[0]
    x = x ^ (x >> _U(33))
    x = x * _ROUND[1]
    return x ^ (x >> _U(33))


def powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _pieces(buf: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Parts of about PIECE_BYTES that end in white space, as buf does itself."""
    at = 0
    while at < len(buf):
        end = min(len(buf), at + PIECE_BYTES)
        while end < len(buf) and not _SPACE[buf[end - 1]]:
            near = np.flatnonzero(_SPACE[buf[end : end + 4096]])
            end = end + int(near[0]) + 1 if len(near) else min(len(buf), end + 4096)
        yield at, buf[at:end]
        at = end


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and the bounds of each text's words among them."""
    raw = [(t or "").encode() for t in texts]
    starts = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) + 1 for r in raw], out=starts[1:])
    buf = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    hashes, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for at, part in _pieces(buf):
        inside = ~_SPACE[part]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], inside)).astype(np.int8)))
        first, last = edge[0::2], edge[1::2]
        if not len(first):
            continue
        length = last - first
        values = _LOWER[part[inside]].astype(np.uint64) + _U(1)
        begin = np.concatenate(([0], np.cumsum(length)[:-1]))
        within = np.arange(len(values)) - np.repeat(begin, length)
        values *= powers(int(length.max()))[within]
        hashes.append(mix(np.add.reduceat(values, begin) + length.astype(np.uint64)))
        places.append(first + at)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(places), starts)


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Each text's sorted distinct shingles of width words; a shorter text with words is one shingle."""
    words, bounds = word_hashes(texts)
    factor = powers(width + 1)[1:]
    total = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for k in range(width if len(total) else 0):
        total += words[k : len(words) - width + 1 + k] * factor[k]
    total = mix(total)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(total[a : b - width + 1]))
        else:
            out.append(mix((words[a:b] * factor[: b - a]).sum(keepdims=True, dtype=np.uint64) + _U(b - a)) if b > a else words[:0])
    return out
