"""Maximal periodic runs of words by a suffix tree and smaller-half leaf lists (Stoye and Gusfield).

In a text's suffix tree, a node of depth D whose leaves hold i and i + D under different children is a branching
tandem repeat at i: two copies of D words that no longer match one word further on. For every node the leaves outside
its largest child are asked for their partner at i + D and i - D, so all nodes together ask at most n log n times. A
branching repeat is the right end of a run; rotating it to the left, word by word, leads to its start, so that
each run is met once for each period that it has, and keeps the smallest. The tree is kept as the intervals of its
suffix array, which prefix doubling sorts.

Trees are built only where a run can be. In a run of period q every word after the first q has occurred at most q
words before, so for each k, only stretches of words whose last occurrence is at most 2**k words back, and that are as
long as the shortest run with a period of up to 2**k leaves them, matter. Such a stretch and the 2**k words before it
hold every such run whole, so nothing is missed; most texts have none and get no tree.

Each text is a row of its own; a task holds a slice of texts, and of a very long text its words and its tree.

Defined results: null text, empty text and text of white space have no words, no runs and empty collapsed text;
texts of fewer words than the shortest run have none; repeated rows and null doc_ids are handled as others are;
very long texts are searched whole; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .frames import word_text

_ROWS = 256


class SuffixTree:
    """The suffix tree of an integer sequence: suffixes in order, their ranks, and what neighbours have in common."""

    def __init__(self, s: np.ndarray) -> None:
        m = len(s)
        ranks = [self._ends(np.unique(s, return_inverse=True)[1].astype(np.int64))]
        k = 1
        while k < m and ranks[-1].max() < m - 1:
            last = ranks[-1]
            key = last[:-1] * (m + 1)
            key[: m - k] += last[k:m] + 1
            order = np.argsort(key, kind="stable")
            rank = np.empty(m, np.int64)
            rank[order] = np.cumsum(np.concatenate(([0], key[order[1:]] != key[order[:-1]])))
            ranks.append(self._ends(rank))
            k *= 2
        self.s = self._ends(s.astype(np.int64))
        self.rank = ranks[-1]
        self.order = np.argsort(self.rank[:-1], kind="stable")
        a, b = self.order[:-1].copy(), self.order[1:].copy()
        common = np.zeros(max(0, m - 1), np.int64)
        for j in range(len(ranks) - 1, -1, -1):
            step = np.where(ranks[j][a] == ranks[j][b], 1 << j, 0)
            a, b, common = a + step, b + step, common + step
        #: common[i] is shared by suffixes i - 1 and i of the order; -1 at both ends.
        self.common = np.concatenate(([-1], common, [-1]))

    @staticmethod
    def _ends(x: np.ndarray) -> np.ndarray:
        return np.concatenate((x, [-1]))

    def children(self) -> tuple[np.ndarray, ...]:
        """Children (first, last) of all inner nodes below the root, with their node (first, last, depth), as places in the order."""
        common = self.common.tolist()
        m = len(common) - 1
        below, after, equal = [0] * m, [m] * m, [0] * m  # the nearest smaller value before and after, and the next equal one
        stack = [0]
        for i in range(1, m + 1):
            x = common[i]
            while common[stack[-1]] > x:
                after[stack.pop()] = i
            if i == m:
                break
            top = stack[-1]
            if common[top] == x:
                below[i] = below[top]
                equal[top] = i
            else:
                below[i] = top
            stack.append(i)
        depth = self.common[:-1]
        at = np.flatnonzero(depth >= 1)
        below, after, equal = np.array(below), np.array(after), np.array(equal)
        first, last = below[at], after[at] - 1
        right = at, np.where(equal[at] > 0, equal[at], after[at]) - 1
        # the child before a node's first cut is the only one that no cut begins
        begins = np.ones(m, bool)
        begins[equal[at]] = False
        head = begins[at]
        left = below[at][head], at[head] - 1
        join = lambda x, y: np.concatenate((x, y))
        return join(right[0], left[0]), join(right[1], left[1]), join(first, first[head]), join(last, last[head]), join(depth[at], depth[at][head])

    def branching(self) -> tuple[np.ndarray, np.ndarray]:
        """(place, period) of all branching tandem repeats, periods in order."""
        a, b, first, last, depth = self.children()
        if not len(a):
            return a, a
        by_size = np.lexsort((b - a, last, first))
        node = first[by_size] * len(self.s) + last[by_size]
        small = by_size[:-1][node[1:] == node[:-1]]  # all but the largest child of each node
        size = (b - a + 1)[small]
        leaf = np.repeat(a[small], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        i, d = self.order[leaf], np.repeat(depth[small], size)
        low, high = np.repeat(first[small], size), np.repeat(last[small], size)
        found = []
        for place, partner in ((i, i + d), (i - d, i - d)):
            inside = (partner >= 0) & (partner < len(self.s) - 1)
            p, q, n = place[inside], partner[inside], d[inside]
            hit = (self.rank[q] >= low[inside]) & (self.rank[q] <= high[inside])
            p, n = p[hit], n[hit]
            ends = self.s[p + n] != self.s[p + 2 * n]
            found.append((p[ends], n[ends]))
        pairs = np.unique(np.concatenate([n * len(self.s) + p for p, n in found]))
        return pairs % len(self.s), pairs // len(self.s)


class Shortest:
    """A run has least words or more, and times periods or more."""

    def __init__(self, least: int, times: int) -> None:
        if times < 2:
            raise ValueError("a run repeats its period at least twice")
        self.least, self.times = least, times

    def length(self, period):
        return np.maximum(self.least, self.times * period)

    def stretches(self, words: np.ndarray, starts: np.ndarray) -> list[tuple[int, int]]:
        """Places [a, b) that hold all runs; words of several texts, which begin at starts and share no word."""
        n = len(words)
        back = np.full(n, n + 1, np.int64)
        order = np.argsort(words, kind="stable")
        again = np.flatnonzero(words[order[1:]] == words[order[:-1]])
        back[order[again + 1]] = order[again + 1] - order[again]
        longest = int(np.diff(np.append(starts, n)).max(initial=0))
        found, reach = [], 1
        while (reach // 2 + 1) * self.times <= longest:
            # of a run of period q, length - q words have a last occurrence at most q back; least for the smallest q
            periods = np.arange(reach // 2 + 1, min(reach, self.least) + 1) if reach // 2 + 1 <= self.least else np.array([reach // 2 + 1])
            least = int((self.length(periods) - periods).min())
            edge = np.flatnonzero(np.diff(np.concatenate(([False], back <= reach, [False]))))
            a, b = edge[0::2], edge[1::2]
            long = b - a >= least
            found += zip((a[long] - reach).tolist(), b[long].tolist(), strict=True)
            reach *= 2
        begin = lambda b: int(starts[np.searchsorted(starts, b - 1, side="right") - 1])
        merged: list[tuple[int, int]] = []
        for a, b in sorted((max(a, begin(b)), b) for a, b in found):
            if merged and a < merged[-1][1]:
                merged[-1] = merged[-1][0], max(b, merged[-1][1])
            else:
                merged.append((a, b))
        return merged

    def runs(self, s: np.ndarray, stretches: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """(start, length, period) of all runs of s, by start, then period."""
        found: set[tuple[int, int, int]] = set()
        for a, b in stretches:
            part = s[a:b]
            place, period = SuffixTree(part).branching()
            end = place + 2 * period
            # a run's least length asks for at least this many rotations to the left
            turns = self.length(period) - 2 * period
            fits = place >= turns
            place, period, end, turns = place[fits], period[fits], end[fits], turns[fits]
            for k in range(1, 5):
                same = (turns < k) | (part[place - np.minimum(k, place)] == part[place + period - np.minimum(k, place)])
                place, period, end, turns = place[same], period[same], end[same], turns[same]
            known: dict[int, list[tuple[int, int]]] = {}  # runs by their end: a multiple of their period ends there too
            for e, q in zip((a + end).tolist(), period.tolist(), strict=True):  # by period
                if any(q % p == 0 and e - start >= 2 * q for start, p in known.get(e, ())):
                    continue
                start = self._differs(s[:e - q][::-1], s[q:e][::-1])
                start = e - q - start
                stop = e + self._differs(s[e:], s[e - q : len(s) - q])
                known.setdefault(e, []).append((start, q))
                if stop - start >= self.length(q):
                    found.add((start, stop - start, q))
        return sorted(found, key=lambda r: (r[0], r[2]))

    @staticmethod
    def _differs(x: np.ndarray, y: np.ndarray) -> int:
        """How many values x and y have in common from the start on, looked at in pieces of growing length."""
        at, size = 0, 64
        while at < len(x):
            apart = np.flatnonzero(x[at : at + size] != y[at : at + size])
            if len(apart):
                return at + int(apart[0])
            at, size = at + size, 2 * size
        return len(x)


def _numbered(words: list[bytes], base: int) -> np.ndarray:
    """Equal words get equal numbers, from base on."""
    number = {w: k for k, w in enumerate(dict.fromkeys(words), base)}
    return np.fromiter(map(number.__getitem__, words), np.int64, len(words))


def _found(texts: list[bytes], shortest: Shortest) -> Iterator[tuple[int, list[tuple[int, int, int]], bytes]]:
    """(words, runs, collapsed) of each text."""
    split = [t.split() for t in texts]  # bytes split at 0x20 and 0x09 to 0x0D
    sizes = np.array([len(w) for w in split], np.int64)
    starts = np.cumsum(sizes) - sizes
    flat = np.concatenate([_numbered(w, int(at)) for w, at in zip(split, starts, strict=True)] or [np.zeros(0, np.int64)])
    own: dict[int, list[tuple[int, int]]] = {}
    begins = starts[sizes > 0]
    for a, b in shortest.stretches(flat, begins):
        at = int(begins[np.searchsorted(begins, a, side="right") - 1])
        own.setdefault(at, []).append((a - at, b - at))
    for words, n, at in zip(split, sizes.tolist(), starts.tolist(), strict=True):
        runs = shortest.runs(flat[at : at + n], own[at]) if n and at in own else []
        if runs:
            kept = np.ones(n, bool)
            for start, length, period in runs:
                kept[start + period : start + length] = False
            words = [words[k] for k in np.flatnonzero(kept).tolist()]
        yield n, runs, b" ".join(words)


RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def periodic_runs(docs: DataFrame, least: int = 6, times: int = 4) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): all runs by start, then period; collapsed has the words that no run repeats, joined by one space."""
    shortest = Shortest(least, times)
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def found(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                n, runs, collapsed = zip(*_found(part.column("text").to_pylist(), shortest), strict=True)
                runs = pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in rs] for rs in runs], pa.list_(run))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), runs, pa.array(collapsed, pa.binary())], names=["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select("doc_id", word_text().cast("binary").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(found, f"doc_id {kind}, n_words long, runs {RUNS}, collapsed binary").withColumn("collapsed", F.col("collapsed").cast("string"))
