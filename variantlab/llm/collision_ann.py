"""Nearest neighbours by collision-counting hashing, for the largest inner product.

Vectors are lifted so that the largest inner product is the smallest Euclidean distance: a vector x of norm up to
M becomes (x, sqrt(M^2 - |x|^2)), a query q becomes (M q / |q|, 0). Every block of vectors keeps one sorted array
for each random projection. A query opens a window around its own projection in each array and widens all of
them together (virtual rehashing: a wider window is the union of the narrower ones; a narrow window is read from its
sorted array, a wide one by ranks); each vector counts the windows that hold it. Vectors whose count reaches the
threshold are verified with the exact inner product. A block's search stops once its share of the k neighbours, and a margin, are verified
and nearer than the radius that the windows stand for, at the latest when the windows hold everything. No candidate
is dropped: all vectors whose count reaches the threshold by then are verified.

Every row is indexed, in one block; a task builds a block's arrays once and then streams all queries past them, so
vectors are shuffled once and queries once for each block. The best k of each block are merged.

Vectors without structure leave little to prune, as their distances hardly differ; the README has the verified
share and the recall on the tables here.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, neither do
vectors of another length than the most common one (the smaller on a tie) or rows with a null vec_id; repeated rows
are candidates each, other than the query's own vec_id; equal vectors have equal scores and go by vec_id; fewer than
k candidates give fewer rows; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from .frames import stored

PROJECTIONS = 96
#: Windows of half-width RATIO * radius: a vector at the radius falls into one with a chance of about 0.89.
RATIO = 1.6
THRESHOLD = 82
#: A search stops when its neighbours are within this share of the radius.
NEAR = 1.02
GROW = 1.1
#: Vectors of a block, and neighbours beyond its share of k that a block's search waits for.
BLOCK, MARGIN = 8192, 2
MIN_BLOCKS, FEW_VECTORS = 4, 2048


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): the vectors that take part, as doubles."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    fine = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    common = fine.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return fine.where(F.size("v") == (common[0][0] if common else 0))


class Arrays:
    """The sorted arrays of one block, at most 65535 vectors, with each vector's rank in each array."""

    def __init__(self, x: np.ndarray, top: float, seed: int) -> None:
        self.x, self.top = x, top
        lifted = np.column_stack([x, np.sqrt(np.maximum(0, top * top - (x * x).sum(axis=1)))])
        self.axes = np.random.default_rng(seed).standard_normal((PROJECTIONS, lifted.shape[1]))
        shadow = (lifted @ self.axes.T).T
        self.order = np.argsort(shadow, axis=1, kind="stable")
        self.sorted = np.take_along_axis(shadow, self.order, axis=1)
        self.rank = np.empty(shadow.shape, np.uint16)
        np.put_along_axis(self.rank, self.order, np.arange(len(x), dtype=np.uint16)[None, :], axis=1)
        self._shift, self._in = np.empty(len(x), np.uint16), np.empty(len(x), bool)

    def collisions(self, low: list[int], high: list[int]) -> np.ndarray:
        """How many of the windows [low, high) of the sorted arrays hold each vector."""
        n = len(self.x)
        hits = np.zeros(n, np.uint8)
        for j, (a, b) in enumerate(zip(low, high, strict=True)):
            if b - a < n // 16:
                hits[self.order[j, a:b]] += 1
            else:  # a wide window: comparing ranks is quicker than going through its members
                np.subtract(self.rank[j], np.uint16(a), out=self._shift)
                np.less(self._shift, b - a, out=self._in)
                np.add(hits, self._in.view(np.uint8), out=hits)
        return hits

    def search(self, q: np.ndarray, k: int, start: float) -> tuple[np.ndarray, np.ndarray, float]:
        """Verified rows with their inner products, and the radius at which the search stopped."""
        n = len(self.x)
        norm = float(np.sqrt((q * q).sum()))
        centre = (self.axes[:, :-1] @ (q * (self.top / norm))).tolist()
        todo = np.ones(n, bool)
        rows, scores, radius = np.zeros(0, np.int64), np.zeros(0), start
        while True:
            half = RATIO * radius
            low = [int(s.searchsorted(c - half)) for s, c in zip(self.sorted, centre, strict=True)]
            high = [int(s.searchsorted(c + half, "right")) for s, c in zip(self.sorted, centre, strict=True)]
            fresh = np.flatnonzero((self.collisions(low, high) >= THRESHOLD) & todo)
            todo[fresh] = False
            rows, scores = np.concatenate([rows, fresh]), np.concatenate([scores, self.x[fresh] @ q])
            if len(rows) >= k:
                kth = np.partition(scores, len(scores) - k)[len(scores) - k] / norm
                if np.sqrt(max(0.0, 2 * self.top * (self.top - kth))) <= NEAR * radius:
                    break
            if max(low) == 0 and min(high) == n:
                break
            radius *= GROW
        return rows, scores, radius


class Block:
    """A block's arrays, built once, and the radius at which its searches start."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, seed: int) -> None:
        self.ids, self.x = ids, x
        self.top = float(np.sqrt((x * x).sum(axis=1)).max())
        self.arrays = Arrays(x, self.top, seed)
        self.start = self.top * 0.5

    def nearest(self, qid: int, q: np.ndarray, k: int, enough: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids and scores of at most k of the vectors found for a query, the best first."""
        rows, scores, radius = self.arrays.search(q, enough + 1, self.start)
        self.start = max(self.top * 1e-3, 0.9 * self.start + 0.1 * radius / GROW)
        other = self.ids[rows] != qid
        rows, scores = rows[other], scores[other]
        if len(rows) > k:  # the sums below do not depend on a row's place; those above may, in the last bits
            kth = np.partition(scores, len(scores) - k)[len(scores) - k]
            rows = rows[scores >= kth - 1e-9 * max(1.0, abs(kth))]
        scores = (self.x[rows] * q).sum(axis=1)
        best = np.lexsort((self.ids[rows], -scores))[:k]
        return self.ids[rows[best]], scores[best]


def searched(frames, k: int, enough: int):
    """Frames (block, is_query, vec_id, v) sorted so that a block's vectors come before its queries: query_id, vec_id, score of each block's best."""
    name, ids, vectors, block = None, [], [], None
    for pdf in frames:
        out = [], [], []
        for b, is_query, vec_id, v in zip(pdf.block, pdf.is_query, pdf.vec_id, pdf.v, strict=True):
            if b != name:
                name, ids, vectors, block = b, [], [], None
            if not is_query:
                ids.append(vec_id)
                vectors.append(v)
                continue
            if block is None and ids:
                block = Block(np.array(ids, np.int64), np.stack(vectors), int(b))
                vectors = []
            if block:
                found, scores = block.nearest(vec_id, np.asarray(v), k, enough)
                for column, values in zip(out, (np.full(len(found), vec_id), found, scores), strict=True):
                    column.append(values)
        if out[0]:
            yield pd.DataFrame({c: np.concatenate(x) for c, x in zip(("query_id", "vec_id", "score"), out, strict=True)})


def nearest(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found for every vec_id divisible by every."""
    rows = stored(usable(vectors), "vectors")
    n = rows.count()
    blocks = max(MIN_BLOCKS if n > FEW_VECTORS else 1, -(-n // BLOCK))
    enough = min(k, -(-k // blocks) + MARGIN)
    own = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int")
    left = rows.select(own.alias("block"), F.lit(False).alias("is_query"), "vec_id", "v")
    right = rows.where(F.col("vec_id") % every == 0).select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("is_query"), "vec_id", "v")
    dealt = left.unionByName(right).repartition(blocks, "block").sortWithinPartitions("block", "is_query", "vec_id")
    found = dealt.mapInPandas(lambda frames: searched(frames, k, enough), "query_id long, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(f"rank <= {k}")
    return ranked.select("query_id", "rank", "vec_id", "score")
