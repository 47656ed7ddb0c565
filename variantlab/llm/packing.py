"""Best-fit packing of token sequences by a grouping genetic algorithm on islands.

Documents become token pieces of at most capacity ids; full pieces are sequences of their own. The others are
dealt to groups by hash, each evolved by several islands that start from different divisions: a chromosome is a
division into bins, a crossover injects whole well-filled bins of one parent into the other, removes the bins that
hold duplicates, and best-fits the displaced pieces; a mutation empties some bins and fills them anew, one after
another, each with its largest piece and the subset of the others that fills it most. An epoch evolves a group's
bins with room and some full ones, ACTIVE pieces at most, and leaves the other full bins as they are. After each epoch
an island also gets its neighbour's elite. Only lengths take part; ids stay in a stored table. A group is finished
when its best division meets the lower bound on bins, an epoch after STALL generations without a better one.

Groups are of bounded size at any input, so a group's last bin costs at most one sequence for GROUP pieces.

Defined results: null and empty texts give one piece of the end id; repeated rows are packed each;
a null doc_id is kept; other columns are ignored; an empty table gives empty results.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .encoding import encoded
from .frames import stored

GROUP = 8192
ISLANDS = 2
EPOCHS = 3
GENERATIONS = 60
STALL = 30
POPULATION = 4
#: Pieces that an epoch evolves, and those that a mutation takes out of their bins.
ACTIVE, EMPTIED = 1200, 100


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """(uid, doc_id, piece, start, length, ids): ids as little-endian unsigned 32-bit integers; uid names the row once stored."""

    def run(batches):
        context = TaskContext.get()
        uid = (context.partitionId() if context else 0) << 40
        for part, texts in encoded(batches, tokenizer):
            doc, piece, start, data = [], [], [], []
            for d, ids in zip(part.column("doc_id").to_pylist(), texts, strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for at in range(0, len(ids), capacity):
                    doc.append(d)
                    piece.append(at // capacity)
                    start.append(at)
                    data.append(ids[at : at + capacity].tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(uid, uid + len(doc))), pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array([len(x) // 4 for x in data], pa.int64()), pa.array(data, pa.binary())],
                names=["uid", "doc_id", "piece", "start", "length", "ids"],
            )
            uid += len(doc)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "uid long, doc_id long, piece int, start long, length long, ids binary")


def best_fit(lengths: np.ndarray, order: np.ndarray, bins: np.ndarray, free: list[int], capacity: int) -> None:
    """Puts the items of order, in that order, into the fullest bin that takes each; free grows with new bins."""
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for b, room in enumerate(free):
        if room > 0:
            open_bins[room].append(b)
            mask |= 1 << room
    for i in order.tolist():
        need = int(lengths[i])
        able = mask >> need
        if able:
            room = need + (able & -able).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                mask ^= 1 << room
        else:
            room, b = capacity, len(free)
            free.append(capacity)
        room -= need
        free[b] = room
        bins[i] = b
        if room:
            open_bins[room].append(b)
            mask |= 1 << room


def _packed(lengths: np.ndarray, order: np.ndarray, capacity: int) -> np.ndarray:
    bins = np.full(len(lengths), -1, np.int64)
    best_fit(lengths, order, bins, [], capacity)
    return bins


def _score(lengths: np.ndarray, bins: np.ndarray, capacity: int) -> tuple[int, float]:
    """Bins, then minus the mean squared fill: less is better."""
    fill = np.bincount(bins, weights=lengths) / capacity
    return len(fill), -float((fill**2).mean())


def _refit(lengths: np.ndarray, bins: np.ndarray, capacity: int) -> np.ndarray:
    """bins with its items of bin -1 placed by best fit decreasing, and bins renumbered."""
    out = bins.copy()
    held = out >= 0
    _, out[held] = np.unique(out[held], return_inverse=True)
    free = (capacity - np.bincount(out[held], weights=lengths[held]).astype(np.int64)).tolist() if held.any() else []
    loose = np.flatnonzero(~held)
    best_fit(lengths, loose[np.argsort(-lengths[loose], kind="stable")], out, free, capacity)
    return out


def crossover(lengths: np.ndarray, into: np.ndarray, giver: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Injects some of giver's well-filled bins whole, drops into's bins that share items, best-fits the displaced."""
    fill = np.bincount(giver, weights=lengths)
    chosen = (fill >= np.quantile(fill, 0.5)) & (rng.random(len(fill)) < rng.choice([0.05, 0.1, 0.3, 0.5]))
    moved = chosen[giver]
    hit = np.zeros(into.max() + 1, bool)
    hit[into[moved]] = True
    out = np.where(hit[into], -1, into)
    out[moved] = giver[moved] + into.max() + 1
    return _refit(lengths, out, capacity)


def filled_anew(lengths: np.ndarray, items: list[int], capacity: int, rng: np.random.Generator) -> list[list[int]]:
    """Bins of items: each takes the largest one left and the subset of the others, in random order, that fills it most."""
    free, out = sorted(items, key=lambda i: -lengths[i]), []
    while free:
        first = free.pop(0)
        room = capacity - int(lengths[first])
        order = [k for k in range(len(free)) if lengths[free[k]] <= room]
        rng.shuffle(order)
        sums, within = [1], (1 << (room + 1)) - 1  # bit n: some subset has the sum n
        for k in order:
            sums.append((sums[-1] | (sums[-1] << int(lengths[free[k]]))) & within)
            if sums[-1] >> room:
                break
        at, taken = sums[-1].bit_length() - 1, []
        for j in range(len(sums) - 1, 0, -1):
            if at and not sums[j - 1] >> at & 1:
                taken.append(order[j - 1])
                at -= int(lengths[free[order[j - 1]]])
        out.append([first, *(free.pop(k) for k in sorted(taken, reverse=True))])
    return out


def mutate(lengths: np.ndarray, bins: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Empties bins with room, and full ones if there are few of those, up to EMPTIED items, and fills them anew."""
    fill, held = np.bincount(bins, weights=lengths), np.bincount(bins)
    order = np.concatenate([rng.permutation(np.flatnonzero(fill < capacity)), rng.permutation(np.flatnonzero(fill >= capacity))])
    gone = np.zeros(len(fill), bool)
    gone[order[: max(2, int(np.searchsorted(np.cumsum(held[order]), EMPTIED)))]] = True
    loose = np.flatnonzero(gone[bins])
    out = bins + len(fill)
    for b, items in enumerate(filled_anew(lengths, loose.tolist(), capacity, rng)):
        out[items] = b
    return np.unique(out, return_inverse=True)[1]


def least_bins(lengths: np.ndarray, capacity: int) -> int:
    """A lower bound: the total, or for each size the items that cannot share a bin with another item of that size or more."""
    total = int(lengths.sum())
    s = np.sort(lengths)
    sums = np.concatenate(([0], np.cumsum(s)))
    best = -(-total // capacity)
    for least in range(1, capacity // 2 + 1, 32):
        lo, mid, hi = np.searchsorted(s, [least, capacity // 2 + 1, capacity - least + 1])
        room = (hi - mid) * capacity - (sums[hi] - sums[mid])
        best = max(best, len(s) - mid + max(0, -(-(sums[mid] - sums[lo] - room) // capacity)))
    return int(best)


def _noisy(lengths: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    return _packed(lengths, np.argsort(-(lengths * (1 + 0.2 * rng.random(len(lengths)))), kind="stable"), capacity)


def evolve(lengths: np.ndarray, start: list[np.ndarray], capacity: int, seed: int, generations: int, goal: int) -> np.ndarray:
    """The best division after some generations of a steady population, which holds start[0]'s active part, the same
    pieces as the others divide them, and noisy best fits."""
    rng = np.random.default_rng(seed)
    best = start[0]
    fill, held = np.bincount(best, weights=lengths), np.bincount(best)
    order = np.concatenate([rng.permutation(np.flatnonzero(fill < capacity)), rng.permutation(np.flatnonzero(fill >= capacity))])
    active = np.zeros(len(fill), bool)
    active[order[: max(2, int(np.searchsorted(np.cumsum(held[order]), ACTIVE)))]] = True
    own = np.flatnonzero(active[best])
    some, goal = lengths[own], goal - int((~active).sum())
    crowd = [np.unique(b[own], return_inverse=True)[1] for b in start]
    crowd += [_noisy(some, capacity, rng) for _ in range(POPULATION - len(crowd))]
    ranked = sorted(((_score(some, b, capacity), b) for b in crowd), key=lambda c: c[0])
    since = 0
    for _ in range(generations):
        if ranked[0][0][0] <= goal or since > STALL:
            break
        one, two = rng.choice(len(ranked), 2, replace=False)
        child = mutate(some, crossover(some, ranked[one][1], ranked[two][1], capacity, rng), capacity, rng)
        score = _score(some, child, capacity)
        since = 0 if score < ranked[0][0] else since + 1
        if score < ranked[-1][0] and all(score != c[0] for c in ranked):
            ranked = sorted([*ranked[:-1], (score, child)], key=lambda c: c[0])
    out = best + len(lengths)
    out[own] = ranked[0][1]
    out = np.unique(out, return_inverse=True)[1]
    return min([best, out], key=lambda b: _score(lengths, b, capacity))


_STATE = "grp long, island int, uids binary, lengths binary, bins binary, goal long"


def _founded(pdf: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """A group's islands: the first starts from best fit decreasing, the others from noisy best fits of their own."""
    pdf = pdf.sort_values("uid")
    uids, lengths = pdf.uid.to_numpy(np.int64), pdf.length.to_numpy(np.int64)
    goal = least_bins(lengths, capacity)
    group = int(pdf.grp.iloc[0])
    bins = [_packed(lengths, np.argsort(-lengths, kind="stable"), capacity)]
    bins += [_noisy(lengths, capacity, np.random.default_rng((group, k))) for k in range(1, ISLANDS)]
    return pd.DataFrame([(group, k, uids.tobytes(), lengths.astype(np.int32).tobytes(), b.astype(np.int32).tobytes(), goal) for k, b in enumerate(bins)], columns=["grp", "island", "uids", "lengths", "bins", "goal"])


def _epoch(state: DataFrame, capacity: int, epoch: int) -> DataFrame:
    """One epoch of every island, which starts from its own elite and its neighbour's of the epoch before."""

    def run(frames):
        for pdf in frames:
            out = []
            for row in pdf.itertuples():
                lengths = np.frombuffer(row.lengths, np.int32).astype(np.int64)
                own, other = (np.frombuffer(b, np.int32).astype(np.int64) for b in (row.bins, row.guest))
                start = [own] if row.bins == row.guest else [own, other]
                seed = (row.grp * ISLANDS + row.island) * EPOCHS + epoch
                finished = min(own.max(), other.max()) + 1 <= row.goal
                out.append(own if finished else evolve(lengths, start, capacity, seed, GENERATIONS, row.goal))
            yield pdf.drop(columns="guest").assign(bins=[b.astype(np.int32).tobytes() for b in out])

    guest = state.select("grp", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).cast("int").alias("island"), F.col("bins").alias("guest"))
    tasks = int(state.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return state.join(guest, ["grp", "island"]).select("grp", "island", "uids", "lengths", "bins", "goal", "guest").repartition(tasks, "grp", "island").mapInPandas(run, _STATE)


def _layout(state: DataFrame, capacity: int) -> DataFrame:
    """(uid, sequence_id, offset) of each group's best island."""

    def run(frames):
        for pdf in frames:
            for row in pdf.itertuples():
                uids, lengths, bins = np.frombuffer(row.uids, np.int64), np.frombuffer(row.lengths, np.int32).astype(np.int64), np.frombuffer(row.bins, np.int32)
                order = np.lexsort((uids, bins))
                ends = np.cumsum(lengths[order])
                begin = ends - lengths[order]
                new = np.concatenate(([True], np.diff(bins[order]) > 0))
                base = np.maximum.accumulate(np.where(new, begin, 0))
                yield pd.DataFrame({"uid": uids[order], "sequence_id": (np.int64(row.grp) << 20) + bins[order], "offset": begin - base})

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        scores = [_score(np.frombuffer(r.lengths, np.int32), np.frombuffer(r.bins, np.int32), capacity) for r in pdf.itertuples()]
        return pdf.iloc[[min(range(len(scores)), key=lambda i: (scores[i], pdf.island.iloc[i]))]]

    return state.groupBy("grp").applyInPandas(best, _STATE).mapInPandas(run, "uid long, sequence_id long, offset long")


@dataclass
class Packed:
    """pieces: uid, doc_id, piece, start, length, ids. layout: uid, sequence_id, offset."""

    pieces: DataFrame
    layout: DataFrame

    def sequences(self) -> DataFrame:
        """Each piece with its ids and its place."""
        return self.pieces.join(self.layout, "uid")


def islands(part: DataFrame, capacity: int) -> DataFrame:
    """(uid, sequence_id, offset) of pieces (uid, length, grp), by the best of each group's islands after all epochs."""
    tasks = int(part.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    state = part.repartition(tasks, "grp").groupBy("grp").applyInPandas(lambda pdf: _founded(pdf, capacity), _STATE)
    for epoch in range(EPOCHS):
        state = _epoch(stored(state, "islands"), capacity, epoch)
    return _layout(stored(state, "islands"), capacity)


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 2048) -> Packed:
    pieces = stored(token_pieces(docs, tokenizer, end_id, capacity), "pieces")
    part = pieces.where(F.col("length") < capacity).select("uid", "length")
    groups = max(1, -(-part.count() // GROUP))
    dealt = part.withColumn("grp", F.pmod(F.xxhash64("uid"), F.lit(groups)))
    full = pieces.where(F.col("length") == capacity).select("uid", (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return Packed(pieces, islands(dealt, capacity).unionByName(full))
