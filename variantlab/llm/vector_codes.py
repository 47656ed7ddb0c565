"""Vector code compression: product codes whose nearest entries are found by VA-file filtering.

Components become integers, vectors are cut into equal parts, and each part position has a codebook of integer
entries. The entries of a codebook are a small vector approximation file: every coordinate of an entry is quantised
to BITS bits, the cell that holds it. A query (a part) makes a lookup table of the least and greatest squared
gaps to each cell of each coordinate; table values added over coordinates are bounds on the distance to each
entry. Entries whose lower bound is above the least upper bound are out; the others are refined by their integer
distances. Bounds and distances are integers, so the nearest entry, with ties to the lower index, is exact.

A round of learning is one scan: tasks add up their parts by entry, Spark adds the sums of tasks, and the driver
receives entries times components numbers. Codebooks travel with the tasks (as many numbers).

Defined results: vectors that are null or hold null or non-finite components take no part, neither do those of
another length than that of the smallest vec_id's vector (then the smallest vector), as a distance to them has no
meaning; a length that is no multiple of the parts is filled up with zeros; integers beyond 2**25 in absolute value
count as 2**25, so that distances fit into 64 bits; rows with a null vec_id are coded and come last in the order
of vec_ids; repeated rows are coded each, equal vec_ids go by their vectors; fewer vectors than entries give a
smaller codebook; errors of equal labels (nulls together) that exceed a long together are null; other columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from .frames import keyed, stored

#: Bits of a cell: entries of a codebook are dealt into 2**BITS cells for each coordinate.
BITS = 3
SCALE, LIMIT = 256.0, 1 << 25
#: Vectors that are coded at once.
_BATCH = 2048


class Cells:
    """One codebook with the cells of its coordinates."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        k, d = entries.shape
        n = 1 << BITS
        self.cell = np.zeros((d, k), np.intp)
        self.low, self.high = np.zeros((d, n), np.int64), np.zeros((d, n), np.int64)
        for j in range(d):
            x = entries[:, j]
            marks = np.sort(x)[np.arange(n) * k // n]  # as many entries in each cell, equal coordinates in one
            self.cell[j] = np.searchsorted(marks, x, side="right") - 1
            self.low[j] = self.high[j] = marks
            np.maximum.at(self.high[j], self.cell[j], x)

    def bounds(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds (parts, entries) on squared distances, from tables by coordinate and cell."""
        low = np.zeros((len(parts), len(self.entries)), np.int64)
        high = np.zeros_like(low)
        for j, cell in enumerate(self.cell):
            x = parts[:, j, None]
            under, over = self.low[j] - x, x - self.high[j]
            near = np.maximum(np.maximum(under, over), 0)
            far = np.maximum(np.abs(under), np.abs(over))
            low += (near * near)[:, cell]
            high += (far * far)[:, cell]
        return low, high

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Each part's nearest entry, the squared distance, and how many distances were worked out in all."""
        low, high = self.bounds(parts)
        part, entry = np.nonzero(low <= high.min(axis=1, keepdims=True))
        apart = parts[part] - self.entries[entry]
        distance = (apart * apart).sum(axis=1)
        starts = np.searchsorted(part, np.arange(len(parts)))  # every part keeps the entry of its least upper bound
        least = np.minimum.reduceat(distance, starts)
        hit = np.flatnonzero(distance == least[part])
        first = hit[np.searchsorted(part[hit], np.arange(len(parts)))]
        return entry[first], least, len(part)


@dataclass
class Codebooks:
    """Entries (part, entry, component) of vectors of length components."""

    entries: np.ndarray
    length: int

    def cells(self) -> list[Cells]:
        return [Cells(e) for e in self.entries]

    def cut(self, flat: np.ndarray, n: int) -> np.ndarray:
        """Components of n vectors as integer parts (n, part, component)."""
        parts, _, d = self.entries.shape
        out = np.zeros((n, parts * d), np.int64)
        out[:, : self.length] = integers(flat).reshape(n, self.length)
        return out.reshape(n, parts, d)

    def numbers(self) -> list[int]:
        """All integer components by part, entry and place, without the filling."""
        parts, k, d = self.entries.shape
        real = (np.arange(parts * d) < self.length).reshape(parts, 1, d).repeat(k, axis=1)
        return self.entries[real].tolist()

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.numbers())).encode()).hexdigest()


def integers(x: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(np.asarray(x, np.float64) * SCALE), -LIMIT, LIMIT).astype(np.int64)


def usable(vectors: DataFrame, *others: str) -> DataFrame:
    """(vec_id, v, others) of vectors without null or non-finite components."""
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v"), *others)
    return rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def _first(rows: DataFrame, n: int) -> list[list[float]]:
    return [r[0] for r in rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(n).select("v").collect()]


def _batches(batches, books: Codebooks):
    """Slices of (batch, parts)."""
    for batch in batches:
        for at in range(0, batch.num_rows, _BATCH):
            part = batch.slice(at, _BATCH)
            yield part, books.cut(part.column("v").flatten().to_numpy(zero_copy_only=False), part.num_rows)


def _improved(rows: DataFrame, books: Codebooks) -> Codebooks:
    """The codebooks after one round: every used entry is the floor of its parts' mean."""

    def run(batches):
        cells = books.cells()
        count, total = np.zeros(books.entries.shape[:2], np.int64), np.zeros_like(books.entries)
        for _, parts in _batches(batches, books):
            for p, codebook in enumerate(cells):
                entry, _, _ = codebook.nearest(parts[:, p])
                count[p] += np.bincount(entry, minlength=count.shape[1])
                np.add.at(total[p], entry, parts[:, p])
        part, entry = np.nonzero(count)
        d = total.shape[2]
        columns = np.repeat(part, d), np.repeat(entry, d), np.tile(np.arange(d), len(part)), np.repeat(count[part, entry], d), total[part, entry].ravel()
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["part", "entry", "place", "n", "total"])

    sums = rows.select("v").mapInArrow(run, "part long, entry long, place long, n long, total long")
    sums = sums.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    entries = books.entries.copy()
    for r in sums.collect():  # as many rows as codebooks have components
        entries[r.part, r.entry, r.place] = int(r.total) // r.n
    return Codebooks(entries, books.length)


def learned(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> tuple[DataFrame, Codebooks]:
    """The rows (vec_id, v, ..) that take part, and codebooks that start as the parts of the smallest vec_ids."""
    first = _first(vectors, entries)
    length = len(first[0]) if first else 0
    rows = vectors.where(F.size("v") == length)
    if any(len(v) != length for v in first):
        first = _first(rows, entries)
    books = Codebooks(np.zeros((parts, len(first), -(-length // parts)), np.int64), length)
    books.entries[:] = books.cut(np.array(first, np.float64).ravel(), len(first)).transpose(1, 0, 2)
    for _ in range(rounds if first else 0):
        books = _improved(rows, books)
    return rows, books


def encoded(rows: DataFrame, books: Codebooks) -> DataFrame:
    """rows with code (two hex digits a part) and error (squared distances summed over parts) in place of v."""
    others = [c for c in rows.columns if c != "v"]

    def run(batches):
        cells = books.cells()
        for batch, parts in _batches(batches, books):
            found = [codebook.nearest(parts[:, p]) for p, codebook in enumerate(cells)]
            digits = np.stack([f[0] for f in found], axis=1).astype(np.uint8).tobytes().hex()
            width = 2 * len(cells)
            codes = [digits[k * width : (k + 1) * width] for k in range(len(parts))]
            error = np.sum([f[1] for f in found], axis=0)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in others], pa.array(codes, pa.string()), pa.array(error)], names=[*others, "code", "error"])

    schema = rows.select(*others).schema.add("code", "string").add("error", "long")
    return rows.mapInArrow(run, schema)


def decoded(codes: DataFrame, books: Codebooks) -> DataFrame:
    """codes with v: the entries that a code names, as components."""

    def run(batches):
        parts = len(books.entries)
        for batch in batches:
            code = np.frombuffer(bytes.fromhex("".join(batch.column("code").to_pylist())), np.uint8).reshape(-1, parts)
            v = books.entries[np.arange(parts), code].reshape(len(code), -1)[:, : books.length] / SCALE
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(v), pa.list_(pa.float64()))], names=[*batch.schema.names, "v"])

    return codes.mapInArrow(run, StructType([*codes.schema, StructField("v", ArrayType(DoubleType()))]))


def compressed(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> tuple[DataFrame, Codebooks]:
    """(vec_id, label, code, error, label_error) of vectors (vec_id, embedding, label), and the codebooks."""
    rows, books = learned(usable(vectors, "label"), parts, entries, rounds)
    # nulls become a key of their own, as a join leaves them out
    codes = stored(encoded(rows, books).select("*", F.col("label").isNull().alias("none"), F.coalesce("label", F.lit(0)).alias("key")), "codes")
    errors = stored(codes.groupBy("none", "key").agg(F.try_sum("error").alias("label_error")), "label-errors")
    return keyed(codes, errors, ["none", "key"], "left").select("vec_id", "label", "code", "error", "label_error"), books
