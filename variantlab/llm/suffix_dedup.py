"""Removal of repeated byte strings by a hash-compared suffix sort.

A window is a string of LENGTH bytes; its key is the least hash of its grams (strings of two fifths of that), so
equal windows have equal keys, and neighbouring windows share the gram that gives it, their anchor. Windows in a row
with one anchor are a stretch: its body is all of their bytes. Stretches go to the part of their key:
- of equal bodies (by hashes of body and key) the first in the order of documents stays, all windows of the others repeat it;
- bodies that are alone under their key repeat nothing;
- different bodies under one key may share some of their windows. Only their bytes are fetched. Suffixes of these bodies
  with an equal distance to the anchor are sorted by a merge sort whose comparisons find the common extension of two
  suffixes by binary search over prefix polynomial hashes, in logarithmic time; neighbours of the sorted order are
  then compared byte by byte, and where hashes misled the sort, the part is sorted by bytes. Of equal windows the first stays.

Before they are shuffled, stretches are reduced to one of each body in a task, and a stretch takes about 17 bytes.
Keys under which tasks meet many different bodies (a common line in different surroundings) are counted first; their
stretches are cut into single windows, each under a key of its own, so that no part receives more of one key than tasks
send single copies. The list of these keys is bounded and shapes only how stretches are dealt, not what is found.

Bytes are removed if a repeated window covers them. Documents are ordered by doc_id, nulls last. Where doc_ids are
unique and not null they name the documents; otherwise rows are numbered and stored, and rows of one doc_id go by their number.

Defined results: null and empty texts have no bytes; texts shorter than a window lose none; repeated rows lose all
bytes but in the first; a null doc_id is kept and comes after all others; very long texts are worked through in pieces; other
columns are ignored; an empty table gives an empty result. What is kept is bytes, as a cut may go through a character.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .frames import dropped, stored, word_text
from .words import mix

LENGTH = 100
#: Bytes that are hashed at once.
PIECE = 1 << 18
#: Stretches that a task reduces at once.
REDUCED = 500_000
#: Keys of this many bodies in one task are reported, and cut into windows if they have HEAVY in all; the most frequent ones, at most HEAVY_KEPT, 8 bytes each.
LOCAL_HEAVY, HEAVY, HEAVY_KEPT = 8, 1000, 1 << 17
PART_STRETCHES, LEAST_PARTS = 400_000, 32
#: Bodies that one task sorts.
PART_BODIES = 8_000

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BYTES = np.random.default_rng(11).integers(0, 1 << 64, 256, np.uint64, endpoint=False)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Hashed:
    """Bytes with their prefix polynomial hashes, modulo 2**64: equal strings have equal hashes wherever they are."""

    _up = _down = np.zeros(0, np.uint64)

    def __init__(self, data: np.ndarray) -> None:
        if len(Hashed._up) <= len(data):
            n = len(data) + PIECE
            Hashed._up, Hashed._down = _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)
        self.data = data
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[data] * Hashed._up[: len(data)], out=self.prefix[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (self.prefix[stop] - self.prefix[start]) * Hashed._down[start]

    def all(self, n: int) -> np.ndarray:
        """Hashes of all strings of n bytes."""
        count = len(self.data) - n + 1
        return (self.prefix[n:] - self.prefix[:count]) * Hashed._down[:count]

    def common(self, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
        """How many bytes, at most most, the strings at a and b have in common, by binary search over their hashes."""
        n = np.zeros(len(a), np.int64)
        step = 1 << (most.bit_length() - 1)
        while step:
            fits = n + step <= most
            x, y = np.where(fits, a + n, 0), np.where(fits, b + n, 0)
            n += np.where(fits & (self.of(x, x + step * fits) == self.of(y, y + step * fits)), step, 0)
            step >>= 1
        return n


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """The least of each n values in a row."""
    size = 1
    while 2 * size <= n:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (n - size)], x[n - size :]) if n > size else x


def _gram(length: int) -> int:
    return max(1, 2 * length // 5)


def stretches(data: np.ndarray, stops: np.ndarray, length: int, heavy: np.ndarray) -> tuple[np.ndarray, ...]:
    """(start, windows, key, body) of the stretches of texts that lie in data one after another, up to stops."""
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    text = Hashed(data)
    grams = mix(text.all(_gram(length)))
    least = _least(grams, length - _gram(length) + 1)
    n = len(least)
    begins = np.ones(n, bool)
    begins[1:] = (grams[: n - 1] == least[:-1]) | (least[1:] != least[:-1])  # the anchor was the first gram, or another is less
    inside = np.ones(n, bool)
    for stop in stops[:-1].tolist():  # windows across texts
        inside[max(0, stop - length + 1) : stop] = False
        begins[max(0, stop - length + 1) : stop + 1] = True
    start = np.flatnonzero(begins)
    windows = np.diff(np.append(start, n))
    keep = inside[start]
    start, windows = start[keep], windows[keep]
    key = mix(least[start])
    if len(heavy):
        cut = np.minimum(np.searchsorted(heavy, key), len(heavy) - 1)
        cut = heavy[cut] == key
        single = np.repeat(start[cut], windows[cut]) + np.arange(windows[cut].sum()) - np.repeat(np.cumsum(windows[cut]) - windows[cut], windows[cut])
        start, windows = np.concatenate((start[~cut], single)), np.concatenate((windows[~cut], np.ones(len(single), np.int64)))
        key = np.concatenate((key[~cut], mix(text.of(single, single + length) ^ _U(0x5BF03635))))
    size = windows + (length - 1)
    return start, windows, key, mix(text.of(start, start + size) + size.astype(np.uint64))


class Texts:
    """Texts of a batch in pieces of bounded size: (data, stops, row and offset of each text or part of one)."""

    def __init__(self, texts: list[bytes], length: int) -> None:
        self.texts, self.length = texts, length

    def pieces(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        own: list[tuple[int, int, bytes]] = []
        size = 0
        for row, text in enumerate(self.texts):
            if len(text) < self.length:
                continue
            for at in range(0, len(text) - self.length + 1, PIECE):
                part = text[at : at + PIECE + self.length - 1]
                if size and size + len(part) > PIECE:
                    yield self._joined(own)
                    own, size = [], 0
                own.append((row, at, part))
                size += len(part)
        if own:
            yield self._joined(own)

    @staticmethod
    def _joined(own):
        stops = np.cumsum([len(x) for _, _, x in own])
        return np.frombuffer(b"".join(x for _, _, x in own), np.uint8), stops, np.array([r for r, _, _ in own]), np.array([at for _, at, _ in own])


def _found(batch: pa.RecordBatch, length: int, heavy: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, start, windows, key, body) of a batch's stretches, piece by piece."""
    for data, stops, rows, offsets in Texts(batch.column("text").to_pylist(), length).pieces():
        start, windows, key, body = stretches(data, stops, length, heavy)
        at = np.searchsorted(stops, start, side="right")
        begin = np.concatenate(([0], stops[:-1]))
        yield rows[at], offsets[at] + start - begin[at], windows, key, body


def _numbers(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return batch.column(column).fill_null(0).to_numpy(zero_copy_only=False)


def _slices(batches, rows: int = 2000) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def heavy_keys(docs: DataFrame, length: int) -> tuple[np.ndarray, int]:
    """Keys with many bodies, sorted, and the number of stretches."""

    def run(batches):
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        total = size = 0

        def settled():
            key, body = (np.concatenate(x) for x in zip(*kept, strict=True))
            order = np.lexsort((body, key))
            key, body = key[order], body[order]
            new = np.concatenate(([True], (key[1:] != key[:-1]) | (body[1:] != body[:-1])))
            key, count = np.unique(key[new], return_counts=True)
            many = count >= LOCAL_HEAVY
            return pa.RecordBatch.from_arrays([pa.array(key[many].view(np.int64)), pa.array(count[many])], names=["key", "n"])

        for batch in _slices(batches):
            for _, _, _, key, body in _found(batch, length, np.zeros(0, np.uint64)):
                kept.append((key, body))
                size += len(key)
                total += len(key)
            if size > REDUCED:
                yield settled()
                kept.clear()
                size = 0
        if kept:
            yield settled()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([total], pa.int64())], names=["key", "n"])

    counts = stored(docs.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "heavy")
    total = counts.where("key IS NULL").first()
    top = counts.where(f"key IS NOT NULL AND n >= {HEAVY}").orderBy(F.desc("n"), "key").limit(HEAVY_KEPT).collect()
    dropped(counts)
    return np.sort(np.array([r.key for r in top], np.int64).view(np.uint64)), total.n if total else 0


def _pack(x: np.ndarray) -> bytes:
    return zlib.compress(x.tobytes(), 1)


def _deltas(x: np.ndarray) -> bytes:
    return _pack(np.diff(x, prepend=np.int64(0)))


def _unpacked(column, kind: str) -> list[np.ndarray]:
    return [np.frombuffer(zlib.decompress(v), kind) for v in column]


def _ranks(ids: np.ndarray, tags: np.ndarray) -> np.ndarray:
    """The place of each document in their order; tags below 0 have no doc_id."""
    order = np.lexsort((np.where(tags < 0, -1 - tags, tags), np.where(tags < 0, 0, ids), tags < 0))
    new = np.concatenate(([0], (tags[order[1:]] != tags[order[:-1]]).astype(np.int64)))
    out = np.empty(len(ids), np.int64)
    out[order] = np.cumsum(new)
    return out


def _joined(tag: np.ndarray, start: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of windows, those that follow one another as one."""
    order = np.lexsort((start, tag))
    tag, start, windows = tag[order], start[order], windows[order]
    new = np.flatnonzero(np.concatenate(([True], (tag[1:] != tag[:-1]) | (start[1:] != start[:-1] + windows[:-1]))))
    return (tag[new], start[new], np.add.reduceat(windows, new)) if len(tag) else (tag, start, windows)


_PACKS = "part int, kind int, ids binary, tags binary, counts binary, starts binary, windows binary, keys binary, bodies binary"


def packs(docs: DataFrame, length: int, heavy: np.ndarray, parts: int) -> DataFrame:
    """The stretches of docs (tag, doc_id, text), packed by the part of their key. kind 0: one of each body in a task; 1: windows that repeat one of these."""
    link = docs.sparkSession.sparkContext.broadcast(heavy)

    def rows(part: np.ndarray, kind: int, doc: np.ndarray, ids, tags, start, windows, key, body):
        order = np.lexsort((start, tags[doc], part))
        part, doc, start, windows = part[order], doc[order], start[order], windows[order]
        cut = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        for a, b in zip(cut, [*cut[1:], len(part)], strict=True):
            first = np.flatnonzero(np.concatenate(([True], doc[a + 1 : b] != doc[a : b - 1])))
            own = doc[a:b][first]
            counts = np.diff(np.append(first, b - a)).astype(np.int32)
            sent = [(key[order[a:b]] >> _U(32)).astype(np.uint32).tobytes(), body[order[a:b]].tobytes()] if kind == 0 else [b"", b""]
            yield (int(part[a]), kind, _deltas(ids[own]), _deltas(tags[own]), _pack(counts), _pack(start[a:b].astype(np.int32)), _pack(windows[a:b].astype(np.int32)), *sent)

    def reduced(kept, ids, tags):
        doc, start, windows, key, body = (np.concatenate(x) for x in zip(*kept, strict=True))
        ids, tags = np.concatenate(ids), np.concatenate(tags)
        both = mix(key + mix(body))
        order = np.lexsort((start, _ranks(ids, tags)[doc], both))
        new = np.concatenate(([True], both[order[1:]] != both[order[:-1]]))
        one, others = order[new], order[~new]
        goes = ((key & _U(0xFFFFFFFF)) % _U(parts)).astype(np.int64)
        found = list(rows(goes[one], 0, doc[one], ids, tags, start[one], windows[one], key[one], body[one]))
        if len(others):
            _, index = np.unique(tags, return_index=True)
            tag, at, n = _joined(tags[doc[others]], start[others], windows[others])
            owner = index[np.searchsorted(tags[index], tag)]
            found += rows((mix(owner.astype(np.uint64)) % _U(parts)).astype(np.int64), 1, owner, ids, tags, at, n, None, None)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), [pa.int32()] * 2 + [pa.binary()] * 7, strict=True)], names=[c.split()[0] for c in _PACKS.split(", ")])

    def run(batches):
        kept, ids, tags = [], [], []
        size = base = 0
        for batch in _slices(batches):
            ids.append(_numbers(batch, "doc_id"))
            tags.append(_numbers(batch, "tag"))
            for row, *rest in _found(batch, length, link.value):
                kept.append((base + row, *rest))
                size += len(row)
            base += batch.num_rows
            if size > REDUCED:
                yield reduced(kept, ids, tags)
                kept, ids, tags, size, base = [], [], [], 0, 0
        if size:
            yield reduced(kept, ids, tags)

    return docs.mapInArrow(run, _PACKS)


def gather(packed: DataFrame, parts: int) -> DataFrame:
    """(kind, tag, start, windows, key): kind 0 windows that repeat earlier ones; 1: stretches whose key has other bodies, one of each body."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for kind, rows in pdf.groupby("kind"):
            counts = _unpacked(rows["counts"], "i4")
            ids, tags = (np.concatenate([np.cumsum(x) for x in _unpacked(rows[c], "i8")]) for c in ("ids", "tags"))
            doc = np.repeat(np.arange(len(ids)), np.concatenate(counts))
            start, windows = (np.concatenate(_unpacked(rows[c], "i4")).astype(np.int64) for c in ("starts", "windows"))
            if kind == 1:
                out.append((0, tags[doc], start, windows, np.zeros(len(doc), np.int64)))
                continue
            key = np.concatenate([np.frombuffer(v, np.uint32) for v in rows["keys"]]).astype(np.int64)
            body = np.concatenate([np.frombuffer(v, np.uint64) for v in rows["bodies"]])
            order = np.lexsort((start, _ranks(ids, tags)[doc], body, key))
            key, body, start, windows, tag = key[order], body[order], start[order], windows[order], tags[doc[order]]
            fresh = np.concatenate(([True], key[1:] != key[:-1]))
            new = fresh | np.concatenate(([True], body[1:] != body[:-1]))
            out.append((0, tag[~new], start[~new], windows[~new], np.zeros((~new).sum(), np.int64)))
            own = np.cumsum(fresh) - 1
            several = new & (np.bincount(own, weights=new) > 1)[own]
            out.append((1, tag[several], start[several], windows[several], key[several] * parts + int(rows["part"].iloc[0])))
        return pd.concat([pd.DataFrame({"kind": np.int32(k), "tag": t, "start": s, "windows": w, "key": key}) for k, t, s, w, key in out], ignore_index=True)

    tasks = max(int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions")), parts // 8)
    return packed.repartition(tasks, "part").groupBy("part").applyInPandas(run, "kind int, tag long, start long, windows long, key long")


class Suffixes:
    """Suffixes at places of a text that are sorted within groups, by length bytes and then by rank."""

    def __init__(self, text: Hashed, place: np.ndarray, group: np.ndarray, rank: np.ndarray, length: int) -> None:
        by_group = np.argsort(group, kind="stable")
        self.text, self.length = text, length
        self.place, self.rank, group = place[by_group], rank[by_group], group[by_group]
        self.index = by_group
        first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))[: len(group)]
        size = np.diff(np.append(first, len(group)))
        self.first, self.size = np.repeat(first, size), np.repeat(size, size)

    def less(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the suffix at row a comes before that at row b."""
        x, y = self.place[a], self.place[b]
        n = self.text.common(x, y, self.length)
        same = n == self.length
        at = np.where(same, 0, n)
        return np.where(same, self.rank[a] < self.rank[b], self.text.data[x + at] < self.text.data[y + at])

    def sort(self) -> np.ndarray:
        """Merge sort of all groups at once, runs of width rows at a time; every row finds its place in the other run by binary search. Rows in order."""
        row = np.arange(len(self.place))
        width = 1
        while width < self.size.max(initial=0):
            at = np.flatnonzero(self.size > width)
            first, size = self.first[at], self.size[at]
            within = at - first
            block = within - within % (2 * width)
            left = within < block + width
            low = np.minimum(np.where(left, block + width, block), size)
            high = np.minimum(np.where(left, block + 2 * width, block + width), size)
            begin, end = low.copy(), high.copy()
            todo = np.flatnonzero(begin < end)
            while len(todo):
                middle = (begin[todo] + end[todo]) // 2
                before = self.less(row[first[todo] + middle], row[at[todo]])
                begin[todo] = np.where(before, middle + 1, begin[todo])
                end[todo] = np.where(before, end[todo], middle)
                todo = todo[begin[todo] < end[todo]]
            after = row.copy()
            after[first + block + (within - np.where(left, block, block + width)) + (begin - low)] = row[at]
            row = after
            width *= 2
        return row

    def classes(self, row: np.ndarray, step: int = 1 << 16) -> np.ndarray | None:
        """Whether each sorted suffix begins a class of equal ones, byte by byte; None if the order isn't that of the bytes."""
        new = np.ones(len(row), bool)
        reach = np.arange(self.length)
        for at in range(0, len(row), step):
            part = row[max(0, at - 1) : at + step]
            if len(part) < 2:
                continue
            bytes_ = self.text.data[self.place[part][:, None] + reach]
            apart = bytes_[1:] != bytes_[:-1]
            where = apart.argmax(axis=1)
            differs = apart[np.arange(len(where)), where]
            pick = np.arange(len(where))
            rises = np.where(differs, bytes_[1:][pick, where] > bytes_[:-1][pick, where], self.rank[part[1:]] > self.rank[part[:-1]])
            same_group = self.first[part[1:]] == self.first[part[:-1]]
            if not (rises | ~same_group).all():
                return None
            new[max(1, at) : at + len(part) - (at > 0)] = differs | ~same_group
        return new

    def by_bytes(self) -> np.ndarray:
        """The order without hashes, for texts whose hashes mislead."""
        text = self.text.data.tobytes()
        return np.array(sorted(range(len(self.place)), key=lambda k: (self.first[k], text[self.place[k] : self.place[k] + self.length], self.rank[k])), np.int64)

    def repeats(self) -> np.ndarray:
        """Indexes, as given, of suffixes that equal an earlier one of their group."""
        row = self.sort()
        new = self.classes(row)
        if new is None:
            row = self.by_bytes()
            new = self.classes(row)
        return self.index[row[~new]]


_BODIES = "part int, ids binary, tags binary, starts binary, windows binary, keys binary, bytes binary"


def bodies(docs: DataFrame, length: int, parts: int) -> DataFrame:
    """The bytes of the stretches that rows (tag, doc_id, text, asked) ask for, packed by the part of their key."""

    def run(batches):
        for batch in _slices(batches, 200):
            lists = batch.column("asked")
            count = np.asarray(lists.value_lengths())
            asked = lists.flatten()
            start, windows, key = (asked.field(k).to_numpy(zero_copy_only=False) for k in range(3))
            row = np.repeat(np.arange(batch.num_rows), count)
            ids, tags = _numbers(batch, "doc_id")[row], _numbers(batch, "tag")[row]
            texts = batch.column("text").to_pylist()
            part = (mix(key.view(np.uint64)) % _U(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            cut = np.flatnonzero(np.concatenate(([True], part[order[1:]] != part[order[:-1]])))[: len(part)]
            out = []
            for a, b in zip(cut, [*cut[1:], len(part)], strict=True):
                own = order[a:b]
                taken = b"".join([texts[r][s : s + n] for r, s, n in zip(row[own].tolist(), start[own].tolist(), (windows[own] + (length - 1)).tolist(), strict=True)])
                out.append((int(part[own[0]]), _deltas(ids[own]), _deltas(tags[own]), _pack(start[own]), _pack(windows[own]), key[own].tobytes(), taken))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int32()] + [pa.binary()] * 6, strict=True)], names=[c.split()[0] for c in _BODIES.split(", ")])

    return docs.mapInArrow(run, _BODIES)


def repeated_windows(packed: DataFrame, length: int) -> DataFrame:
    """(tag, start, windows) of windows that repeat one of an earlier body of their key, from bodies()."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, tags = (np.concatenate([np.cumsum(x) for x in _unpacked(pdf[c], "i8")]) for c in ("ids", "tags"))
        start, windows = (np.concatenate(_unpacked(pdf[c], "i8")) for c in ("starts", "windows"))
        key = np.concatenate([np.frombuffer(v, np.int64) for v in pdf["keys"]])
        text = Hashed(np.frombuffer(b"".join(pdf["bytes"]), np.uint8))
        begin = np.cumsum(windows + (length - 1)) - (windows + (length - 1))
        # a stretch's anchor is the least gram of its first window, the first of equal ones
        span = length - _gram(length) + 1
        grams = mix(text.all(_gram(length)))
        anchor = np.concatenate([grams[begin[a : a + 4096, None] + np.arange(span)].argmin(axis=1) for a in range(0, len(begin), 4096)])
        owner = np.repeat(np.arange(len(start)), windows)
        shift = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
        group = np.unique(key, return_inverse=True)[1][owner] * length + (anchor[owner] - shift)
        rank = np.empty(len(owner), np.int64)
        rank[np.lexsort((start[owner] + shift, _ranks(ids, tags)[owner]))] = np.arange(len(owner))
        found = Suffixes(text, begin[owner] + shift, group, rank, length).repeats()
        tag, at, n = _joined(tags[owner[found]], (start[owner] + shift)[found], np.ones(len(found), np.int64))
        return pd.DataFrame({"tag": tag, "start": at, "windows": n})

    tasks = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return packed.repartition(tasks, "part").groupBy("part").applyInPandas(run, "tag long, start long, windows long")


def named(docs: DataFrame) -> DataFrame:
    """(tag, doc_id, text as bytes): tag is the doc_id where these name the rows, otherwise a stored row number, -1 - number for null doc_ids."""
    text = word_text().cast("binary").alias("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text)
    ids = rows.groupBy("doc_id").count()
    if ids.where("doc_id IS NULL OR doc_id < 0 OR count > 1").isEmpty():
        return rows.select(F.col("doc_id").alias("tag"), "doc_id", "text")
    number = F.monotonically_increasing_id()
    return stored(rows.select(F.when(F.col("doc_id").isNull(), -1 - number).otherwise(number).alias("tag"), "doc_id", "text"), "numbered")


SPANS = "array<struct<start:bigint,end:bigint>>"


def _cut(docs: DataFrame, length: int) -> DataFrame:
    """(doc_id, n_bytes, removed, kept) of rows (doc_id, text, repeats)."""
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def one(text: bytes, start: np.ndarray, windows: np.ndarray) -> tuple[list[dict], bytes]:
        if not len(start):
            return [], text
        order = np.argsort(start, kind="stable")
        start, end = start[order], np.maximum.accumulate((start + windows + (length - 1))[order])
        first = np.flatnonzero(np.concatenate(([True], start[1:] > end[:-1])))
        starts, ends = start[first].tolist(), end[np.append(first[1:], len(end)) - 1].tolist()
        kept = b"".join([text[a:b] for a, b in zip([0, *ends], [*starts, len(text)], strict=True)])
        return [{"start": a, "end": b} for a, b in zip(starts, ends, strict=True)], kept

    def run(batches):
        for batch in _slices(batches, 500):
            texts, lists = batch.column("text").to_pylist(), batch.column("repeats")
            stop = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            start, windows = (lists.flatten().field(k).to_numpy(zero_copy_only=False) for k in range(2))
            found = [one(t, start[a:b], windows[a:b]) for t, a, b in zip(texts, [0, *stop[:-1]], stop, strict=True)]
            columns = [batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array([f[0] for f in found], pa.list_(span)), pa.array([f[1] for f in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "removed", "kept"])

    return docs.mapInArrow(run, f"doc_id long, n_bytes long, removed {SPANS}, kept binary")


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, removed, kept): maximal removed byte runs [start, end), and the bytes that are kept."""
    spark = docs.sparkSession
    docs = named(docs)
    heavy, total = heavy_keys(docs, length)
    parts = max(LEAST_PARTS, int(spark.conf.get("spark.sql.shuffle.partitions")), total // PART_STRETCHES)
    found = stored(gather(packs(docs, length, heavy, parts), parts), "stretches")
    asked = stored(found.where("kind = 1").groupBy("tag").agg(F.collect_list(F.struct("start", "windows", "key")).alias("asked")), "asked")
    rows = docs.join(asked, "tag").select("tag", "doc_id", "text", "asked")
    wanted = found.where("kind = 1").count()
    again = stored(repeated_windows(bodies(rows, length, 1 + wanted // PART_BODIES), length), "windows")
    every = found.where("kind = 0").select("tag", "start", "windows").unionByName(again)
    repeats = stored(every.groupBy("tag").agg(F.collect_list(F.struct("start", "windows")).alias("repeats")), "repeats")
    for table in (found, asked, again):
        dropped(table)
    return _cut(docs.join(repeats, "tag", "left").select("doc_id", "text", "repeats"), length)
