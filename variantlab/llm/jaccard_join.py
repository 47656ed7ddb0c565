"""N-gram Jaccard join by the size-aware heavy-light method.

Small sets enumerate fixed-size subsets: two sets of sizes a and b link when they share c >= t(a + b)/(1 + t)
elements, so each emits its subsets of every such c, and sets under one subset key need no verification.
Large sets scan inverted lists of their rarest elements (a prefix that any linked set must meet).
The boundary between the two is the size that makes a counted cost least.
Lists longer than LONG_LIST are not expanded into pairs. Each has a centre, its member with the fewest rare
elements, and every member is verified against it: those linked to it (near) are in one component already. A member
far from the centre is compared by differences: |A xor B| = |(A xor C) xor (B xor C)|, so two members link only if
they share enough of what sets them apart from the centre C, and such elements are rare where members are close to
it. Differences have inverted lists, prefixes and places as sets do; far members first meet a few representatives of
each list, and then only members that are not in their component by then. By the triangle inequality of the Jaccard
distance this covers all pairs of which one member is in the centre's surroundings; the members outside them are a
list again, with a centre of its own, for as long as a centre takes in at least a quarter of the postings.
What is left then shares passages without being close. Where the lists stand for fewer pairs than their members have
elements, these pairs are compared. Otherwise elements that always occur together become one element with a
weight, and members meet under combinations of such elements: the first that a linked pair shares leaves each of the two
enough weight for the rest, so does the second, and so on; combinations grow until few members are left
under each. A common passage alone brings nobody together.
Pairs of short lists meet by sketches first (16 bits of about a quarter of the elements), which bound the intersection
from above, so that whole sets travel for pairs only that may link. Of these, every set is verified against its
smallest partner before the pairs whose sets are not connected by then. No link between different components is dropped.

The order of elements takes the heavy ones last. Heavy ones are counted over all sets before the lists are made, by sorted
keys that travel as differences of about two bytes: a group spread thinly over many tasks is seen as well as one in a single
task, so the share of heavy elements in prefixes does not grow with the input.

Sets are sets of 64-bit shingle hashes; equal sets are found by the 128-bit digest of their content, and one row of
each, a node, does the work and is named by its row number.

Defined results: null text, empty text and text of white space have an empty set, 0 shingles and themselves as
component; repeated rows and equal texts share a component; a null doc_id is kept and never names a component
unless all ids in it are null; other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .frames import components, dropped, picked, small, stored, word_text
from .words import mix, shingle_sets

LONG_LIST = 24
#: Heavy elements (of more than LONG_LIST sets) kept for the order of elements, most frequent first: a bound on what is broadcast, 9 bytes each.
HEAVY_KEPT = 1 << 22
#: Bits of an element by which it is counted, at least: differences of a task's sorted keys then take 16 bits at any input up to about 40 GB.
LEAST_KEY_BITS = 35
#: Elements that a task of the counting pass sorts at once.
COUNTED = 2_000_000
#: Long lists get another centre if the last one took in this share of the postings.
TAKEN = 0.25
#: Members under a combination of elements that are compared with one another.
FEW = 4
#: How much farther from a centre than a linked set, in Jaccard distance, its surroundings reach.
SURROUNDINGS = 0.15
#: Representatives of a list of differences that its far members meet before all others.
REPRESENTATIVES = 4
PART_POSTINGS = 1_000_000
#: Parts of the postings at least: a set's postings are then in a part of their own mostly, at any input, so that bytes follow postings.
LEAST_PARTS = 64
#: Cost of one verification-bound posting against one subset key.
LIST_COST = 4.0
MAX_SUBSET_SIZE = 16
_BATCH = 400


class Rule:
    """100 * intersection >= percent * union, in integers."""

    def __init__(self, percent: int) -> None:
        self.percent = percent

    def overlap(self, a, b):
        """The least intersection of linked sets of sizes a and b."""
        return -(-self.percent * (a + b) // (100 + self.percent))

    def smallest(self, a):
        """The least size of a set linked to one of size a."""
        return -(-self.percent * a // 100)

    def prefix(self, a):
        return a - self.smallest(a) + 1

    def subset_sizes(self, a: int) -> range:
        return range(self.smallest(a), a + 1)

    def subset_keys(self, a: int) -> int:
        return sum(comb(a, c) for c in self.subset_sizes(a))


def _rows(batches: Iterator[pa.RecordBatch], width: int):
    """Slices of (other columns, sets); long batches are cut so that memory stays bounded."""
    for batch in batches:
        for at in range(0, batch.num_rows, _BATCH):
            part = batch.slice(at, _BATCH)
            yield part, shingle_sets(part.column("text").to_pylist(), width)


def _name(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _sketch(s: np.ndarray) -> np.ndarray:
    """The distinct 16-bit cuts of the elements of a quarter of all possible elements."""
    return np.unique((s[s & np.uint64(3) == 0] >> np.uint64(16)).astype(np.uint16)).view(np.int16)


def describe(docs: DataFrame, width: int) -> DataFrame:
    """First pass: (doc_id, n, node, sketch, uid) for each document (uid, doc_id, text)."""

    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("node", pa.binary()), ("sketch", pa.list_(pa.int16())), ("uid", pa.int64())])
        for part, sets in _rows(batches, width):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([_name(s) if len(s) else None for s in sets], pa.binary()), pa.array([_sketch(s) if len(s) else None for s in sets], pa.list_(pa.int16())), part.column("uid")], schema=schema)

    return docs.select("uid", "doc_id", word_text().alias("text")).mapInArrow(run, "doc_id long, n long, node binary, sketch array<smallint>, uid long")


_KEYS = "part int, first long, near binary, at binary, far binary"


def _key_packs(docs: DataFrame, width: int, bits: int, parts: int) -> DataFrame:
    """The elements' upper bits, sorted within a task and packed by range (part): the first, then differences, whose bits from 16 on (far) stand apart with their places."""

    def run(batches):
        def pack(kept: list[np.ndarray]):
            keys = np.sort(np.concatenate(kept) >> np.uint64(64 - bits))
            goes = (keys >> np.uint64(bits - 20)) * np.uint64(parts) >> np.uint64(20)
            cut = np.flatnonzero(np.diff(goes)) + 1
            out = [[] for _ in range(5)]
            for a, b in zip([0, *cut], [*cut, len(keys)], strict=True):
                gap = np.diff(keys[a:b])
                at = np.flatnonzero(gap >> np.uint64(16))
                for col, v in zip(out, (int(goes[a]), int(keys[a : a + 1].view(np.int64)[0]), gap.astype(np.uint16).tobytes(), at.astype(np.int32).tobytes(), (gap[at] >> np.uint64(16)).tobytes()), strict=True):
                    col.append(v)
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, [pa.int32(), pa.int64()] + [pa.binary()] * 3, strict=True)], names=[c.split()[0] for c in _KEYS.split(", ")])

        kept: list[np.ndarray] = []
        for _, sets in _rows(batches, width):
            kept += [s for s in sets if len(s)]
            if sum(map(len, kept)) >= COUNTED:
                yield pack(kept)
                kept = []
        if kept:
            yield pack(kept)

    return docs.select(word_text().alias("text")).mapInArrow(run, _KEYS)


def _unpacked(first: int, near: bytes, at: bytes, far: bytes) -> np.ndarray:
    keys = np.zeros(len(near) // 2 + 1, np.uint64)
    keys[0] = np.array(first, np.int64).view(np.uint64)
    keys[1:] = np.frombuffer(near, np.uint16)
    keys[1 + np.frombuffer(at, np.int32)] += np.frombuffer(far, np.uint64) << np.uint64(16)
    return np.cumsum(keys, dtype=np.uint64)


def heavy_elements(docs: DataFrame, width: int, total: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Ascending keys of the elements that more than LONG_LIST of docs have, their levels (higher: more frequent) and the keys' bits.

    A key is an element's upper bits, two more than total elements need, so that few elements share one; sharing only shapes the order.
    """
    bits = min(64, max(LEAST_KEY_BITS, int(total).bit_length() + 2))
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(tasks, total // (2 * PART_POSTINGS))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = np.sort(np.concatenate([_unpacked(*r) for r in zip(pdf["first"], pdf.near, pdf["at"], pdf.far, strict=True)]))
        begin = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        count = np.diff(np.concatenate((begin, [len(keys)])))
        begin, count = begin[count > LONG_LIST], count[count > LONG_LIST]
        level = np.minimum(255, 4 * np.log2(count)).astype(int)
        own = [(int(k), int((level == k).sum()), keys[begin[level == k]].tobytes()) for k in np.unique(level)]
        return pd.DataFrame(own, columns=["level", "n", "keys"])

    packs = _key_packs(docs, width, bits, parts).repartition(parts, "part")
    found = stored(packs.groupBy("part").applyInPandas(run, "level int, n long, keys binary"), "heavy")
    kept, least = 0, 256
    for level, n in found.groupBy("level").agg(F.sum("n")).orderBy(F.desc("level")).collect():
        kept += n
        if kept > HEAVY_KEPT:
            break
        least = level
    rows = found.where(f"level >= {least}").select("level", "keys").collect()
    keys = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(r[1], np.uint64) for r in rows)])
    levels = np.repeat(np.array([r[0] for r in rows], np.uint8), [len(r[1]) // 8 for r in rows])
    order = np.argsort(keys)
    return keys[order], levels[order], bits


def boundary(histogram: list[tuple[int, int]], rule: Rule) -> int:
    """The size up to which subsets are enumerated: least counted cost of subset keys plus list postings."""
    counts = dict(histogram)
    best, at = None, 0
    for x in range(MAX_SUBSET_SIZE + 1):
        low = rule.smallest(x + 1)
        cost = sum(n * rule.subset_keys(s) for s, n in counts.items() if s <= x) + sum(n * LIST_COST * rule.prefix(s) for s, n in counts.items() if s >= low)
        if best is None or cost < best:
            best, at = cost, x
    return at


def _subset_keys(s: np.ndarray, c: int) -> np.ndarray:
    picks = np.array(list(combinations(range(len(s)), c)))
    return mix(mix(s)[picks].sum(axis=1, dtype=np.uint64) + mix(np.array([c], np.uint64)))


_UNSIGNED = (np.uint8, np.uint16, np.uint32, np.uint64)


def _narrow(v: np.ndarray) -> bytes:
    """Whole numbers of 0 or more in the least width that holds them, which the first byte names."""
    width = next(k for k, t in enumerate(_UNSIGNED) if not len(v) or v.max() <= np.iinfo(t).max)
    return bytes([width]) + v.astype(_UNSIGNED[width]).tobytes()


def _wide(b: bytes) -> np.ndarray:
    return np.frombuffer(b, _UNSIGNED[b[0]], offset=1).astype(np.int64)


_POSTINGS = "part int, kind int, base long, nodes binary, sizes binary, heavies binary, counts binary, places binary, hashes binary"


def postings(docs: DataFrame, width: int, rule: Rule, heavy: tuple[np.ndarray, np.ndarray, int], x: int, parts: int) -> DataFrame:
    """Second pass, over one document of each set. kind 0: light list postings, 1: heavy ones, c + 1: keys of subsets of size c.

    Postings are packed by part, which their hash decides; heavy ones go to parts by document, as their lists are not gathered.
    Beside its hash, a posting mostly stands alone for its set in a part, so what a part has of a set is narrow: its number
    from the pack's base on, its size, and how many of its prefix are heavy.
    """
    link = docs.sparkSession.sparkContext.broadcast(heavy)

    def run(batches):
        keys, levels, bits = link.value
        for part, sets in _rows(batches, width):
            rows: list[tuple] = []
            for name, s in zip(part.column("uid").to_pylist(), sets, strict=True):
                n = len(s)
                if not n:
                    continue
                if n <= x:
                    rows += [(name, n, 0, c + 1, np.zeros(comb(n, c), np.int32), _subset_keys(s, c)) for c in rule.subset_sizes(n)]
                if n >= rule.smallest(x + 1):
                    if len(keys):
                        key = s >> np.uint64(64 - bits)
                        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                        rank = np.where(keys[at] == key, levels[at], 0)
                        order = np.argsort(rank, kind="stable")[: rule.prefix(n)]
                        split = int(np.searchsorted(rank[order], 1))
                    else:
                        order, split = np.arange(rule.prefix(n)), rule.prefix(n)
                    place = np.arange(len(order), dtype=np.int32)
                    rows.append((name, n, split, 0, place[:split], s[order[:split]]))
                    if split < len(order):
                        rows.append((name, n, split, 1, place[split:], s[order[split:]]))
            if not rows:
                continue
            length = np.array([len(r[5]) for r in rows])
            owner = np.repeat(np.arange(len(rows)), length)
            hashes = np.concatenate([r[5] for r in rows])
            places = np.concatenate([r[4] for r in rows]).astype(np.int32)
            kinds = np.array([r[3] for r in rows])[owner]
            names = np.array([r[0] for r in rows], np.int64)
            sizes = np.array([r[1] for r in rows], np.int32)
            heavies = np.array([rule.prefix(r[1]) - r[2] for r in rows], np.int64)
            spread = np.where(kinds == 1, mix(np.arange(len(rows), dtype=np.uint64))[owner], mix(hashes ^ np.uint64(0xA5A5A5A5)))
            goes = (spread % np.uint64(parts)).astype(np.int64)
            order = np.lexsort((owner, kinds, goes))
            goes, kinds, owner, hashes, places = goes[order], kinds[order], owner[order], hashes[order], places[order]
            cut = np.flatnonzero(np.diff(goes * 64 + kinds)) + 1
            out = [[] for _ in range(9)]
            for a, b in zip([0, *cut], [*cut, len(goes)], strict=True):
                own, count = np.unique(owner[a:b], return_counts=True)
                base = int(names[own].min())
                for col, v in zip(out, (int(goes[a]), int(kinds[a]), base, *map(_narrow, (names[own] - base, sizes[own], heavies[own], count, places[a:b])), hashes[a:b].tobytes()), strict=True):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, [pa.int32()] * 2 + [pa.int64()] + [pa.binary()] * 6, strict=True)], names=[c.split()[0] for c in _POSTINGS.split(", ")])

    return docs.select("uid", word_text().alias("text")).mapInArrow(run, _POSTINGS)


_FOUND = "kind int, hash long, a long, b long, size_a int, place_a int, rare_a int"


def gather(packs: DataFrame, rule: Rule, x: int, parts: int) -> DataFrame:
    """Lists of each part. kind 0: pairs (a, b) to verify; 1: postings (hash, a) of heavy or long lists; 2: links proved by a shared subset."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = []

        def frame(kind, a, b=None, h=0, size=0, place=0, rare=0):
            n = len(a)
            found.append(pd.DataFrame({"kind": np.full(n, kind, np.int32), "hash": h, "a": a, "b": b if b is not None else -1, "size_a": size, "place_a": place, "rare_a": rare}))

        for kind, packs in pdf.groupby("kind"):
            names = np.concatenate([base + _wide(v) for base, v in zip(packs.base, packs.nodes, strict=True)])
            sizes, heavies, count, places = (np.concatenate([_wide(v) for v in packs[c]]).astype(np.int32) for c in ("sizes", "heavies", "counts", "places"))
            rares = rule.prefix(sizes.astype(np.int64)) - heavies
            hashes = np.concatenate([np.frombuffer(v, np.uint64) for v in packs.hashes])
            owner = np.repeat(np.arange(len(names)), count)
            if kind == 1:
                frame(1, names[owner], None, hashes.view(np.int64), sizes[owner], places, rares[owner])
                continue
            order = np.lexsort((sizes[owner], hashes))
            hashes, owner, places = hashes[order], owner[order], places[order]
            first = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
            length = np.diff(np.concatenate((first, [len(hashes)])))
            if kind > 1:
                head = np.repeat(first, length)
                a, b = owner[head], owner
                keep = (a != b) & (rule.overlap(sizes[a].astype(np.int64), sizes[b].astype(np.int64)) <= kind - 1)
                frame(2, names[a[keep]], names[b[keep]])
                continue
            long = np.repeat(length > LONG_LIST, length)
            frame(1, names[owner[long]], None, hashes[long].view(np.int64), sizes[owner[long]], places[long], rares[owner[long]])
            left, right = [], []
            for step in range(1, LONG_LIST):
                here = first[(length > step) & (length <= LONG_LIST)]
                if not len(here):
                    break
                rest = length[(length > step) & (length <= LONG_LIST)] - step
                i = np.repeat(here, rest) + np.arange(rest.sum()) - np.repeat(np.cumsum(rest) - rest, rest)
                left.append(i)
                right.append(i + step)
            if left:
                i, j = np.concatenate(left), np.concatenate(right)
                a, b = owner[i], owner[j]
                sa, sb = sizes[a].astype(np.int64), sizes[b].astype(np.int64)
                most = np.minimum(sa - places[i], sb - places[j])
                keep = (most >= rule.overlap(sa, sb)) & (np.maximum(sa, sb) > x)
                pair = np.unique(a[keep].astype(np.int64) * len(names) + b[keep])
                frame(0, names[pair // len(names)], names[pair % len(names)])
        if not found:
            return pd.DataFrame({c.split()[0]: [] for c in _FOUND.split(", ")})
        out = pd.concat(found, ignore_index=True)
        return out[~((out.kind != 1) & (out.a == out.b))]

    tasks = max(int(packs.sparkSession.conf.get("spark.sql.shuffle.partitions")), parts // 8)
    return packs.repartition(tasks, "part").groupBy("part").applyInPandas(run, _FOUND)


def _sides(pairs: DataFrame, table: DataFrame, columns: list[str], keys: tuple[str, str] = ("a", "b"), within: str | None = None) -> DataFrame:
    """pairs with the columns of both sides' rows of table (node, ..), a side's columns ending in its name.

    Where pairs are small they go to the table, so that of its rows only those asked for are shuffled, and by one side only."""
    pairs = stored(pairs, "pairs")
    also = [within] if within else []
    side = lambda key: table.select(*also, F.col("node").alias(key), *[F.col(c).alias(f"{c}_{key}") for c in columns])
    one, two = keys
    asked = pairs.select(*also, one).distinct()
    if small(pairs):  # then so is what they ask for
        return side(two).join(F.broadcast(pairs), [*also, two]).join(side(one).join(F.broadcast(asked), [*also, one], "left_semi"), [*also, one])
    return side(two).join(pairs, [*also, two]).join(side(one), [*also, one])


def linked(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) whose sets (node, items) link. Rows are compared one by one in the JVM, so memory holds two sets."""
    both = _sides(pairs, sets, ["items"])
    shared, sizes = (x.cast("long") for x in (F.size(F.array_intersect("items_a", "items_b")), F.size("items_a") + F.size("items_b")))
    return both.where((100 + rule.percent) * shared >= rule.percent * sizes).select("a", "b")


def plausible(pairs: DataFrame, sketches: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) whose sketches (node, n, sketch) leave room for a link: beyond the cuts that both have, at most
    as many elements are shared as the side that has fewer of them holds without its cuts."""
    both = _sides(pairs, sketches, ["n", "sketch"])
    beyond = F.least(F.col("n_a") - F.size("sketch_a"), F.col("n_b") - F.size("sketch_b"))
    room = beyond + F.size(F.array_intersect("sketch_a", "sketch_b"))
    return both.where((100 + rule.percent) * room >= rule.percent * (F.col("n_a") + F.col("n_b"))).select("a", "b")


def proven(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """Links (a, b) that connect whatever pairs (a < b) that link connect: first those to each b's smallest a, then those between what is still apart."""
    pairs = pairs.withColumn("first", F.min("a").over(W.partitionBy("b")) == F.col("a"))
    pairs = stored(pairs, "candidates")
    star = stored(linked(pairs.where("first").select("a", "b"), sets, rule), "star")
    label = lambda x: star.select(F.col("b").alias(x), F.col("a").alias(f"label_{x}"))
    left = pairs.where("NOT first").select("a", "b").join(label("a"), "a", "left").join(label("b"), "b", "left")
    left = left.where(F.coalesce("label_a", "a") != F.coalesce("label_b", "b")).select("a", "b")
    return star.unionByName(stored(linked(left, sets, rule), "links"))


def _set_table(docs: DataFrame, width: int) -> DataFrame:
    def run(batches):
        for part, sets in _rows(batches, width):
            yield pa.RecordBatch.from_arrays([part.column("uid"), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["node", "items"])

    return docs.select("uid", word_text().alias("text")).mapInArrow(run, "node long, items array<bigint>")


def _may_link(rule: Rule) -> str:
    """Sizes and places (in the order of elements) of a common element that leave room for a link.

    The bound holds at a linked pair's first common element, and one list is enough to bring a pair up.
    """
    need = f"-floor(-{rule.percent} * (na + nb) / {100 + rule.percent})"
    return f"100 * least(na, nb) >= {rule.percent} * greatest(na, nb) AND least(na - pa, nb - pb) >= {need}"


def _members(lists: DataFrame, x: str) -> DataFrame:
    return lists.select("hash", F.col("a").alias(x), F.col("size_a").alias(f"n{x}"), F.col("place_a").alias(f"p{x}"))


def _short_lists(lists: DataFrame, rule: Rule) -> DataFrame:
    """Pairs (a, b) within lists of at most LONG_LIST members."""
    return _members(lists, "a").join(_members(lists, "b"), "hash").where(f"a < b AND {_may_link(rule)}").select("a", "b").distinct()


def _within(distance: float) -> str:
    """Whether a set of n elements is at most this Jaccard distance from one of m, apart by gap elements."""
    return f"gap * {2 - distance} <= {distance} * (n + m) + 1e-6"


def _differences(lists: DataFrame, sets: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """Lists (hash, a, ..) with their centre c, and for each distinct (a, c): delta = a's set xor c's (null beyond reach
    of the surroundings), spread = how far apart they are, far = not linked, outside = not in the surroundings.

    Two members link if (100 + percent) |delta xor delta| <= (100 - percent) (n + n)."""
    centre = stored(lists.groupBy("hash").agg(F.min(F.struct("rare_a", "a")).alias("m")).select("hash", F.col("m.a").alias("c")), "centres")
    own = stored(lists.join(centre, "hash"), "own")
    both = _sides(own.select("a", "c").distinct(), sets, ["items"], ("a", "c"))
    delta = F.concat(F.array_except("items_a", "items_c"), F.array_except("items_c", "items_a"))
    both = both.select("a", "c", F.size("items_a").cast("long").alias("n"), F.size("items_c").cast("long").alias("m"), delta.alias("delta"))
    k, s, link = 100 - rule.percent, 100 + rule.percent, 1 - rule.percent / 100
    apart = both.withColumn("gap", F.size("delta").cast("long")).withColumn("spread", s * F.col("gap") - k * F.col("n"))
    reach = F.when(F.expr(_within(2 * link + SURROUNDINGS)), F.col("delta")).alias("delta")
    return own, stored(apart.select("a", "c", "spread", reach, (F.col("spread") > k * F.col("m")).alias("far"), F.expr(f"NOT ({_within(link + SURROUNDINGS)})").alias("outside")), "deltas")


def _delta_lists(deltas: DataFrame, rule: Rule) -> DataFrame:
    """(c, x, a, spread, room, far): lists of differences x that a far member shares with another one (near, or any if last).

    Linked a and b share t differences, 2 (100 + percent) t >= spread(a) + spread(b); room is twice (100 + percent)
    times what a has from x on, in an order that all members share, so at their first common difference both rooms
    reach that sum. A list's least spreads of partners bound it for each member alone.
    """
    each = deltas.select("c", "a", "spread", "far", F.explode("delta").alias("x"))
    lists = each.groupBy("c", "x").agg(F.count("*").alias("count"), F.min("spread").alias("least"), F.min(F.when(F.col("far"), F.col("spread"))).alias("least_far"))
    lists = lists.where("count > 1 AND least_far IS NOT NULL")
    partner = F.when(F.col("far"), F.col("least")).otherwise(F.col("least_far"))
    rows = each.join(lists, ["c", "x"])
    by = W.partitionBy("c", "a").orderBy("count", "x")
    rows = rows.withColumn("after", F.count("*").over(W.partitionBy("c", "a")) - F.row_number().over(by) + 1)
    room = 2 * (100 + rule.percent) * F.col("after")
    return rows.select("c", "x", "a", "spread", "far", room.alias("room"), partner.alias("partner")).where("room >= spread + partner").drop("partner")


def _meet(ones: DataFrame, others: DataFrame, extra: str = "true") -> DataFrame:
    """Distinct (c, a, b) of members of one list of differences with room for a link."""
    side = lambda df, x: df.select("c", "x", F.col("a").alias(x), *[F.col(k).alias(f"{k}_{x}") for k in df.columns if k not in ("c", "x", "a")])
    met = side(ones, "a").join(side(others, "b"), ["c", "x"]).where(f"a <> b AND least(room_a, room_b) >= spread_a + spread_b AND {extra}")
    return met.select("c", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _apart(pairs: DataFrame, deltas: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (c, a, b) that link, by their differences from c."""
    pairs = _sides(pairs, deltas.withColumnRenamed("a", "node"), ["delta", "spread"], within="c")
    shared = F.size(F.array_intersect("delta_a", "delta_b")).cast("long")
    return pairs.where(2 * (100 + rule.percent) * shared >= F.col("spread_a") + F.col("spread_b")).select("a", "b")


def _weighted(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, n, s, w, rank, rest) of members (a): elements s that other members have too, w of them that occur in the same members as one; rest is the weight from rank on, the rarest first."""
    each = sets.join(members.select(F.col("a").alias("node")), "node").select(F.col("node").alias("a"), F.size("items").cast("long").alias("n"), F.explode("items").alias("x"))
    shared = each.groupBy("x").agg(F.count("*").alias("c"), F.sum(F.xxhash64("a").cast("decimal(38,0)")).alias("who")).where("c > 1")
    shared = stored(shared.select("x", "c", F.xxhash64("c", "who").alias("s")), "shared")
    profile = stored(each.join(shared, "x").groupBy("a", "n", "s", "c").agg(F.count("*").alias("w")), "profile")
    by = W.partitionBy("a").orderBy("c", "s")
    rest = F.sum("w").over(W.partitionBy("a")) - F.sum("w").over(by) + F.col("w")
    return stored(profile.select("a", "n", "s", "w", F.row_number().over(by).alias("rank"), rest.alias("rest")), "weighted")


def _combined(members: DataFrame, sets: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame | None]:
    """Distinct pairs (a, b) of members (a) that may link, and lists (hash, a) of members that share what a link needs and are too many for pairs.

    Members under a key share elements of a weight; a member's partners there are no smaller than the least of them, which
    bounds what a link needs from below, and after is the weight of a member's elements that may still be shared.
    """
    weighted = _weighted(members, sets)
    overlap = lambda a, b: f"-floor(-{rule.percent} * ({a} + {b}) / {100 + rule.percent})"
    needs = F.expr(overlap("n", f"greatest(low, -floor(-{rule.percent} * n / 100))"))
    every = weighted.groupBy("a", "n").agg(F.lit(0).alias("last"), F.lit(0).cast("long").alias("weight"), F.lit(0).cast("long").alias("key"))
    state = every.withColumn("low", F.lit(0).cast("long"))
    pairs: list[DataFrame] = []
    lists: list[DataFrame] = []

    def side(few: DataFrame, x: str) -> DataFrame:
        return few.select("key", F.col("a").alias(x), F.col("n").alias(f"n{x}"), F.col("after").alias(f"after{x}"), F.col("weight").alias(f"weight{x}"))

    def meet(few: DataFrame) -> DataFrame:
        sizes = f"100 * least(na, nb) >= {rule.percent} * greatest(na, nb) AND weighta + least(aftera, afterb) >= {overlap('na', 'nb')}"
        return side(few, "a").join(side(few, "b"), "key").where(f"a < b AND {sizes}").select("a", "b").distinct()

    while True:
        longer = state.join(weighted.drop("n"), "a").where(F.col("rank") > F.col("last")).where(F.col("weight") + F.col("rest") >= needs)
        longer = stored(longer.select("a", "n", (F.col("weight") + F.col("w")).alias("weight"), (F.col("rest") - F.col("w")).alias("after"), F.col("rank").alias("last"), F.xxhash64("key", "s").alias("key")), "combinations")
        groups = stored(longer.groupBy("key").agg(F.count("*").alias("m"), F.min("n").alias("low")).where("m > 1"), "groups")
        longer = stored(longer.join(groups, "key").where(F.col("weight") + F.col("after") >= needs), "combinations")
        pairs.append(stored(meet(longer.where(f"m <= {FEW}")), "few"))
        many = longer.where(f"m > {FEW}")
        full = many.where(F.col("weight") >= needs).select("key").distinct()
        if not full.isEmpty():
            full = stored(full, "full")
            lists.append(many.join(full, "key").select(F.col("key").alias("hash"), "a", "n"))
            many = many.join(full, "key", "left_anti")
        state = many.drop("m", "after")
        if state.isEmpty():
            break
    found = pairs[0]
    for more in pairs[1:]:
        found = found.unionByName(more)
    rest = None
    for more in lists:
        rest = more if rest is None else rest.unionByName(more)
    return stored(found.distinct(), "pairs"), rest


def _pairs_in(lists: DataFrame) -> int:
    """A bound on the pairs of lists (hash, a)."""
    n = F.col("count")
    return lists.groupBy("hash").count().agg(F.sum(n * (n - 1) / 2)).first()[0] or 0


def _elements_in(lists: DataFrame) -> int:
    """The elements of the members of lists (a, size_a), which combinations read."""
    return lists.select("a", "size_a").distinct().agg(F.sum("size_a")).first()[0] or 0


def _long_lists(lists: DataFrame, sets: DataFrame, rule: Rule) -> list[DataFrame]:
    """Links among members (hash, a) of long lists that connect whatever a full comparison would connect."""
    tables: list[DataFrame] = []
    combined = False
    while True:
        postings = lists.count()
        own, deltas = _differences(lists, sets, rule)
        star = deltas.where("NOT far AND a <> c").select("a", F.col("c").alias("b"))
        tables.append(star)
        near = deltas.where("delta IS NOT NULL")
        if not near.where("far").isEmpty():
            met = stored(_delta_lists(near, rule), "differences")
            slot = F.pmod(F.xxhash64("a"), F.lit(REPRESENTATIVES))
            few = met.groupBy("c", "x", slot.alias("slot")).agg(F.min(F.struct("spread", "a", "far", "room")).alias("m")).select("c", "x", "m.*")
            tables.append(stored(_apart(_meet(met.where("far"), few), near, rule), "links"))
            roots = components(star.unionByName(tables[-1])).select(F.col("node").alias("a"), "root")
            named = stored(met.join(roots, "a", "left").withColumn("label", F.coalesce("root", "a")).drop("root"), "named")
            most = named.groupBy("c", "x", "label").count().groupBy("c", "x").agg(F.max_by("label", F.struct("count", "label")).alias("most"), F.count("*").alias("labels"))
            named = stored(named.join(stored(most.where("labels > 1").drop("labels"), "most"), ["c", "x"]), "named")
            pairs = _meet(named.where("label <> most"), named, "label_a <> label_b AND (far_a OR far_b)")
            tables.append(stored(_apart(pairs, near, rule), "links"))
        rest = stored(own.join(deltas.where("outside").select("a", "c"), ["a", "c"]).drop("c", "n"), "rest")
        rest = stored(rest.join(stored(rest.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1"), "lengths"), "hash"), "rest")
        tables.append(proven(_short_lists(rest.where(f"n <= {LONG_LIST}"), rule), sets, rule))
        lists = stored(rest.where(f"n > {LONG_LIST}"), "lists")
        left = lists.count()
        if not left:
            break
        if left > (1 - TAKEN) * postings:
            if combined or _pairs_in(lists) <= _elements_in(lists):  # after combinations, each shares with some member what a link with it needs
                tables.append(proven(_short_lists(lists, rule), sets, rule))
                break
            combined = True
            pairs, full = _combined(stored(lists.select("a").distinct(), "members"), sets, rule)
            tables.append(proven(pairs, sets, rule))
            if full is None:
                break
            # members that share what a link needs are near one another, and centres are made for these; the largest set of a list is one
            size = F.col("n").cast("int")
            lists = stored(full.select("hash", "a", size.alias("size_a"), F.lit(0).alias("place_a"), (-size).alias("rare_a")).distinct(), "lists")
    return tables


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 75, numbered: bool = False) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links).

    numbered: doc_id is a stored number of each row, 0 or more in the order in which rows lie, so texts need not be stored anew.
    """
    spark, rule = docs.sparkSession, Rule(percent)
    # ids may be null or stand for several texts, so rows are named by a stored uid
    if numbered:
        docs = docs.select(F.col("doc_id").alias("uid"), "doc_id", "text")
    else:
        docs = stored(docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), "text"), "docs")
    first = stored(describe(docs, width), "sets")
    rows = stored(first.select("doc_id", F.col("n").alias("n_shingles"), "node", "uid"), "rows")
    histogram = [(r[0], r[1]) for r in rows.where(f"n_shingles BETWEEN 1 AND {4 * MAX_SUBSET_SIZE}").groupBy("n_shingles").count().collect()]
    total = rows.agg(F.sum("n_shingles")).first()[0] or 0
    if not total:
        return rows.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    x = boundary(histogram, rule)
    parts = max(LEAST_PARTS, int(spark.conf.get("spark.sql.shuffle.partitions")), round(total * (100 - percent) / 100 / PART_POSTINGS))
    # one row of each set does the work; the aggregate is stored so that joins with it can split a large group of copies
    nodes = stored(rows.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("uid").alias("uid"), F.count("*").alias("n_rows")), "nodes")
    copies = stored(rows.join(nodes.where("n_rows > 1").select("node", F.col("uid").alias("kept")), "node").where("uid > kept").select("uid"), "copies")
    single = picked(docs, copies, "uid", keep=False)
    heavy = heavy_elements(single, width, total)
    found = stored(gather(postings(single, width, rule, heavy, x, parts), rule, x, parts), "found")
    heavy_rows = found.where("kind = 1").select("hash", "a", "size_a", "place_a", "rare_a").distinct()
    lengths = stored(heavy_rows.groupBy("hash").agg(F.count("*").alias("n"), F.min("size_a").alias("least")).where("n > 1"), "lengths")
    room = f"{100 + percent} * (size_a - place_a) >= {percent} * (size_a + greatest(least, {percent} * size_a / 100))"
    lists = stored(heavy_rows.join(lengths, "hash").where(room).drop("least"), "lists")
    pairs = found.where("kind = 0").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = stored(pairs.unionByName(_short_lists(lists.where(f"n <= {LONG_LIST}"), rule)).distinct(), "candidates")
    long = lists.where(f"n > {LONG_LIST}")
    asked = stored(pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))).distinct(), "asked")
    sketches = first.where("node IS NOT NULL").select(F.col("uid").alias("node"), "n", "sketch")
    sketches = stored(picked(sketches, asked.withColumnRenamed("a", "node"), "node"), "sketches")
    dropped(first)
    pairs = stored(plausible(pairs, sketches, rule), "plausible")
    dropped(sketches)
    asked = pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))).unionByName(long.select("a")).distinct()
    sets = stored(_set_table(picked(docs, asked.withColumnRenamed("a", "uid"), "uid"), width), "items")
    if not numbered:
        dropped(docs)
    links = proven(pairs, sets, rule).unionByName(found.where("kind = 2").select("a", "b"))
    if not long.isEmpty():
        for table in _long_lists(long, sets, rule):
            links = links.unionByName(table)
    roots = stored(components(links), "roots")
    dropped(sets)
    named = stored(nodes.join(roots.withColumnRenamed("node", "uid"), "uid", "left").withColumn("root", F.coalesce("root", "uid")), "named")
    smallest = stored(named.groupBy("root").agg(F.min("doc_id").alias("component_id")), "smallest")
    every = stored(named.join(smallest, "root").select("node", "component_id"), "classes")
    return rows.join(every, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
