"""Second-order boosted trees over sparse vectors of few distinct values, for the logistic and the squared loss.

Every level of a tree is one pass over the rows, which are stored in chunks of binary columns, with their margins. A task scores
its rows with the trees since the margins were stored (they travel with it; after every STORED trees the chunks are written
anew, so a pass costs the same at the last tree as at the first), adds up gradients and Hessians by (node, feature, value)
and sends these sums by blocks of features; blocks are added up and searched for their best split where they
meet, and the driver receives one candidate for each node and block, and with the first level the totals of the roots. Absent
values are never written out: their sums are a node's total less those of its present values, and every cut is tried with them on
either side.

Groups of rows, such as clusters, can have a model each and still grow together: a tree then has a root for each group, and one
pass grows a level of all of them. Each group's trees are those that its rows alone would give. A row can have several roots,
such as its cluster's and that of a model of all rows.

Gradients and Hessians are rounded to multiples of 2**-SCALE_BITS and summed as integers, so sums do not depend on their
order, and equal gains are ties: they go to the smaller feature, then the smaller value, then to absent values on the left.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..sources.files import remove, scratch

SCALE_BITS = 24
#: Features of a block, sums of one kind that a task keeps at once, and the most distinct values.
BLOCK, MOST_SUMS, MOST_LEVELS = 2048, 1 << 23, 255
#: Most groups that have models of their own: these are kept on the driver and sent with tasks.
MOST_GROUPS = 1024
#: Trees after which margins are stored anew, and the most rows and (if there is more than one row) cells of a chunk.
STORED, CHUNK_ROWS, CHUNK_CELLS = 5, 4096, 1 << 20
#: Gains up to this are no split.
LEAST_GAIN = 1e-6


@dataclass(frozen=True)
class Settings:
    """l2 is added to Hessians; child is the least Hessian of a child; columns is the share of features drawn for each tree; gamma is a split's cost.

    With squared loss the Hessian is the weight, so one tree at rate 1 without l2 is a regression tree of weighted means.
    """

    trees: int = 100
    depth: int = 6
    rate: float = 0.1
    columns: float = 1.0
    rows: float = 1.0
    l2: float = 1.0
    child: float = 1.0
    gamma: float = 0.0
    seed: int = 42
    squared: bool = False


@dataclass
class Tree:
    """Nodes by number, first the root of each group; a node with a feature goes left at values up to level cut, or without a value if absent_left."""

    feature: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    absent_left: list[bool] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)
    sums: list[tuple[int, int]] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def add(self, sums: tuple[int, int], settings: Settings) -> int:
        for column, x in ((self.feature, -1), (self.cut, 0), (self.absent_left, False), (self.left, -1), (self.right, -1), (self.gain, 0.0), (self.sums, sums), (self.value, 0.0)):
            column.append(x)
        self.put(len(self.feature) - 1, sums, settings)
        return len(self.feature) - 1

    def put(self, node: int, sums: tuple[int, int], settings: Settings) -> None:
        """Gives a node its sums, and the value that follows from them."""
        g, h = (x / (1 << SCALE_BITS) for x in sums)
        self.sums[node], self.value[node] = sums, -g / (h + settings.l2) * settings.rate if h + settings.l2 else 0.0

    def part(self, roots: list[int]) -> Tree:
        """The nodes below some roots, numbered as if they had grown alone."""
        number = {k: i for i, k in enumerate(roots)}
        for k, f in enumerate(self.feature):  # children come after their parent
            if k in number and f >= 0:
                number[self.left[k]] = number[self.right[k]] = -1
        number = {k: i for i, k in enumerate(sorted(number))}
        kept = list(number)
        pick = lambda column: [column[k] for k in kept]
        left, right = ([number[c] if c >= 0 else -1 for c in pick(column)] for column in (self.left, self.right))
        return Tree(pick(self.feature), pick(self.cut), pick(self.absent_left), left, right, pick(self.gain), pick(self.sums), pick(self.value))

    def used(self) -> list[int]:
        return [f for f in self.feature if f >= 0]

    def leaves(self, table: np.ndarray, used: np.ndarray, root: np.ndarray) -> np.ndarray:
        """The node that each row of table (level + 1 of every used feature, 0: absent) ends in, from its root on."""
        feature, cut = np.array(self.feature), np.array(self.cut)
        absent, left, right = np.array(self.absent_left), np.array(self.left), np.array(self.right)
        column = np.where(feature >= 0, np.searchsorted(used, np.maximum(feature, 0)), 0)
        at = root.astype(np.int64)
        moving = np.flatnonzero(feature[at] >= 0)
        while len(moving):
            node = at[moving]
            level = table[moving, column[node]].astype(np.int64) - 1
            goes_left = np.where(level < 0, absent[node], level <= cut[node])
            at[moving] = np.where(goes_left, left[node], right[node])
            moving = moving[feature[at[moving]] >= 0]
        return at


@dataclass
class Boosted:
    """Trees over values levels (sorted); features are numbered below width. groups holds the root of each group, constant the score of groups without trees."""

    levels: list[float]
    width: int
    settings: Settings
    trees: list[Tree] = field(default_factory=list)
    groups: dict = field(default_factory=lambda: {None: 0})
    constant: dict = field(default_factory=dict)

    def used(self) -> np.ndarray:
        return np.array(sorted({f for t in self.trees for f in t.used()}), np.int64)

    def margin(self, table: np.ndarray, used: np.ndarray, root: np.ndarray) -> np.ndarray:
        out = np.zeros(len(table))
        for t in self.trees:
            out += np.array(t.value)[t.leaves(table, used, root)]
        return out

    def score(self, margin: np.ndarray) -> np.ndarray:
        return margin if self.settings.squared else 1 / (1 + np.exp(-margin))


def drawn(features: np.ndarray, tree: int, settings: Settings) -> np.ndarray:
    """Which features a tree may use: those whose md5 with seed and tree is below the share."""
    if settings.columns >= 1:
        return np.ones(len(features), bool)
    below = round(settings.columns * (1 << 32))
    return np.array([int(hashlib.md5(f"{settings.seed}:{tree}:{f}".encode()).hexdigest()[:8], 16) < below for f in features.tolist()], bool)


def _sampled(ids: list, tree: int, settings: Settings) -> np.ndarray:
    below = round(settings.rows * (1 << 32))
    return np.array([int(hashlib.md5(f"{settings.seed}:{tree}:row:{i}".encode()).hexdigest()[:8], 16) < below for i in ids], bool)


def packed(cells: DataFrame, rows: DataFrame, levels: list[float]) -> DataFrame:
    """rows (pair_id, ..) with features and levels as arrays, features in order; rows without cells have empty ones."""
    known = F.array(*[F.lit(float(x)) for x in levels]).cast("array<double>")
    level = F.array_position(known, F.col("value").cast("double")) - 1
    each = cells.select("pair_id", F.struct(F.col("feature").cast("int").alias("f"), level.cast("tinyint").alias("l")).alias("c"))
    lists = each.groupBy("pair_id").agg(F.array_sort(F.collect_list("c")).alias("c"))
    empty = F.array().cast("array<struct<f:int,l:tinyint>>")
    return rows.join(lists, "pair_id", "left").withColumn("c", F.coalesce("c", empty)).select(*rows.columns, F.col("c.f").alias("features"), F.col("c.l").alias("levels"))


def _cells(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, level) of a batch's present values."""
    lists = batch.column("features")
    count = np.asarray(lists.value_lengths())
    return np.repeat(np.arange(batch.num_rows), count), np.asarray(lists.flatten()).astype(np.int64), np.asarray(batch.column("levels").flatten()).astype(np.int64)


def _table(row: np.ndarray, feature: np.ndarray, level: np.ndarray, n: int, used: np.ndarray) -> np.ndarray:
    out = np.zeros((n, max(1, len(used))), np.uint8)
    if len(used):
        at = np.minimum(np.searchsorted(used, feature), len(used) - 1)
        hit = used[at] == feature
        out[row[hit], at[hit]] = level[hit] + 1
    return out


def _derivatives(model: Boosted, margin: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = model.score(margin)
    unit = 1 << SCALE_BITS
    if model.settings.squared:
        return np.rint((p - y) * w * unit), np.rint(w * unit)
    return np.rint((p - y) * w * unit), np.rint(p * (1 - p) * w * unit)


def _chunks(cells: DataFrame, rows: DataFrame, model: Boosted) -> DataFrame:
    """Packed rows (pair_id, y, w, __roots) in chunks: binary columns of numbers by row, and code, feature * levels + level of each present value; __roots -1 is none. ids are kept for samples alone."""
    levels, sampled = len(model.levels), model.settings.rows < 1
    kind = np.int32 if model.width * levels < 1 << 31 else np.int64

    def run(batches):
        for batch in batches:
            count = np.asarray(batch.column("features").value_lengths()).astype(np.int32)
            most = max(1, min(CHUNK_ROWS, CHUNK_CELLS * batch.num_rows // max(1, int(count.sum()))))
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                _, feature, level = _cells(part)
                root = np.asarray(part.column("__roots").flatten()).astype(np.int32).reshape(part.num_rows, -1).T
                ids = part.column("pair_id") if sampled else part.column("pair_id").slice(0, 0)
                numbers = (np.asarray(part.column("y"), np.float64), np.asarray(part.column("w"), np.float64), root, np.zeros(root.shape), count[at : at + most], (feature * levels + level).astype(kind))
                columns = [pa.array([x.tobytes()], pa.binary()) for x in numbers]
                yield pa.RecordBatch.from_arrays([pa.array([part.num_rows], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *columns], names=_CHUNK)

    table = packed(cells, rows, model.levels)
    return table.mapInArrow(run, f"n int, ids array<{table.schema['pair_id'].dataType.simpleString()}>, " + ", ".join(f"{c} binary" for c in _CHUNK[2:]))


_CHUNK = ["n", "ids", "y", "w", "root", "margin", "count", "code"]


def _parts(batches, model: Boosted, done: int, tree: Tree | None):
    """(batch, number, n, count, code, margin, and root, g, h, node by kind of root) of each chunk. Margins are stored for the first done trees; the tree is
    the one that grows, after model's. Rows that its sample leaves out, or that have no root of a kind, have weight 0."""
    later = model.trees[done:]
    used = np.array(sorted({f for t in [*later, *([tree] if tree else [])] for f in t.used()}), np.int64)
    levels, kind = len(model.levels), np.int32 if model.width * len(model.levels) < 1 << 31 else np.int64
    place = np.full(model.width, -1)
    place[used] = np.arange(len(used))
    place = np.repeat(place, levels)  # by code
    mark = np.tile(np.arange(1, levels + 1, dtype=np.uint8), model.width)
    for batch in batches:
        for i in range(batch.num_rows):
            n = batch.column("n")[i].as_py()
            y, w, root, margin, count, code = (np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in zip(_CHUNK[2:], (np.float64, np.float64, np.int32, np.float64, np.int32, kind), strict=True))
            table = np.zeros((n, max(1, len(used))), np.uint8)
            if len(used):
                column = place[code]
                hit = np.flatnonzero(column >= 0)
                table.reshape(-1)[np.repeat(np.arange(n) * table.shape[1], count)[hit] + column[hit]] = mark[code[hit]]
            if model.settings.rows < 1:
                w = w * _sampled(batch.column("ids")[i].as_py(), len(model.trees), model.settings)
            margin, found = margin.reshape(-1, n).copy(), []
            for own, at in zip(margin, root.reshape(-1, n), strict=True):
                start = np.maximum(at, 0)
                for t in later:
                    own += np.array(t.value)[t.leaves(table, used, start)]
                g, h = _derivatives(model, own, y, np.where(at >= 0, w, 0.0))
                found.append((start, g, h, tree.leaves(table, used, start) if tree else start))
            yield batch, i, n, count, code, margin, found


def _advanced(table: DataFrame, model: Boosted, done: int) -> DataFrame:
    """The chunks with margins of all of model's trees."""

    def run(batches):
        for batch, i, _, _, _, margin, _ in _parts(batches, model, done, None):
            own = batch.slice(i, 1)
            yield own.set_column(own.schema.get_field_index("margin"), "margin", pa.array([margin.tobytes()], pa.binary()))

    return table.mapInArrow(run, table.schema)


def _score(g, h, settings: Settings):
    g, h = g / (1 << SCALE_BITS), h / (1 << SCALE_BITS)
    return g * g / (h + settings.l2)


def best_cuts(features: np.ndarray, g: np.ndarray, h: np.ndarray, totals: np.ndarray, settings: Settings) -> list[tuple]:
    """(slot, gain, feature, cut, absent_left, g, h of the left side) of the best split of each slot, if any; g, h: (slot, feature, level)."""
    all_g, all_h = totals[:, 0, None, None], totals[:, 1, None, None]
    left_g, left_h = np.cumsum(g, axis=2), np.cumsum(h, axis=2)
    rest_g, rest_h = all_g - left_g[:, :, -1:], all_h - left_h[:, :, -1:]  # of absent values
    # by feature, level, absent on the left or not: the order of ties
    lg = np.stack((left_g + rest_g, left_g), axis=3)
    lh = np.stack((left_h + rest_h, left_h), axis=3)
    rg, rh = all_g[..., None] - lg, all_h[..., None] - lh
    least = round(settings.child * (1 << SCALE_BITS))
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (_score(lg, lh, settings) + _score(rg, rh, settings) - _score(all_g, all_h, settings)[..., None]) / 2 - settings.gamma
    allowed = (lh >= least) & (rh >= least)
    allowed[:, :, -1, 0] = False  # everything on the left
    allowed[:, :, 1:, :] &= ((h[:, :, 1:] != 0) | (g[:, :, 1:] != 0))[..., None]  # a value that none has makes no new cut
    gain = np.where(allowed & np.isfinite(gain), gain, -np.inf).reshape(len(g), -1)
    out = []
    for slot, at in enumerate(gain.argmax(axis=1) if gain.size else []):
        if gain[slot, at] > LEAST_GAIN:
            f, cut, side = np.unravel_index(at, lg.shape[1:])
            out.append((slot, float(gain[slot, at]), int(features[f]), int(cut), side == 0, int(lg[slot, f, cut, side]), int(lh[slot, f, cut, side])))
    return out


_BEST = "slot int, gain double, feature int, cut int, absent_left boolean, g long, h long"


def _splits(table: DataFrame, model: Boosted, done: int, tree: Tree, nodes: list[int], roots: bool) -> dict[int, tuple]:
    """The best split of each of a tree's nodes, by node; where they are roots, which are then given their sums, they are totalled in the same pass."""
    width, levels, settings, number = model.width, len(model.levels), model.settings, len(model.trees)
    slot_of = np.full(len(tree.feature), -1, np.int64)
    slot_of[nodes] = np.arange(len(nodes))
    known = np.array([tree.sums[k] for k in nodes], np.int64)

    def sums(batches):
        size, codes = len(nodes) * width * levels, width * levels
        total, whole, rows = np.zeros((2, size)), np.zeros((2, len(nodes))), 0
        for _, _, n, count, code, _, found in _parts(batches, model, done, tree):
            rows += n
            for _, g, h, node in found:
                slot = slot_of[node]
                own = slot >= 0
                some, times = code, count
                if not own.all():
                    some, times = code[np.repeat(own, count)], count[own]
                    slot, g, h = slot[own], g[own], h[own]
                key = np.repeat(slot * codes, times) + some
                for k, x in enumerate((g, h)):  # whole numbers below 2**53, so exact
                    total[k] += np.bincount(key, weights=np.repeat(x, times), minlength=size)
                    if roots:
                        whole[k] += np.bincount(slot, weights=x, minlength=len(nodes))
        total, whole = total.reshape(2, len(nodes), width, levels), whole.astype(np.int64).tobytes()
        out = []
        for block, at in enumerate(range(0, width, BLOCK)):
            part = total[:, :, at : at + BLOCK]
            if (roots and rows) or part.any():
                out.append((block, whole, part.astype(np.int64).tobytes()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["block", "whole", "sums"])

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        first = int(pdf["block"].iloc[0]) * BLOCK
        features = np.arange(first, min(first + BLOCK, width))
        g, h = sum(np.frombuffer(x, np.int64) for x in pdf["sums"]).reshape(2, len(nodes), len(features), levels)
        totals = sum(np.frombuffer(x, np.int64) for x in pdf["whole"]).reshape(2, len(nodes)).T if roots else known
        mine = drawn(features, number, settings)
        found = best_cuts(features[mine], g[:, mine], h[:, mine], totals, settings)
        if roots and first == 0:
            found += [(slot, 0.0, -1, 0, False, *sums) for slot, sums in enumerate(totals.tolist())]
        return pd.DataFrame(found, columns=[c.split()[0] for c in _BEST.split(", ")])

    found = table.mapInArrow(sums, "block int, whole binary, sums binary").groupBy("block").applyInPandas(search, _BEST).collect()
    best: dict[int, tuple] = {}
    for r in found:
        node, mark = nodes[r.slot], (r.gain, -r.feature, -r.cut, r.absent_left)
        if r.feature < 0:
            tree.put(node, (r.g, r.h), settings)
        elif node not in best or mark > best[node][0]:
            best[node] = mark, r
    return {node: r for node, (_, r) in best.items()}


def grown(table: DataFrame, model: Boosted, done: int, roots: int) -> Tree:
    """The next tree of a model over chunks that hold the margins of its first done trees, level by level."""
    settings = model.settings
    tree = Tree()
    frontier = [tree.add((0, 0), settings) for _ in range(roots)]
    at_once = max(1, MOST_SUMS // max(1, model.width * len(model.levels)))
    for depth in range(max(1, settings.depth)):
        if depth:
            frontier = [k for k in frontier if tree.sums[k][1] >= 2 * round(settings.child * (1 << SCALE_BITS))]
        found: dict[int, tuple] = {}
        for at in range(0, len(frontier), at_once):
            found |= _splits(table, model, done, tree, frontier[at : at + at_once], depth == 0)
        frontier = []
        for node, best in sorted(found.items()) if settings.depth else ():
            g, h = tree.sums[node]
            tree.feature[node], tree.cut[node], tree.absent_left[node], tree.gain[node] = best.feature, best.cut, best.absent_left, best.gain
            tree.left[node] = tree.add((best.g, best.h), settings)
            tree.right[node] = tree.add((g - best.g, h - best.h), settings)
            frontier += [tree.left[node], tree.right[node]]
        if not frontier:
            break
    return tree


def _fitted(cells: DataFrame, rows: DataFrame, model: Boosted, roots: int = 1) -> Boosted:
    """model with its trees over rows (pair_id, y, w, __roots); chunks are written at first and after every STORED trees, and read for each level of each tree."""
    spark = rows.sparkSession
    model.levels = [float(r[0]) for r in cells.select(F.col("value").cast("double")).distinct().orderBy("value").limit(MOST_LEVELS + 1).collect()]
    if len(model.levels) > MOST_LEVELS:
        raise ValueError(f"more than {MOST_LEVELS} distinct values; binarise or bin them first")
    if not model.levels:
        return model

    def written(chunks: DataFrame) -> tuple[str, DataFrame]:
        path = scratch(spark, "boosting")
        chunks.write.option("parquet.block.size", 16 << 20).option("parquet.enable.dictionary", "false").parquet(path)
        return path, spark.read.schema(chunks.schema).parquet(path)

    rows = rows.select("pair_id", F.col("y").cast("double").alias("y"), F.col("w").cast("double").alias("w"), "__roots")
    path, table = written(_chunks(cells, rows, model))
    done = 0
    for number in range(model.settings.trees):
        if number - done == STORED:
            old, (path, table), done = path, written(_advanced(table, model, done)), number
            remove(spark, old)
        model.trees.append(grown(table, model, done, roots))
    remove(spark, path)
    return model


def boost(cells: DataFrame, rows: DataFrame, width: int, settings: Settings = Settings()) -> Boosted:
    """A model of y (0 or 1; any number with squared loss) with weights w: rows (pair_id, y, w), cells (pair_id, feature below width, value) of at most MOST_LEVELS values."""
    return _fitted(cells, rows.withColumn("__roots", F.array(F.lit(0))), Boosted([], width, settings))


def _roots(model: Boosted, rows: DataFrame, group: str, how: str) -> DataFrame:
    known = rows.sparkSession.createDataFrame(list(model.groups.items()), f"`__group` {rows.schema[group].dataType.simpleString()}, `__root` int")  # at most MOST_GROUPS
    return rows.join(F.broadcast(known), F.col(group).eqNullSafe(F.col("__group")), how).drop("__group")


def boost_each(cells: DataFrame, rows: DataFrame, width: int, group: str, settings: Settings = Settings()) -> Boosted:
    """As boost, a model for each of at most MOST_GROUPS values of the column group (null is a group), all grown in the same passes.

    With logistic loss a group of one class has no trees and always scores that class; with squared loss every group has trees.
    """
    model = _by_group(rows, width, group, settings)
    return _fitted(cells, _roots(model, rows, group, "inner").withColumn("__roots", F.array("__root")), model, len(model.groups)) if model.groups else model


def boost_both(cells: DataFrame, rows: DataFrame, width: int, group: str, settings: Settings = Settings()) -> tuple[Boosted, Boosted]:
    """What boost and boost_each give, grown in the same passes."""
    each = _by_group(rows, width, group, settings)
    roots = F.array(F.lit(0), F.coalesce(F.col("__root") + 1, F.lit(-1))) if each.groups else F.array(F.lit(0))
    known = _roots(each, rows, group, "left") if each.groups else rows
    both = _fitted(cells, known.withColumn("__roots", roots), Boosted([], width, settings), 1 + len(each.groups))
    if each.groups:
        each.levels, each.trees = both.levels, [t.part(list(range(1, 1 + len(each.groups)))) for t in both.trees]
    both.trees = [t.part([0]) for t in both.trees]
    return both, each


def _by_group(rows: DataFrame, width: int, group: str, settings: Settings) -> Boosted:
    """A model without trees that knows the groups of rows, and the scores of those of one class."""
    stats = rows.groupBy(group).agg(F.min("y").alias("low"), F.max("y").alias("high")).limit(MOST_GROUPS + 1).collect()
    if len(stats) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups")
    constant = {} if settings.squared else {r[group]: float(r.low) for r in stats if r.low == r.high}
    keys = sorted((r[group] for r in stats if r[group] not in constant), key=lambda k: (k is not None, k))
    return Boosted([], width, settings, groups={k: number for number, k in enumerate(keys)}, constant=constant)


def _walked(model: Boosted, cells: DataFrame, rows: DataFrame, name: str, kind: str, walk) -> DataFrame:
    """rows (.., __root, null for none) with a column of walk(table, used, root) over those that have a root, else null; other columns may have any name."""
    used = model.used()

    def run(batches):
        for batch in batches:
            root = batch.column("__root")
            none = np.asarray(root.is_null())
            found = walk(_table(*_cells(batch), batch.num_rows, used), used, np.asarray(root.fill_null(0)))
            yield pa.RecordBatch.from_arrays([batch.column("__row"), pa.array(found, mask=none)], names=["__row", "__found"])

    kept = rows.select("pair_id", "__root", F.struct(*[c for c in rows.columns if c != "__root"]).alias("__row"))
    wanted = rows.sparkSession.createDataFrame([(int(f),) for f in used], "feature int")  # at most as many as splits
    own = cells.join(F.broadcast(wanted), "feature", "left_semi")
    found = packed(own, kept, model.levels).mapInArrow(run, StructType().add("__row", kept.schema["__row"].dataType).add("__found", kind))
    return found.select("__row.*", F.col("__found").alias(name))


def _with_class(df: DataFrame, model: Boosted) -> DataFrame:
    return df.withColumn("p", F.col("score") if model.settings.squared else (F.col("score") > 0.5).cast("int"))


def predicted(model: Boosted, cells: DataFrame, rows: DataFrame) -> DataFrame:
    """rows with score, the probability of 1, and p, the likelier class; with squared loss both are the prediction."""
    found = _walked(model, cells, rows.withColumn("__root", F.lit(0)), "score", "double", lambda *at: model.score(model.margin(*at)))
    return _with_class(found, model)


def predicted_each(model: Boosted, cells: DataFrame, rows: DataFrame, group: str) -> DataFrame:
    """As predicted, each row by the model of its group; groups of one class score that class, groups that were not trained 0."""
    if not model.groups:
        found = rows.withColumn("score", F.lit(None).cast("double"))
    else:
        found = _walked(model, cells, _roots(model, rows, group, "left"), "score", "double", lambda *at: model.score(model.margin(*at)))
    fixed = rows.sparkSession.createDataFrame(list(model.constant.items()), f"`__group` {rows.schema[group].dataType.simpleString()}, `__fixed` double")  # at most MOST_GROUPS
    found = found.join(F.broadcast(fixed), F.col(group).eqNullSafe(F.col("__group")), "left")
    return _with_class(found.withColumn("score", F.coalesce("score", "__fixed", F.lit(0.0))).drop("__group", "__fixed"), model)


def leaf_of(model: Boosted, cells: DataFrame, rows: DataFrame, tree: int = 0) -> DataFrame:
    """rows with leaf, the node of one tree that each ends in (0 where the model has no trees)."""
    rows = rows.withColumn("__root", F.lit(0))
    if not model.trees:
        return rows.withColumn("leaf", F.lit(0).cast("long")).drop("__root")
    return _walked(model, cells, rows, "leaf", "long", model.trees[tree].leaves)


_NODES = "tree int, node int, feature int, cut double, absent_left boolean, left_node int, right_node int, gain double, hessian double, value double"


def _node_rows(model: Boosted) -> list[tuple]:
    unit = 1 << SCALE_BITS
    rows = []
    for number, t in enumerate(model.trees):
        for k, f in enumerate(t.feature):
            split = (f, model.levels[t.cut[k]], t.absent_left[k], t.left[k], t.right[k], t.gain[k]) if f >= 0 else (None,) * 6
            rows.append((number, k, *split, t.sums[k][1] / unit, t.value[k]))
    return rows


def node_table(spark: SparkSession, model: Boosted) -> DataFrame:
    """(tree, node, feature, cut, absent_left, left_node, right_node, gain, hessian, value) of all nodes; leaves have no feature."""
    return spark.createDataFrame(_node_rows(model), _NODES)


def group_nodes(spark: SparkSession, model: Boosted, kind: str = "long") -> DataFrame:
    """node_table with grp, the group (of type kind) whose tree a node is in."""
    keys, owner = list(model.groups), {}
    for number, t in enumerate(model.trees):
        own = list(range(len(t.feature)))
        for k, f in enumerate(t.feature):  # children come after their parent
            owner[number, k] = keys[own[k]]
            if f >= 0:
                own[t.left[k]] = own[t.right[k]] = own[k]
    return spark.createDataFrame([(*r, owner[r[0], r[1]]) for r in _node_rows(model)], f"{_NODES}, grp {kind}")


def importances(nodes: DataFrame) -> DataFrame:
    """(feature, n_splits, score): a feature's mean gain over its splits in node_table, as a share of the sum over features."""
    mean = nodes.where("feature IS NOT NULL").groupBy("feature").agg(F.count("*").alias("n_splits"), F.avg("gain").alias("mean"))
    return mean.join(mean.agg(F.sum("mean").alias("total"))).select("feature", "n_splits", (F.col("mean") / F.col("total")).alias("score"))
