"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns virtual nodes on a ring of 64-bit positions; a document goes clockwise from its own position
to the next virtual node. A shard takes at most its capacity, and what overflows continues clockwise to the next
shard with room. With the law rows, capacities are equal up to one row, so counts end at most one apart, and a
document moves from its own shard only where that shard is full.

The flow is decided on counts of arcs (one number for each virtual node, a bounded table), not on documents:
ranks within an arc, in ring order, then tell where each document stays. Ranks are taken within stretches of 1/16384
of the ring, each from the number of documents before it in its arc, so that windows stay small at any input.

Defined results: a null text has size 1 and the checksum of no bytes; equal rows are told apart by nothing but
their rank, so each gets a slot of its own; a null doc_id's position is that of its text's checksum; very long texts
are measured whole; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from .frames import stored, word_text

VIRTUAL_NODES = 128
#: The ring has 2^STRETCH_BITS stretches of equal length.
STRETCH_BITS = 14


def ring(shards: int, virtual: int = VIRTUAL_NODES) -> list[tuple[int, int]]:
    """(position, shard) of all virtual nodes in clockwise order; a shard's nodes do not depend on how many shards there are."""

    def place(s: int, v: int) -> int:
        return int.from_bytes(hashlib.sha256(f"{s}/{v}".encode()).digest()[:8], "big", signed=True)

    return sorted((place(s, v), s) for s in range(shards) for v in range(virtual))


def flow(counts: list[int], owners: list[int], capacity: list[int]) -> list[tuple[int, int, int, int]]:
    """(arc, shard, first rank, rows): each arc fills its own shard first, in ring order; overflow continues clockwise."""
    room, taken, out = list(capacity), [0] * len(counts), []

    def put(arc: int, shard: int) -> None:
        n = min(counts[arc] - taken[arc], room[shard])
        if n > 0:
            out.append((arc, shard, taken[arc], n))
            taken[arc] += n
            room[shard] -= n

    for arc, shard in enumerate(owners):
        put(arc, shard)
    for arc in range(len(counts)):
        step = 1
        while taken[arc] < counts[arc] and step <= len(owners):
            put(arc, owners[(arc + step) % len(owners)])
            step += 1
    return out


def assign_shards(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and home_shard (the ring's own choice) of each document."""
    spark, nodes = docs.sparkSession, ring(shards)
    places, owners = np.array([p for p, _ in nodes]), [s for _, s in nodes]

    @F.pandas_udf("int")
    def arc_of(at: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(places, at.to_numpy(np.int64)) % len(places)).astype("int32")

    text = word_text()
    key = F.col("doc_id").cast("long")
    crc = F.crc32(text.cast("binary"))
    at = F.xxhash64(F.coalesce(key.cast("string"), F.concat(F.lit("#"), crc.cast("string"))))
    stretch = F.shiftright("at", 64 - STRETCH_BITS).cast("int").alias("stretch")
    counted = stored(docs.select(at.alias("at")).select(arc_of("at").alias("arc"), stretch).groupBy("arc", "stretch").count(), "stretches")
    counts = [0] * len(owners)
    for arc, n in counted.groupBy("arc").agg(F.sum("count")).collect():  # one number for each virtual node
        counts[arc] = n
    total = sum(counts)
    capacity = [total // shards + (s < total % shards) for s in range(shards)]
    base, segments = [0] * shards, []
    for arc, shard, first, n in flow(counts, owners, capacity):
        segments.append((arc, shard, owners[arc], first, first + n, base[shard] - first))
        base[shard] += n
    plan = spark.createDataFrame(segments, "arc int, shard int, home_shard int, low long, high long, shift long")
    # at most as many rows as stretches and virtual nodes
    before = counted.select("arc", "stretch", (F.sum("count").over(W.partitionBy("arc").orderBy("stretch")) - F.col("count")).alias("before"))
    rows = docs.select(key.alias("doc_id"), at.alias("at"), (F.octet_length(text).cast("long") + 1).alias("size"), crc.alias("text_crc32")).select("*", arc_of("at").alias("arc"), stretch)
    own = F.row_number().over(W.partitionBy("arc", "stretch").orderBy("at", "doc_id", "text_crc32")).cast("long") - 1
    ranked = rows.withColumn("own", own).join(F.broadcast(before), ["arc", "stretch"]).withColumn("rank", F.col("own") + F.col("before"))
    placed = ranked.join(F.broadcast(plan), "arc").where("rank >= low AND rank < high")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("rank") + F.col("shift")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "home_shard")


def write_shards(docs: DataFrame, path: str, shards: int = 8) -> None:
    """Writes docs into one folder for each shard; doc_id must be unique."""
    placed = assign_shards(docs, shards).select("doc_id", "shard", "slot")
    docs.join(placed, "doc_id").write.partitionBy("shard").parquet(path)
