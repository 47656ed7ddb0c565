"""Order statistics and running sums over whole columns, by ranges of values rather than in one task."""

from __future__ import annotations

import math

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F


def ranged(df: DataFrame, *order: str) -> DataFrame:
    """df dealt into ranges of order and sorted within each; Spark samples the cuts, as many as there are shuffle partitions."""
    return df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)


def _range_sums(counts: DataFrame) -> list[tuple[float, float, int]]:
    """(least, most, n) of each range of counts (value, n), in order: a row for each shuffle partition."""

    def run(batches):
        low = high = None
        total = 0
        for batch in batches:
            if batch.num_rows:
                low = batch.column("value")[0].as_py() if low is None else low
                high = batch.column("value")[batch.num_rows - 1].as_py()
                total += int(pc.sum(batch.column("n")).as_py())
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([low]), pa.array([high]), pa.array([total])], names=["low", "high", "n"])

    rows = ranged(counts.select(F.col("value").cast("double"), "n"), "value").mapInArrow(run, "low double, high double, n long").collect()
    return sorted((r.low, r.high, r.n) for r in rows)


def quantiles(df: DataFrame, value: str | Column, shares: tuple[float, ...]) -> list[float | None]:
    """Exact quantiles by linear interpolation, nulls left out; all null without values.

    Values are counted, the counts dealt into ranges, and only the ranges that hold a wanted rank are ranked, so no task
    and no buffer holds more than a range. Nothing but the answers and a row for each range reaches the driver.
    """
    counts = df.select((F.col(value) if isinstance(value, str) else value).cast("double").alias("value")).where("value IS NOT NULL").groupBy("value").agg(F.count("*").alias("n"))
    found = _range_sums(counts)
    total = sum(n for _, _, n in found)
    if not total:
        return [None] * len(shares)
    places = [s * (total - 1) for s in shares]
    ranks = sorted({r for p in places for r in (math.floor(p), math.ceil(p))})
    wanted, before = [], 0
    for low, high, n in found:
        inside = [r for r in ranks if before <= r < before + n]
        if inside:
            wanted.append((low, high, before, inside))
        before += n
    at: dict[int, float] = {}
    for low, high, before, inside in wanted:  # at most two for each share
        if low == high:
            at |= dict.fromkeys(inside, low)
            continue
        upto = F.sum("n").over(W.orderBy("value")) + before
        rows = counts.where(F.col("value").between(low, high)).select("value", "n", upto.alias("upto"))
        picks = [F.min(F.when(F.col("upto") > r, F.col("value"))).alias(f"r{k}") for k, r in enumerate(inside)]
        at |= dict(zip(inside, rows.agg(*picks).first(), strict=True))
    return [at[math.floor(p)] + (at[math.ceil(p)] - at[math.floor(p)]) * (p - math.floor(p)) for p in places]
