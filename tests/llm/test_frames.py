"""Rows picked by their numbers: all of them, none, and more than one broadcast holds."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from variantlab.llm import frames
from variantlab.llm.frames import picked, stored


@pytest.mark.parametrize("limit", [3, 500_000])
@pytest.mark.parametrize("step", [1, 3, 700, None])
def test_picked_rows_are_not_shuffled(spark, monkeypatch, limit, step):
    monkeypatch.setattr(frames, "BROADCAST_ROWS", limit)
    rows = stored(spark.range(0, 900, 1, 5).select(F.monotonically_increasing_id().alias("row"), "id", F.lit("a").alias("word"), F.lit("b").alias("Bits")), "rows")
    asked = rows.where(f"id % {step} = 0" if step else "false").select("row")
    want = {i for i in range(900) if step and i % step == 0}
    for keep in (True, False):
        out = picked(rows, asked, "row", keep)
        assert out.columns == rows.columns
        assert sorted(r.id for r in out.collect()) == sorted(want if keep else set(range(900)) - want)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan
