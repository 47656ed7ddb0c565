"""CSV shared between tasks against the reader of whole files, and vectors that are read by feature."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from variantlab.sources import files


@pytest.fixture
def small_ranges(spark):
    names = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "40"}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_quoted_line_breaks_across_ranges(spark, small_ranges, tmp_path):
    rng = random.Random(4)
    piece = lambda: rng.choice(["a", "é", ",", '"', "\n", "\n\n", ' "q" ', "word ", "\t", "x,y", '""', "long " * 20])
    rows = [(k, rng.choice([None, "".join(piece() for _ in range(rng.randrange(1, 14)))]), rng.random() < 0.5) for k in range(400)]
    table = spark.createDataFrame(rows, "id long, text string, flag boolean").coalesce(2)
    table.write.csv(f"{tmp_path}/csv", header=True, quote='"', escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    schema = "id long, text string, flag boolean"
    found = files.quoted_records(spark, f"{tmp_path}/csv")
    assert spark.read.option("lineSep", "\n").text(f"{tmp_path}/csv").rdd.getNumPartitions() > 10
    assert found.select("file").distinct().count() == 2 and found.where("record > 1").count() == 400
    got = sorted(map(tuple, files.read_csv_ranges(spark, f"{tmp_path}/csv", schema).collect()))
    want = sorted(map(tuple, files.read_csv(spark, f"{tmp_path}/csv", schema).collect()))
    assert got == want == sorted(rows)


def test_a_file_of_carriage_returns_and_blank_lines(spark, tmp_path):
    (tmp_path / "x.csv").write_bytes(b'id,text\r\n1,"a\nb"\r\n\r\n2,plain\r\n3,"say ""x"", then\r\n,more"')
    got = sorted(map(tuple, files.read_csv_ranges(spark, f"{tmp_path}/x.csv", "id long, text string").collect()))
    assert got == [(1, "a\nb"), (2, "plain"), (3, 'say "x", then\r\n,more')]
    (tmp_path / "y.csv").write_bytes(b"id,text\n")
    assert files.read_csv_ranges(spark, f"{tmp_path}/y.csv", "id long, text string").count() == 0


def test_few_features_read_few_row_groups(spark, tmp_path):
    cells = spark.range(200_000).select(F.col("id").alias("pair_id"), F.pmod(F.xxhash64("id"), F.lit(2000)).cast("int").alias("feature"), F.rand(3).alias("value"))
    files.write_by_feature(cells, f"{tmp_path}/v", row_group_bytes=1 << 16)
    wanted = [3, 500, 501, 1200, 1999, 77, 78, 79, 80, 1500]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = files.read_features(spark, f"{tmp_path}/v", wanted)
        got = {(r.pair_id, r.feature) for r in found.collect()}
        plan = found._jdf.queryExecution().executedPlan()
        scan = plan.collectLeaves().apply(0)
        read = scan.metrics().apply("numOutputRows").value()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert got == {(r.pair_id, r.feature) for r in cells.where(F.col("feature").isin(wanted)).select("pair_id", "feature").collect()}
    assert len(got) > 500 and read < 0.3 * 200_000
