"""Registered queries take all rows of their tables; held against plain counts, not against SQL."""

from __future__ import annotations

import pytest

from variantlab.plans import experiments, features


def test_density_is_over_all_rows(spark, tmp_path):
    rows = [(k, [0.5, 0.1] + [0.0] * 62, 0) for k in range(4)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = features.sparsity(spark, str(tmp_path)).first()
    assert got.nnz == 4 and got.density == pytest.approx(4 / (4 * 64), abs=1e-6)


def test_lookups_take_all_arms(spark, sf_dir):
    headlines = experiments.headline_lookup(spark, sf_dir)
    assert headlines.count() > 0 and headlines.where("headline = '<unknown>'").count() == 0
    enriched = experiments.pair_enriched(spark, sf_dir)
    assert enriched.count() > 0 and enriched.where("is_miss").count() == 0


def test_names_take_all_part_keys(spark, tmp_path):
    rows = [(k, f"part {k}") for k in (1, 7, 14, 2500)]
    spark.createDataFrame(rows, "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    names = experiments.feature_names(spark, str(tmp_path))
    got = {r.name for r in names.where("name LIKE '%part%'").collect()}
    assert got == {f"{space}_{k}_{name}" for k, name in rows for space in ("ctx", "diff")} and names.count() == 5002
    assert tuple(experiments.missing_feature_names(spark, str(tmp_path)).first()) == (5002 - 8, 5002)
