"""Every query with SQL against DuckDB on the same tables; the others must give rows."""

from __future__ import annotations

from dataclasses import replace

import duckdb
import pandas as pd
import pytest

from variantlab.plans import experiments, features, profiles, trained

SQL = experiments.ORACLE_SQL | features.ORACLE_SQL | profiles.ORACLE_SQL | trained.ORACLE_SQL
QUERIES = experiments.QUERIES | features.QUERIES | profiles.QUERIES | trained.QUERIES
TABLES = ("events", "documents", "embeddings", "pages", "conversations", "part", "lineitem", "labels", "nation")


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    cell = lambda x: "null" if x is None or x is pd.NA or x != x else repr(round(float(x), 9) + 0.0) if isinstance(x, int | float) or hasattr(x, "dtype") else str(x)
    return sorted(tuple(cell(x) for x in row) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, sf_dir, name):
    want = duck.execute(SQL[name]).df()
    got = QUERIES[name](spark, sf_dir).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)
    assert len(got) or name == "group_leaks"


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_model_query_gives_rows(spark, sf_dir, name, monkeypatch):
    for c in ("SETTINGS", "EACH"):
        monkeypatch.setattr(trained, c, replace(getattr(trained, c), trees=3))  # a job for each level of each tree
    assert QUERIES[name](spark, sf_dir).count() > 0
