"""The queries of this subpackage that SQL can express, against DuckDB on whole tables."""

from __future__ import annotations

import duckdb
import pytest

from variantlab.llm.queries import ORACLE_SQL, QUERIES

from test_oracle import canonical


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query_equals_sql(spark, name, sf):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/{sf}/{t}.parquet'")
    want = con.execute(ORACLE_SQL[name]).df()
    got = QUERIES[name](spark, f"/root/testdata/{sf}").toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)
    assert len(got)
