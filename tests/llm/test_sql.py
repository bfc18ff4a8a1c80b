"""Queries with SQL agree with DuckDB on the smallest tables; op 10's law holds there."""

import duckdb
import pytest

from riskweave.llm import queries

from ..conftest import SF_SMALL


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    rel = con.sql(queries.ORACLE[name])
    df = queries.QUERIES[name](spark, SF_SMALL)
    assert sorted(df.columns) == sorted(rel.columns)
    order = [df.columns.index(c) for c in rel.columns]
    assert sorted(tuple(r[i] for i in order) for r in df.collect()) == sorted(rel.fetchall())
