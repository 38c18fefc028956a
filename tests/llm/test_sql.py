"""Queries of this package against their DuckDB text."""

from __future__ import annotations

import duckdb
import pytest

from pulsegrid.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, sf, name):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    df = queries.QUERIES[name](spark, sf)
    found = c.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    got = sorted(tuple(r[n] for n in names) for r in df.collect())
    assert sorted(names) == sorted(df.columns) and got == sorted(found.fetchall())
