"""The operators that SQL can say, against DuckDB on whole tables."""

import os

import duckdb
import pytest

from pagemill.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(name, spark, sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    expected = con.sql(ORACLE_SQL[name])
    assert cols == sorted(expected.columns)
    assert sorted(map(tuple, df.select(*cols).collect())) == sorted(expected.select(*cols).fetchall())
