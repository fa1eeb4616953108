"""Every driver query against its SQL in DuckDB."""

import math
import os

import duckdb
import pytest

from pagemill.plans.driver_queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for name in os.listdir(sf):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{name}'")
    return con


def plain(rows):
    return sorted(repr(tuple(round(float(v), 9) if isinstance(v, float) and math.isfinite(v) else v for v in r)) for r in rows)


def test_each_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(name, spark, sf, duck):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    expected = duck.sql(ORACLE_SQL[name])
    assert cols == sorted(expected.columns)
    assert plain(map(tuple, df.select(*[f"`{c}`" for c in cols]).collect())) == plain(expected.select(*[f'"{c}"' for c in cols]).fetchall())
