"""Every query with SQL against DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from strandex import registry, registry_plans, registry_sources

SF = "/root/testdata/sf0.001"
SQL = registry.oracle_sql() | registry_plans.oracle_sql() | registry_sources.oracle_sql()
QUERIES = registry.queries() | registry_plans.queries() | registry_sources.queries()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, (int, bool)):
        return repr(float(v))
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    if name not in SQL:
        assert got
        return
    want = duck.sql(SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    a = sorted(tuple(norm(r[c]) for c in cols) for r in got)
    at = [want.columns.index(c) for c in cols]
    assert a == sorted(tuple(norm(r[i]) for i in at) for r in want.fetchall())
