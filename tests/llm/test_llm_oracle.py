"""Queries of this subpackage against their SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from strandex.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = registry.queries()[name](spark, SF)
    want = con.sql(registry.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    plain = lambda v: repr(round(float(v), 6)) if isinstance(v, (int, float)) else repr(v)
    at = [want.columns.index(c) for c in cols]
    assert sorted(tuple(plain(r[c]) for c in cols) for r in df.collect()) == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())
