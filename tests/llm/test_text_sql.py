"""Text queries against their SQL in DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from solarloom.llm.queries import oracle_sql, queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    want = con.execute(oracle_sql()[name])
    names = [c[0] for c in want.description]
    got = queries()[name](spark, DATA)
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*names).collect()), key=repr) == sorted(want.fetchall(), key=repr)
