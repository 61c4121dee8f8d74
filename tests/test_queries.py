"""Core queries against their SQL in DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import solarloom.cycle_queries  # noqa: F401  (registers its queries)
import solarloom.publish_queries  # noqa: F401  (registers its queries)
import solarloom.view_queries  # noqa: F401  (registers its queries and the forecast's)
from solarloom.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"


def rows(found, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def plain(x):
        return "nan" if isinstance(x, float) and math.isnan(x) else round(x, 5) + 0.0 if isinstance(x, float) else x

    return sorted([tuple(plain(r[i]) for i in order) for r in found], key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    want = duck.execute(SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(df.columns)
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(want.fetchall(), names)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {"itr03_joint_fit"}))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() >= 0
