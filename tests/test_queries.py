"""Every query with SQL gives the same rows as DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from fieldlens.plans import queries as q

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query(spark, duck, name):
    got = q.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    want = duck.execute(f"SELECT {', '.join(columns)} FROM ({q.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, map(tuple, got.select(*columns).collect()))) == sorted(map(str, want))
