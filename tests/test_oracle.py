"""Every query that has SQL against DuckDB on the same tables."""

import glob
import math
import os

import duckdb
import pytest

from tessera.plans import queries as dq

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(frame):
    value = lambda x: None if x is None or (isinstance(x, float) and math.isnan(x)) else x.item() if hasattr(x, "item") else x
    rows = [tuple(value(x) for x in r) for r in frame[sorted(frame.columns)].itertuples(index=False)]
    return sorted(rows, key=repr)


@pytest.mark.parametrize("name", sorted(dq.SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = dq.QUERIES[name](spark, SF).toPandas(), duck.sql(dq.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)
    assert len(want) > 0


def test_every_query_has_sql():
    assert set(dq.QUERIES) == set(dq.SQL)
