"""Every registered query runs, and equals its SQL."""

import glob
import os

import pandas as pd
import pytest

import __spark_entry__ as entry
from relweave.plans import queries as core

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")


def cell(x):
    if x is None or x is pd.NaT or (isinstance(x, float) and x != x):
        return "null"
    return f"{x:.5g}" if isinstance(x, float) else str(x)


@pytest.fixture(scope="module")
def db():
    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query(spark, db, name):
    compare(spark, db, name)


def compare(spark, db, name):
    df = entry.queries()[name](spark, DATA)
    got = sorted(tuple(map(cell, r)) for r in df.select(*sorted(df.columns)).collect())
    sql = entry.oracle_sql().get(name)
    if sql:
        r = db.execute(sql)
        cols = [x[0] for x in r.description]
        assert sorted(cols) == sorted(df.columns)
        order = [cols.index(c) for c in sorted(cols)]
        assert got == sorted(tuple(cell(row[i]) for i in order) for row in r.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
