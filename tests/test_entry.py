"""The queries agree with DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from concord.plans import catalogue

TABLES = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for p in glob.glob(f"{TABLES}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def test_entry(spark):
    assert entry.entry(spark).count() == 3


def test_every_query_has_a_name_and_sql():
    assert catalogue.QUERIES.keys() <= entry.queries().keys()
    assert catalogue.ORACLE_SQL.keys() == catalogue.QUERIES.keys()


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, database, name):
    ours = entry.queries()[name](spark, TABLES)
    theirs = database.sql(entry.oracle_sql()[name])
    names = sorted(ours.columns)
    assert names == sorted(theirs.columns)
    at = [theirs.columns.index(c) for c in names]
    assert sorted(tuple(str(r[c]) for c in names) for r in ours.collect()) == sorted(tuple(str(r[i]) for i in at) for r in theirs.fetchall())
