"""Every registered query that has SQL, against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from read_parquet('{DATA}/{name}')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, oracle, name):
    got = entry.queries()[name](spark, DATA).toPandas()
    want = oracle.sql(SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and len(got) == len(want)
    got, want = (d[columns].sort_values(columns, ignore_index=True) for d in (got, want))
    for c in columns:
        assert ((got[c] == want[c]) | (got[c].isna() & want[c].isna())).all(), c


def test_entry_and_names(spark):
    assert entry.entry(spark).count() == 10
    assert set(SQL) <= set(entry.queries())
