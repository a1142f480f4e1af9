"""Queries against their SQL over the smallest test data."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

#: All queries with SQL if ALL_QUERIES is set (some eight minutes); else every seventh, so that each family is met.
EVERY = sorted(entry.oracle_sql())
CHOSEN = EVERY if os.environ.get("ALL_QUERIES") else EVERY[::7]


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{sf}/{f}')")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple("" if v is None or v is pd.NA or v != v else repr(round(float(v), 6)) if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v) for v in r) for r in df.astype(object).itertuples(index=False))


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", CHOSEN)
def test_same_rows(spark, con, sf, name):
    got, want = entry.queries()[name](spark, sf).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
