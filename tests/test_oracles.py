"""Every registered query of the catalogue against DuckDB on the smallest tables."""

import decimal
import os

import duckdb
import pytest

from ledgerloom.plans import catalogue

DATA = "/root/testdata/sf0.001"


def plain(v):
    return round(float(v), 5) if isinstance(v, (float, decimal.Decimal)) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=repr)
    want = duck.sql(catalogue.ORACLES[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert got == sorted(([plain(r[i]) for i in at] for r in want.fetchall()), key=repr)


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)
