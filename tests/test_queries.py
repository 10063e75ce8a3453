"""Every query with SQL against DuckDB on the smallest tables; the others must run."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as contract
from tracequarry.plans import catalogue

SQL = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for p in glob.glob(f"{data}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, data, duck, name):
    df = catalogue.queries()[name](spark, data)
    columns = sorted(df.columns)
    got = sorted(map(repr, (tuple(r) for r in df.select(*columns).collect())))
    if name not in SQL:
        return
    cursor = duck.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    at = [names.index(c) for c in columns]
    assert sorted(names) == columns
    assert got == sorted(repr(tuple(r[i] for i in at)) for r in cursor.fetchall())


def test_contract(spark):
    assert contract.entry(spark).columns[:1] == ["event_id"]
    assert set(contract.oracle_sql()) <= set(contract.queries())
