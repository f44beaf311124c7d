"""Every core query with SQL against DuckDB on the smallest tables; every other one at least runs."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from qirtas import registry


def value(v):
    if isinstance(v, float):
        return round(v, 5)
    return tuple(map(value, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, data, duck, name):
    df = registry.QUERIES[name](spark, data)
    rows = df.collect()
    if name not in registry.ORACLES:
        return
    r = duck.execute(registry.ORACLES[name])
    cols = [c[0] for c in r.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted((tuple(value(x[cols.index(c)]) for c in sorted(cols)) for x in r.fetchall()), key=str)
    got = sorted((tuple(value(x[c]) for c in sorted(cols)) for x in rows), key=str)
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
