"""The driver contract: names, and results against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = sorted(k for k in entry.registry.QUERIES)


def plain(value):
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, list | tuple):
        return tuple(map(plain, value))
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return None if value != value else value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(OWN) > 50


@pytest.mark.skipif(not os.path.exists(DATA), reason="needs the test tables")
def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.exists(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", OWN)
def test_query(spark, duck, name):
    found = entry.queries()[name](spark, DATA)
    columns = sorted(found.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in found.collect()), key=repr)
    if name in entry.registry.ORACLES:
        result = duck.sql(entry.registry.ORACLES[name])
        assert sorted(result.columns) == columns
        order = [result.columns.index(c) for c in columns]
        assert got == sorted((tuple(plain(r[k]) for k in order) for r in result.fetchall()), key=repr)
