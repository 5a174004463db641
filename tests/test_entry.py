from __future__ import annotations

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

CORE = [k for k in entry.queries() if not k.startswith("p") or k.startswith("p7")]


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


def _cell(x):
    if isinstance(x, (list, tuple)):
        return tuple(map(_cell, x))
    return None if x != x else x + 0.0 if isinstance(x, float) else x


@pytest.mark.parametrize("name", [k for k in CORE if k in entry.oracle_sql()])
def test_query_equals_its_sql(spark, con, data, name):
    got = entry.queries()[name](spark, data)
    columns = sorted(got.columns)
    rows = sorted(repr(tuple(_cell(r[c]) for c in columns)) for r in got.collect())
    rel = con.sql(entry.oracle_sql()[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert rows == sorted(repr(tuple(_cell(r[i]) for i in at)) for r in rel.fetchall())


@pytest.mark.parametrize("name", [k for k in CORE if k not in entry.oracle_sql()])
def test_query_without_sql_runs(spark, data, name):
    entry.queries()[name](spark, data).count()


def test_entry(spark, data):
    assert entry.entry(spark).limit(1).count() == 1
