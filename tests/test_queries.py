"""Every query with SQL against DuckDB on the smallest given tables."""

import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no given tables")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{FOLDER}/{f}'")
    return con


def value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, sql, name):
    got = entry.queries()[name](spark, FOLDER)
    want = sql.sql(entry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    a = Counter(tuple(value(r[c]) for c in columns) for r in got.collect())
    b = Counter(tuple(value(v) for v in r) for r in want.select(*(duckdb.ColumnExpression(c) for c in columns)).fetchall())
    assert a == b


def test_entry(spark):
    assert entry.entry(spark).count() > 0
