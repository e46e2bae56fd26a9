"""Every registered query with an SQL form against DuckDB, the others for rows and a stable schema."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from quirefold.plans import catalogue

NAMES = sorted(catalogue.queries())
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(((tuple(plain(r[i]) for i in order)) for r in rows), key=str)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, data, name):
    df = catalogue.queries()[name](spark, data)
    got = rows_of(df.columns, df.collect())
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert df.schema == catalogue.queries()[name](spark, data).schema
        return
    cursor = duck.execute(sql)
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert got == rows_of(names, cursor.fetchall())


def test_entry(spark):
    assert os.path.isdir(entry.SMOKE_DIR)
    assert entry.entry(spark).count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
