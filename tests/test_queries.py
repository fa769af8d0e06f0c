"""Every query with SQL gives the same rows as DuckDB on the smallest tables; every other runs."""

import math
import os
from datetime import date, datetime
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
CORE = [n for n, f in __spark_entry__.queries().items() if ".llm" not in f.__module__]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{FOLDER}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 3)
    if isinstance(v, Decimal):
        return round(float(v), 3)
    if isinstance(v, (datetime, date)):
        return v.isoformat()
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", CORE)
def test_query(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, FOLDER)
    rows = df.collect()
    sql = __spark_entry__.oracle_sql().get(name)
    if sql is None:
        return
    result = duck.execute(sql)
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    mine = sorted((tuple(plain(r[c]) for c in order) for r in rows), key=repr)
    theirs = sorted((tuple(plain(r[columns.index(c)]) for c in order) for r in result.fetchall()), key=repr)
    assert mine == theirs


def test_entry(spark):
    out = __spark_entry__.entry(spark)
    assert out.columns == ["zone_id", "bracket", "fitted"] and out.count() > 0
