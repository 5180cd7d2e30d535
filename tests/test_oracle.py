"""Every query with an oracle gives the same rows in Spark and in DuckDB."""

import decimal
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from trafficloom.plans import column_queries, exchange_queries

QUERIES = column_queries.QUERIES | exchange_queries.QUERIES
ORACLE = column_queries.ORACLE | exchange_queries.ORACLE


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{sf_dir}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    names = sorted(df.columns)
    ours = [tuple(plain(r[c]) for c in names) for r in df.collect()]
    cursor = duck.execute(ORACLE[name])
    theirs_names = [d[0] for d in cursor.description]
    assert sorted(theirs_names) == names
    theirs = [tuple(plain(r[theirs_names.index(c)]) for c in names) for r in cursor.fetchall()]
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    assert sorted(ours, key=key) == sorted(theirs, key=key)


def test_registered(spark):
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())
    assert entry.entry(spark).count() > 0
