"""Queries about networks give their SQL's rows for users whose number is too large for the view's client_ip to be an address."""

import duckdb
import pytest

from trafficloom.plans import column_queries, exchange_queries

QUERIES = column_queries.QUERIES | exchange_queries.QUERIES
ORACLE = column_queries.ORACLE | exchange_queries.ORACLE


@pytest.mark.parametrize("name", ["d05_remote_addr", "d07_condition", "e01_assign_route", "e02_match_networks"])
def test_users_beyond_the_third_number(spark, tmp_path, name):
    rows = [(i, u, t, 1.0, f'{{"k": {k}}}') for i, (u, t, k) in enumerate((u, t, k) for u in (4, 6, 65, 65_535, 65_536, 65_537, 65_542, 89_999, 262_148) for t in ("view", "click") for k in (0, 1, 3))]
    spark.createDataFrame(rows, "event_id bigint, user_id bigint, event_type string, value double, props string").selectExpr("*", "timestamp_ntz '2024-01-01 00:00:00' as ts").write.parquet(f"{tmp_path}/events.parquet")
    duck = duckdb.connect()
    duck.execute(f"create view events as select * from read_parquet('{tmp_path}/events.parquet/*.parquet')")
    theirs = duck.execute(ORACLE[name])
    names = [c[0] for c in theirs.description]
    assert sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).select(names).collect())) == sorted(theirs.fetchall())
