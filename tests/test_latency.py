"""Latency rollups that merge."""

import random

from trafficloom.operators import metrics


def rows(spark, n, seed=1):
    g = random.Random(seed)
    made = []
    for _ in range(n):
        at = g.randrange(0, 5 * 3600) * 1_000_000_000
        made.append((g.choice("ab"), at, at + int(g.lognormvariate(15, 1)), g.choice([200, 404, 500])))
    return made, spark.createDataFrame(made, "route_id string, client_start_ns bigint, client_end_ns bigint, status int")


def test_merged_rollups_equal_one(spark):
    made, df = rows(spark, 3000)
    ticks = metrics.latency_ticks(df, 60)
    whole, found = metrics.latency_quantiles(metrics.latency_ticks(df, 10**6)), metrics.latency_quantiles(metrics.merge_latency(ticks))
    plain = ["route_id", "requests", "errors", "duration_ns_sum", "max_ns"]
    assert sorted(map(tuple, found.select(plain).collect())) == sorted(map(tuple, whole.select(plain).collect()))
    for r in found.collect():
        own = sorted(e - s for route, s, e, _ in made if route == r.route_id)
        for p, got in ((0.5, r.p50_ns), (0.99, r.p99_ns)):
            assert abs(sum(x <= got for x in own) / len(own) - p) < 0.01


def test_few_values_are_exact(spark):
    df = spark.createDataFrame([("a", 0, d, 200) for d in range(1, 102)], "route_id string, client_start_ns bigint, client_end_ns bigint, status int")
    parts = [metrics.latency_ticks(df.where(f"client_end_ns % 3 = {k}"), 1) for k in range(3)]
    r = metrics.latency_quantiles(metrics.merge_latency(parts[0].union(parts[1]).union(parts[2]))).first()
    assert (r.requests, r.p50_ns, r.p99_ns, r.max_ns) == (101, 51, 100, 101)


def test_nothing_measured(spark):
    df = spark.createDataFrame([("a", None, None, 200)], "route_id string, client_start_ns bigint, client_end_ns bigint, status int")
    r = metrics.latency_quantiles(metrics.merge_latency(metrics.latency_ticks(df, 1))).first()
    assert (r.requests, r.p50_ns, r.max_ns) == (1, None, None)
    assert metrics.latency_quantiles(metrics.merge_latency(metrics.latency_ticks(df.limit(0), 1))).count() == 0
