"""Scans cut at time buckets give what one scan over each key gives."""

import random

import pytest
from pyspark.sql import functions as F

from trafficloom.operators import joins, segments, series, tagging

PROBES = "target string, ts timestamp_ntz, event_id bigint, ok boolean, streak_of string"


def observations(seed, n=400):
    g, rows = random.Random(seed), []
    for i in range(n):
        target = g.choice(["a", "a", "a", "b", "c", None])
        second = g.randrange(0, 200) if target == "c" else g.randrange(0, 40 * 3600)
        rows.append((target, second, i, g.choice([None] + [target == "b" or second // 20_000 % 2 == 0] * 6 + [g.random() < 0.5]), "clash"))
    return rows


def by_hand(rows, rise, fall):
    out, now = {}, {}
    for target, _, i, ok, _ in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        last, streak, state, seen = now.get(target, (None, 0, None, False))
        streak = streak + 1 if ok is not None and ok == last else 1
        was = state
        state = True if ok and streak >= rise else False if ok is False and streak >= fall else state
        out[i] = (streak, state, was, not seen)
        now[target] = ok, streak, state, True
    return out


@pytest.mark.parametrize("seed,rise,fall", [(1, 1, 1), (2, 2, 3), (3, 5, 4), (4, 30, 30)])
def test_runs(spark, seed, rise, fall):
    rows = observations(seed)
    df = spark.createDataFrame([(t, s, i, ok, x) for t, s, i, ok, x in rows], "target string, s bigint, event_id bigint, ok boolean, streak_of string")
    for bucket in (F.floor(F.col("s") / 3600), F.floor(F.col("s") / 7), F.lit(0)):
        got = segments.runs(df, ["target"], ["s", "event_id"], "ok", bucket, rise, fall)
        assert {r.event_id: (r.streak, r.state, r.was, r._head) for r in got.collect()} == by_hand(rows, rise, fall)


def test_runs_of_rows_without_a_time(spark):
    df = spark.sql("select 'a' as target, cast(t as timestamp) as ts, id as event_id, ok from values (null, 1, true), (null, 2, true), ('2024-01-01 00:00:00', 3, true), ('2024-01-01 05:00:00', 4, true), ('2024-01-01 05:00:00', 5, false) as x(t, id, ok)")
    assert {r.event_id: r.streak for r in series.streaks(df, ["target"], ["ts", "event_id"], "ok").collect()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}


def test_health_over_buckets(spark):
    rows = observations(9)
    df = spark.createDataFrame([(t, s, i, ok) for t, s, i, ok, _ in rows], "target string, s bigint, event_id bigint, ok boolean").selectExpr("target", "timestamp_seconds(s) as ts", "event_id", "ok")
    found = tagging.target_health(df, 2, 2, {"b": "FORCE_UP"})
    want, name = by_hand(rows, 2, 2), {True: "UP", False: "DOWN", None: "UP"}
    targets = {r[2]: r[0] for r in rows}
    state = {i: "UP" if targets[i] == "b" else name[x[1]] for i, x in want.items()}
    assert {r.event_id: r.state for r in found.collect()} == state
    changed = {i for i, x in want.items() if targets[i] != "b" and name[x[1]] != name[x[2]]}
    assert {r.event_id for r in tagging.health_transitions(found).collect()} == changed
    intervals = tagging.health_intervals(found).collect()
    heads = sum(x[3] for x in want.values())
    assert len(intervals) == heads + len(changed - {i for i, x in want.items() if x[3]}) and sum(r.to_ts is None for r in intervals) == heads


def test_no_window_over_a_whole_target(spark):
    df = spark.createDataFrame([("a", 1, 1, True)], "target string, s bigint, event_id bigint, ok boolean").selectExpr("target", "timestamp_seconds(s) as ts", "event_id", "ok")
    plan = tagging.target_health(df)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    apart = [line for line in windows if "windowspecdefinition(_seg#" not in line]
    # the others are over summaries: the join's right side, which the plan prints last, below the groups of buckets
    assert 0 < len(apart) < len(windows) and plan.index("Join") < min(map(plan.index, apart)) and max(map(plan.index, apart)) < plan.rindex("Aggregate [_seg#")


@pytest.mark.parametrize("allowance", [tagging.Allowance(2, 1, 1000), tagging.Allowance(3, 2, 700, ttl_ns=900), tagging.Allowance(1, 5, 100_000_000)])
def test_throttle_in_pieces(spark, allowance):
    g, rows, at = random.Random(5), [], {}
    for i in range(600):
        key = g.choice(["hot", "hot", "hot", "x", None])
        at[key] = at.get(key, 0) + g.choice([0, 1, 300, 900, 901, 2000, 50_000_000, 3_600_000_000_000, 9_000_000_000_000])
        rows.append((g.choice(["r", None]), key, at[key], i))
    df = spark.createDataFrame(rows, "route_id string, client_ip string, client_start_ns bigint, event_id bigint")
    whole = {r.id: tuple(r) for r in tagging.throttle_tag(df, allowance).collect()}
    cut = {r.id: tuple(r) for r in tagging.throttle_tag(df, allowance, hot_rows=20).collect()}
    assert cut == whole and len(cut) == 600 and not all(r[3] for r in whole.values())


def test_a_hot_key_becomes_several_pieces(spark):
    rows = [("r", "hot", k * 10_000_000_000_000 + i, k * 100 + i) for k in range(40) for i in range(20)]
    df = spark.createDataFrame(rows, "route_id string, key string, at bigint, id bigint")
    cut = segments.pieces(df, ["route_id", "key"], "at", 1_000_000, segments.hours("at", ns=True))
    assert sorted(r["count"] for r in cut.groupBy("_piece").count().collect()) == [20] * 40
    apart = segments.pieces(df, ["route_id", "key"], "at", 10**15, segments.hours("at", ns=True))
    assert [r["count"] for r in apart.groupBy("_piece").count().collect()] == [800]


@pytest.mark.parametrize("size", [3600, 50, 10**9])
def test_versions_and_health_on_one_timeline(spark, size):
    """As-of versions and targets up at a time, by trying every change, with ties, nulls and open intervals."""
    g = random.Random(size)
    moment = lambda: g.choice([None, *range(0, 20_000, 250)])
    requests = [(i, moment(), g.choice(["a", "b", None]), g.choice(["spare", None]), "clash") for i in range(300)]
    versions = [(f"v{k}", g.randrange(0, 20_000, 250)) for k in range(30)]
    spans = []
    for _ in range(60):
        a = g.randrange(0, 20_000, 250)
        spans.append((g.choice(["a", "b"]), g.choice("xyz"), g.choice(["UP", "UP", "DOWN"]), a, g.choice([None, a, a + 250, a + g.randrange(0, 9000, 250)])))
    time = lambda c: F.timestamp_seconds(c).alias(c)
    asked = spark.createDataFrame(requests, "id int, ts bigint, route_id string, fallback_route_id string, _version string").select("id", time("ts"), "route_id", "fallback_route_id", "_version")
    reloads = spark.createDataFrame(versions, "version string, valid_from bigint").select("version", time("valid_from"))
    intervals = spark.createDataFrame(spans, "route_id string, target string, state string, from_ts bigint, to_ts bigint").select("route_id", "target", "state", time("from_ts"), time("to_ts"))
    bucket = F.floor(F.unix_seconds("_at") / size)
    found = joins.config_as_of(asked, reloads, bucket=bucket)
    assert found.columns == [*asked.columns, "version"]
    active = {i: max(((b, v) for v, b in versions if t is not None and b <= t), default=(0, None))[1] for i, t, *_ in requests}
    assert {r.id: r.version for r in found.collect()} == active
    up = {i: sum(route == r and s == "UP" and t is not None and a <= t and (b is None or t < b) for r, _, s, a, b in spans) for i, t, route, *_ in requests}
    got = joins.availability_join(asked, intervals, bucket=bucket).collect()
    assert {r.id: r.healthy for r in got} == up and len(got) == 300
    assert all(r.outcome == ("PROXY" if r.healthy else "FALLBACK" if r.fallback_route_id else "503") for r in got)
