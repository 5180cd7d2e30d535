"""Thousands of mixed rules, each tried by hand on every request."""

import ipaddress
import json
import random
import re

import pytest

from trafficloom.functions import predicates as P
from trafficloom.operators import joins, rulebook

HOSTS, METHODS = ["a.com", "B.com", "c.com"], ["GET", "POST", "PUT"]
ADDRESSES = ["10.0.0.1", "10.0.1.200", "192.168.7.7", "2001:db8::1", "fd00::5", "not one", None]


def some_rule(g, depth=0):
    kind = g.randrange(9 if depth < 3 else 6)
    if kind == 0:
        return {"Host": {"hosts": g.sample([h.upper() for h in HOSTS], 2)}}
    if kind == 1:
        return {"Method": {"include": g.sample(METHODS, g.randrange(1, 3))}}
    if kind in (2, 3):
        return {"PathStartsWith": {"prefix": "/" + "".join(g.choice("ab/") for _ in range(g.randrange(5)))}}
    if kind == 4:
        return {"RegexPath": {"regexp": g.choice(["/a.*", "/[ab]+", ".*b", "/a/?b*"])}}
    if kind == 5:
        return {"RemoteAddr": {"source": g.choice(["10.0.0.0/8", "10.0.1/24", "192.168.7.7", "2001:db8::/32", "fd00::/8", "0.0.0.0/0"])}}
    inner = [some_rule(g, depth + 1) for _ in range(g.randrange(3))]
    return {"not": inner} if kind == 6 else {"or": inner} if kind == 7 else g.choice([{"and": inner}, inner, {k: v for x in inner if isinstance(x, dict) for k, v in x.items()}])


def holds(rule, host, method, path, ip):
    if rule is None:
        return True
    if isinstance(rule, list):
        return all(holds(x, host, method, path, ip) for x in rule)
    for name, body in rule.items():
        if name in ("and", "or"):
            ok = not body or (all if name == "and" else any)(holds(x, host, method, path, ip) for x in body)
        elif name == "not":
            ok = not holds(body, host, method, path, ip)
        elif name == "Host":
            ok = host is not None and host.split(":")[0].lower() in [h.lower() for h in body["hosts"]]
        elif name == "Method":
            ok = method in body["include"]
        elif name == "PathStartsWith":
            ok = path is not None and path.startswith(body["prefix"])
        elif name == "RegexPath":
            ok = path is not None and re.fullmatch(body["regexp"], path) is not None
        else:
            try:
                ok = ipaddress.ip_address(ip) in P.parse_network(body["source"])
            except ValueError:
                ok = False
        if not ok:
            return False
    return True


def test_mixed_rules_by_hand(spark):
    g = random.Random(12)
    rows = [(i, [("Host", h)] if (h := g.choice([*HOSTS, "A.COM:80", None])) else [], g.choice([*METHODS, None]), g.choice([None, *["/" + "".join(g.choice("ab/") for _ in range(g.randrange(6))) for _ in range(40)]]), g.choice(ADDRESSES), "clash", "old") for i in range(300)]
    df = spark.createDataFrame(rows, "id int, headers array<struct<name: string, value: string>>, method string, path string, client_ip string, `_i.ds` string, route_id string").repartition(3)
    for n in (400, 1):
        # the first rules hold for little, so that many are tried
        routes = [(f"r{k}", [some_rule(g) for _ in range(max(1, 5 - k // 60))]) for k in range(n)]
        got = rulebook.assign_by_rules(df, routes)
        want = {i: next((name for name, rule in routes if holds(rule, (dict(h) or {}).get("Host"), m, p, ip)), None) for i, h, m, p, ip, *_ in rows}
        assert {r.id: r.route_id for r in got.collect()} == want
        assert got.columns == ["id", "headers", "method", "path", "client_ip", "_i.ds", "route_id"]
    few = routes + [("last", None)]
    same = joins.assign_route(df, few).select("id", "route_id").collect()
    assert sorted(map(tuple, same)) == sorted(map(tuple, rulebook.assign_by_rules(df, few).select("id", "route_id").collect()))
    table = spark.createDataFrame([(k, name, json.dumps(rule) if rule else None) for k, (name, rule) in enumerate(few)][::-1], "ordinal int, route_id string, rule string")
    assert sorted(map(tuple, same)) == sorted(map(tuple, rulebook.assign_by_rules(df, table).select("id", "route_id").collect()))


def test_edges(spark):
    df = spark.createDataFrame([(1, [], None, None, None)], "id int, headers array<struct<name: string, value: string>>, method string, path string, client_ip string")
    assert rulebook.assign_by_rules(df, []).first().route_id is None
    assert rulebook.assign_by_rules(df, [("all", None)]).first().route_id == "all"
    assert rulebook.assign_by_rules(df, [("no", {"Method": {"include": ["GET"]}}), ("not", {"not": {"Method": {"include": ["GET"]}}})]).first().route_id == "not"
    assert rulebook.assign_by_rules(df.limit(0), [("all", None)]).count() == 0
    for bad in ({"Nothing": {}}, {"Host": {"host": []}}, {"Method": "GET"}, "text"):
        with pytest.raises(ValueError):
            rulebook.assign_by_rules(df, [("x", bad)])


def test_more_rules_than_a_driver_reads(spark):
    """A table of more than 100,000 rules, ordered by a struct; a request meets only those anchored in what it has."""
    rules = spark.range(120_000).selectExpr(
        "named_struct('a', id % 7, 'b', id) as ordinal", "concat('r', id) as route_id",
        """concat('{"PathStartsWith": {"prefix": "/', id, '/"}, "not": {"Method": {"include": ["PUT"]}}}') as rule""",
    )
    df = spark.createDataFrame([(n, [], m, f"/{n}/x", None) for n, m in ((3, "GET"), (99_999, "PUT"), (110_000, None), (120_000, "GET"))], "id int, headers array<struct<name: string, value: string>>, method string, path string, client_ip string")
    got = rulebook.assign_by_rules(df, rules)
    assert {r.id: r.route_id for r in got.collect()} == {3: "r3", 99_999: None, 110_000: "r110000", 120_000: None}


def test_anchors_hold_wherever_the_rule_does():
    m, p = {"Method": {"include": ["GET"]}}, {"PathStartsWith": {"prefix": "/long"}}
    anchors = lambda rule: rulebook.compiled(rule)[1]
    assert anchors([m, p]) == ["P:/long"] and anchors({"or": [m, p]}) == ["M:GET", "P:/long"]
    assert anchors({"not": p}) == anchors(None) == ["*"]
    assert anchors({"not": [{"not": p}]}) == ["P:/long"] and anchors({"not": []}) == []
    assert [rulebook.literal_beginning(x) for x in ("/ab?c", "/ab[cd]", "/a|b", "(/a)", "/ab+", "/a.b", "/ab{0}")] == ["/a", "/ab", "", "", "/ab", "/a", "/a"]


def test_mixed_rules_of_users_beyond_the_third_number(spark, tmp_path):
    """From user 65,536 on the view's client_ip is no address; rules and requests name one all the same."""
    import duckdb

    from trafficloom.plans import exchange_queries as Q

    rows = [(i, u, "view", 1.0, f'{{"k": {k}}}') for i, (u, k) in enumerate((u, k) for u in (3, 65_535, 65_536, 65_538, 75_009, 89_999, 262_148) for k in (2, 11, 14, 36, 41, 43, 57, 64, 73))]
    spark.createDataFrame(rows, "event_id bigint, user_id bigint, event_type string, value double, props string").selectExpr("*", "timestamp_ntz '2024-01-01 00:00:00' as ts").write.parquet(f"{tmp_path}/events.parquet")
    duck = duckdb.connect()
    duck.execute(f"create view events as select * from read_parquet('{tmp_path}/events.parquet/*.parquet')")
    want = dict(duck.execute(Q.ORACLE["e01_mixed_rules"]).fetchall())
    assert {r.event_id: r.route for r in Q.e01_mixed_rules(spark, str(tmp_path)).collect()} == want and len(set(want.values())) > 10
