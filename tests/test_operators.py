"""Edge rows that the driver tables don't have."""

import datetime
import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from trafficloom.functions import crc as C
from trafficloom.functions import exchange as X
from trafficloom.functions import headers as H
from trafficloom.functions import predicates as P
from trafficloom.functions import rewrite as R
from trafficloom.operators import assemble, joins, metrics, policy, series, tagging
from trafficloom.schema import EVENT_SCHEMA
from trafficloom.sources import journal as J
from trafficloom.streaming import exchanges as S


def events(spark, rows):
    """Rows (req_id, seq, event_type, overrides)."""
    names = [x.name for x in spark.createDataFrame([], EVENT_SCHEMA).schema]
    return spark.createDataFrame([tuple(({"req_id": r, "seq": s, "event_type": t} | o).get(c) for c in names) for r, s, t, o in rows], EVENT_SCHEMA)


END = {"status": 200, "client_start_ns": 1000, "client_end_ns": 2000, "proxy_start_ns": -1}


def test_reassembly_edges(spark):
    rows = [
        ("only-end", 1, "END", END), ("late", 1, "REQUEST_BODY", {"body": b"a"}), ("late", 2, "CLIENT_REQUEST", {"start_line": "GET /x HTTP/1.1"}), ("late", 3, "REQUEST_BODY", {"body": b"b"}), ("late", 4, "END", END),
        ("no-client", 1, "CLIENT_RESPONSE", {"status": 200}), ("no-client", 2, "END", END), ("zero", 1, "CLIENT_REQUEST", {}), ("zero", 2, "END", END | {"status": 0}), ("open", 1, "CLIENT_REQUEST", {}),
        ("twice", 1, "CLIENT_REQUEST", {"start_line": "A"}), ("twice", 2, "CLIENT_REQUEST", {"start_line": "B"}), ("twice", 3, "END", END), ("twice", 4, "CLIENT_REQUEST", {"start_line": "C"}), ("twice", 5, "END", END | {"status": 201}),
    ]
    random.Random(1).shuffle(rows)
    got = {(r.req_id, r.generation): r for r in assemble.reassemble(events(spark, rows)).collect()}
    assert set(got) == {("late", 0), ("twice", 0), ("twice", 1)}
    assert [bytes(b) for b in got["late", 0].request_body] == [b"b"]
    assert got["twice", 0].client_request.start_line == "B" and got["twice", 1].status == 201
    bad = {(r.req_id, r.anomaly) for r in assemble.anomalies(events(spark, rows)).collect()}
    assert bad == {("only-end", "ORPHAN_END"), ("late", "BODY_WITHOUT_START"), ("no-client", "NO_CLIENT_REQUEST"), ("zero", "NO_STATUS"), ("open", "IN_FLIGHT")}


def test_interleaved_exchanges(spark):
    rows = []
    for t in range(8):
        for r in range(50):
            base, req = r * 10, f"req-{t}-{r}"
            rows += [(req, base, "CLIENT_REQUEST", {"start_line": "GET /api/data HTTP/1.1", "journal_level": "HEADERS"})]
            rows += [(req, base + 1 + i, "REQUEST_BODY", {"body": b"A" * 64}) for i in range(4)] + [(req, base + 9, "END", END | {"status": 201})]
    e = assemble.reassemble(events(spark, rows))
    assert e.count() == 400 and e.where("size(request_body) = 4 and status = 201").count() == 400


def plain_crc32c(raw):
    crc = 0xFFFFFFFF
    for byte in raw:
        crc ^= byte
        for _ in range(8):
            crc = crc >> 1 ^ (0x82F63B78 if crc & 1 else 0)
    return crc ^ 0xFFFFFFFF


def test_crc32c_of_parts(spark):
    """Sums of concatenations from the parts' sums, of any lengths, with nulls, against one pass over the whole."""
    g = random.Random(6)
    rows = [[], [b""], [b"12345", b"6789"], [b"1", b"", b"23456789"], [None, b"123456789"], None, [b"\0" * 700, b"\0"], [g.randbytes(5000), g.randbytes(1), g.randbytes(513)]]
    rows += [[g.randbytes(g.choice([0, 1, 15, 16, 17, 300])) for _ in range(g.randrange(6))] for _ in range(60)]
    df = spark.createDataFrame([(i, parts) for i, parts in enumerate(rows)], "i int, parts array<binary>").repartition(3)
    got = {r.i: r.c for r in df.select("i", C.crc32c_of_parts("parts").alias("c")).collect()}
    assert got == {i: None if parts is None else plain_crc32c(b"".join(x or b"" for x in parts)) for i, parts in enumerate(rows)}
    assert got[2] == got[3] == got[4] == 0xE3069283 and got[0] == 0
    whole = df.where("parts is not null").select("i", C.crc32c(assemble.joined("parts")).alias("c")).collect()
    assert {r.i: r.c for r in whole} == {i: c for i, c in got.items() if c is not None}
    assert df.where("i < 0").select(C.crc32c_of_parts("parts")).collect() == []


def test_crc32c(spark):
    got = spark.createDataFrame([(b"123456789",), (b"",), (None,)], "d binary").select(C.crc32c("d").alias("c")).collect()
    assert [r.c for r in got] == [0xE3069283, 0, None]


def test_columns(spark):
    df = spark.createDataFrame([("GET", 0), ("", 1), ("  ", 2), (None, 3), ("GET  /a", 4)], "line string, i int").orderBy("i")
    loose = [tuple(r.x) for r in df.select(X.split_start_line("line").alias("x")).collect()]
    assert loose == [("GET", None), (None, None), (None, None), (None, None), ("GET", "/a")]
    assert tuple(df.where("i = 4").select(X.split_start_line("line", True).alias("x")).first().x) == ("GET", "")
    one = spark.range(1)
    sizes = [one.select(X.human_bytes(F.lit(n).cast("bigint")).alias("x")).first().x for n in (0, 1023, 1024, -1)]
    assert sizes == ["0 B", "1023 B", "1.0 KB", "Unknown"]
    for text, want in (("5", None), ("5d", None), ("10ms", 10), ("2M", 120_000)):
        assert one.select(X.duration_ms(F.lit(text)).alias("x")).first().x == want
    for text, want in (("10MB", 10 << 20), ("10 MB", 10 << 20), ("x", None)):
        assert one.select(X.size_bytes(F.lit(text)).alias("x")).first().x == want


def test_addresses(spark):
    g = random.Random(2)
    ips = [str(ipaddress.ip_address(g.getrandbits(32))) for _ in range(50)] + [str(ipaddress.ip_address(g.getrandbits(128))) for _ in range(50)] + ["::1", "fe80::1", "::", "bad", None, "1.2.3", "2001:db8::ff"]
    nets = ["0.0.0.0/0", "10.0.0.0/8", "::/0", "2000::/3", "fe80::/10", "::1/128", "8000::/1", "128.0.0.0/1"]
    df = spark.createDataFrame([(i, ip) for i, ip in enumerate(ips)], "i int, client_ip string")
    got = df.select("i", *[P.remote_addr(n).alias(f"n{k}") for k, n in enumerate(nets)]).orderBy("i").collect()

    def inside(ip, net):
        try:
            a, n = ipaddress.ip_address(ip), ipaddress.ip_network(net)
        except ValueError:
            return False
        return a.version == n.version and a in n

    assert [[r[f"n{k}"] for k in range(len(nets))] for r in got] == [[inside(ip, n) for n in nets] for ip in ips]
    table = spark.createDataFrame([(n, n) for n in nets], "network_id string, cidr string")
    best = {r.i: r.network_id for r in joins.match_networks(df, table).collect()}
    for i, ip in enumerate(ips):
        hits = [n for n in nets if inside(ip, n)]
        assert best[i] == max(hits, key=lambda n: int(n.split("/")[1]), default=None)


def test_conditions_fail_early():
    for spec in ({"Nope": {}}, {"Method": {"inclde": ["GET"]}}, {"not": [{"Method": {}}]}, {"Method": "GET"}, "GET"):
        with pytest.raises(ValueError):
            P.condition(spec)
    with pytest.raises(ValueError):
        P.register_predicate("Method", P.method, ("include",))
    with pytest.raises(ValueError):
        R.register_filter("Cors", "client_request", lambda c, k: {})


def test_paths_and_headers(spark):
    one = spark.range(1)
    for path, parts, want in (("/v1", 1, "/"), ("/a/b/c", 2, "/c"), ("//x", 1, "/x"), ("/", 1, "/"), (None, 1, None)):
        assert one.select(R.strip_path_prefix(F.lit(path).cast("string"), parts).alias("x")).first().x == want
    got = one.select(R.template_redirect(F.lit("/a/1/b/2"), r"/([a-z])/(\d)", "/{{2}}{{1}}").alias("x")).first().x
    assert got.location == "/1a/b/2" and got.status == 302
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(v).alias("value")) for n, v in (("A", "1"), ("b", "2"), ("a", "3"))])
    shown = lambda c: [tuple(h) for h in one.select(c.alias("x")).first().x]
    assert shown(H.header_set(pairs, "a", "9")) == [("a", "9"), ("b", "2")]
    assert shown(H.header_remove(pairs, "A")) == [("b", "2")]
    assert one.select(H.pairs_to_map(pairs).alias("x")).first().x == {"A": ["1"], "b": ["2"], "a": ["3"]}
    assert shown(policy.redact_headers(pairs, F.lit("METADATA"), "request")) == []
    assert one.select(R.lacks_authorization(F.array(F.struct(F.lit("Authorization").alias("name"), F.lit("bearer x").alias("value")))).alias("x")).first().x


def brute_throttle(rows, a):
    state, out = {}, {}
    for route, key, at, i in sorted(rows, key=lambda r: (r[2], r[3])):
        s, ok, left, wait = a.take(state.get((route, key)), at)
        state[route, key] = s
        out[i] = (ok, left, wait)
    return out


def test_throttle(spark):
    a = tagging.Allowance(2, 1, 1_000_000_000, 5_000_000_000)
    assert a.take(None, 0) == ((1_000_000_000, 0), True, 1, 0)
    s = (0, 0)
    assert not a.take(s, 999_999_999)[1] and a.take(s, 1_000_000_000)[1]  # refill exactly at the boundary
    assert a.take((0, 0), 5_000_000_001)[0][0] == 1_000_000_000  # idle for longer than the TTL: full again
    g = random.Random(3)
    rows = [("r", f"k{g.randrange(3)}", g.randrange(10**10), i) for i in range(300)]
    got = tagging.throttle_tag(spark.createDataFrame(rows, "route_id string, client_ip string, client_start_ns bigint, event_id bigint"), a).collect()
    assert {r.id: (r.allowed, r.remaining, r.retry_after) for r in got} == brute_throttle(rows, a)


def test_outage(spark):
    # two failures open; a request during the cooldown is rejected; one probe; others wait for it
    rows = [(1, 0, 10, 500), (2, 20, 30, 502), (3, 40, 50, 200), (4, 140, 300, 500), (5, 150, 160, 200), (6, 420, 430, 200), (7, 440, 450, 200)]
    df = spark.createDataFrame([("r", *r) for r in rows], "route_id string, event_id bigint, client_start_ns bigint, client_end_ns bigint, status int")
    got = {r.id: (r.state, r.rejected) for r in tagging.outage_state(df, 2, 100).collect()}
    assert got == {1: ("CLOSED", False), 2: ("CLOSED", False), 3: ("OPEN", True), 4: ("HALF_OPEN", False), 5: ("HALF_OPEN", True), 6: ("HALF_OPEN", False), 7: ("CLOSED", False)}


def test_health_and_metrics_edges(spark):
    p = spark.createDataFrame([("a", i, ok) for i, ok in enumerate([False, True, False, False, True, True])], "target string, ts int, ok boolean").withColumn("event_id", F.col("ts"))
    assert [r.state for r in tagging.target_health(p).orderBy("ts").collect()] == ["UP", "UP", "UP", "DOWN", "DOWN", "UP"]
    assert [r.state for r in tagging.target_health(p, rise=1, fall=1).orderBy("ts").collect()] == ["DOWN", "UP", "DOWN", "DOWN", "UP", "UP"]
    x = spark.createDataFrame([("r", 5, 5), ("r", 1, 9), ("r", 9, 12)], "route_id string, client_start_ns bigint, client_end_ns bigint")
    assert tuple(metrics.concurrency(x, bucket_ns=4).first())[1:] == (1, 0)
    s = spark.createDataFrame([("r", v) for v in (0, 99, 600, 200, 200)], "route_id string, status int")
    assert metrics.status_histogram(s).first().statuses == {100: 2, 200: 2, 599: 1}
    old = spark.createDataFrame([("r", 2, [1, 2], [0, 0], [0, 0])], "route_id string, capacity int, success array<int>, client_error array<int>, server_error array<int>")
    new = spark.createDataFrame([("r", [7], [0], [0])], "route_id string, success array<int>, client_error array<int>, server_error array<int>")
    assert series.resume_sparkline(old, new, 2).first().success == [2, 7]
    assert series.resume_sparkline(old, new, 3).first().success == [0, 0, 7]


def test_snapshot_and_quarantine(spark, tmp_path):
    J.write_snapshot(spark.range(3), f"file://{tmp_path}/s")
    J.write_snapshot(spark.range(5), f"file://{tmp_path}/s")
    assert J.read_snapshot(spark, f"file://{tmp_path}/s").count() == 5
    (tmp_path / "e.json").write_text('{"req_id": "a", "seq": 1, "event_type": "END"}\nnot json\n')
    good, bad = J.quarantine(J.read_events(spark, f"file://{tmp_path}/e.json", "json").cache())
    assert good.count() == 1 and bad.count() == 1


def test_reused_ids_keep_their_own_route_and_health(spark):
    requests = spark.createDataFrame([("r1", "/a/x"), ("r1", "/b/y"), ("r1", None), ("r2", "/c")], "req_id string, path string")
    rules = spark.createDataFrame([(0, "A", "/a"), (1, "B", "/b"), (2, "AX", "/a/x")], "ordinal int, route_id string, prefix string")
    got = joins.match_prefixes(requests, rules)
    assert got.columns == ["req_id", "path", "route_id"]
    assert {(r.path, r.route_id) for r in got.collect()} == {("/a/x", "A"), ("/b/y", "B"), (None, None), ("/c", None)}
    assert joins.match_prefixes(requests, rules.where("ordinal < 0")).where("route_id is null").count() == 4
    times = spark.sql("select 'r1' as req_id, 'web' as route_id, timestamp'2024-01-01 00:00:01' as ts union all select 'r1', 'web', timestamp'2024-01-01 00:00:01' union all select 'r1', 'web', timestamp'2024-01-01 02:00:00' union all select 'r1', null, null")
    up = spark.sql("select 'web' as route_id, 't' as target, 'UP' as state, timestamp'2024-01-01 00:00:00' as from_ts, timestamp'2024-01-01 01:00:00' as to_ts")
    assert sorted((str(r.ts), r.healthy) for r in joins.availability_join(times, up).collect()) == [("2024-01-01 00:00:01", 1)] * 2 + [("2024-01-01 02:00:00", 0), ("None", 0)]


def test_template_redirect_takes_java_patterns(spark):
    def moved(path, source, target):
        return spark.createDataFrame([(path,)], "p string").select(R.template_redirect("p", source, target)["location"].alias("x")).first().x

    assert moved("/old/item/7", r"/old/(?<kind>\p{Alpha}+)/(\d+)", "/new/{{2}}/{{kind}}") == "/new/7/item"
    assert moved("/x/aa/b", r"(\w)\1", "<{{1}}>") == "/x/<a>/b"  # a back reference
    assert moved("/a\n/b", "/.", "!") == "!\n/b" and moved("\na.b", ".b", "_") == "\na_"  # a dot takes no line break
    assert moved("\nb", ".b", "_") is None and moved("/a(b", r"\Q(b\E", "{{0}}") == "/a(b"
    assert moved("/n/a", r"[(]|/(?:n)/(?=a)", "/m/") == "/m/a"


def test_snapshots_are_numbered(spark, tmp_path):
    path = f"file://{tmp_path}/snapshot"
    with pytest.raises(ValueError):
        J.read_snapshot(spark, path)
    for n in range(12):  # within one second of a coarse clock
        J.write_snapshot(spark.range(n), path)
        assert J.read_snapshot(spark, path).count() == n


def test_no_scratch_folder_of_its_own_on_a_cluster():
    from types import SimpleNamespace as Made

    from trafficloom.sources.scratch import scratch

    unset = Made(get=lambda *a: None)
    jsc = Made(sc=lambda: Made(getCheckpointDir=lambda: Made(isDefined=lambda: False)))
    for master in ("spark://host:7077", "local-cluster[2,1,1024]", "yarn"):
        with pytest.raises(ValueError):
            scratch(Made(conf=unset, sparkContext=Made(master=master, getConf=lambda: unset, _jsc=jsc)), "x")


def test_tail_resumes_and_archives(spark, tmp_path):
    """A second run on the same checkpoint reads the new files alone; files read whole are archived."""
    path, out, state = (f"file://{tmp_path}/{n}" for n in ("journal", "out", "state"))

    def tail():
        tailed = S.tail_events(spark, path, max_files=1, clean="archive", archive=f"file://{tmp_path}/archive")
        S.poll(tailed.select("req_id", "seq").writeStream.option("path", out), state, None).awaitTermination()
        return sorted((r.req_id, r.seq) for r in spark.read.parquet(out).collect())

    def write(*ids):
        at = {"shard": 0, "event_time": datetime.datetime(2024, 1, 1)}
        for i in ids:
            J.write_events(events(spark, [(i, n, "REQUEST_BODY", at) for n in range(3)]), path, mode="append")

    write("a", "b")
    first = tail()
    assert first == [(i, n) for i in "ab" for n in range(3)]
    assert tail() == first  # nothing new
    write("c", "d")
    assert tail() == [(i, n) for i in "abcd" for n in range(3)]
    assert list((tmp_path / "archive").rglob("*.parquet"))


def test_reassembly_without_slices(spark):
    """Leaving slices and bodies out changes nothing of what is left."""
    rows = [
        ("a", 1, "CLIENT_REQUEST", {"start_line": "A", "client_ip": "1.1.1.1"}), ("a", 2, "REQUEST_BODY", {"body": b"x"}), ("a", 3, "CLIENT_RESPONSE", {"status": 200}), ("a", 4, "END", END),
        ("a", 5, "CLIENT_REQUEST", {"start_line": "B"}), ("a", 6, "END", END | {"status": 404}), ("b", 1, "UPSTREAM_REQUEST", {}), ("b", 2, "END", END),
    ]
    whole, slim = assemble.reassemble(events(spark, rows)), assemble.reassemble(events(spark, rows), bodies=False, slices=())
    assert set(whole.columns) - set(slim.columns) == {k.lower() for k in assemble.SLICES} | {"request_body", "response_body"}
    assert sorted(map(str, slim.collect())) == sorted(map(str, whole.select(slim.columns).collect())) and slim.count() == 2
    with pytest.raises(ValueError):
        assemble.reassemble(events(spark, rows), slices=("END",))


def test_ip_sources_read_ends_and_client_requests_alone(spark, sf_dir, monkeypatch):
    from trafficloom.plans import exchange_queries as Q

    asked, real = [], assemble.reassemble
    monkeypatch.setattr(Q.assemble, "reassemble", lambda *a, **how: asked.append(how) or real(*a, **how))
    found = {r.client_ip_source: r.n for r in Q.f13_ip_source_counts(spark, sf_dir).collect()}
    assert asked == [{"bodies": False, "slices": ()}]
    assert found == {r.client_ip_source: r["count"] for r in real(Q.journal(spark, sf_dir)).groupBy("client_ip_source").count().collect()}


def test_addresses_of_users_beyond_two_bytes_are_malformed(spark):
    """The traffic view's addresses are well-formed below user 65,536; others fall through and lie in no network."""
    rows = spark.createDataFrame([(u, f"10.{u % 4}.{u // 256}.{u % 256}") for u in (0, 65_535, 65_536, 89_999)], "u int, client_ip string")
    forwarded = F.array(F.struct(F.lit("X-Forwarded-For").alias("name"), F.col("client_ip").alias("value")))
    got = rows.select("u", P.remote_addr("10.0.0.0/8").alias("hit"), H.client_ip(forwarded, F.lit("192.0.2.7"))["source"].alias("source")).collect()
    assert [(r.hit, r.source) for r in got] == [(True, "X_FORWARDED_FOR")] * 2 + [(False, "SOCKET")] * 2


def test_headers_of_distinct_and_repeated_names_as_maps(spark):
    pairs = "array<struct<name: string, value: string>>"
    rows = [(0, [("A", "1"), ("a", "2")]), (1, [("B", "1"), ("A", "2"), ("B", None), ("C", "4")]), (2, []), (3, None)]
    found = spark.createDataFrame(rows, f"id int, h {pairs}").select("id", H.pairs_to_map("h").alias("m")).collect()
    assert {r.id: r.m for r in found} == {0: {"A": ["1"], "a": ["2"]}, 1: {"B": ["1", None], "A": ["2"], "C": ["4"]}, 2: {}, 3: {}}
