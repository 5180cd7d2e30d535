"""Reassembly batch by batch: what the stateful processor gives, event by event."""

import datetime
import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests.test_operators import END, events
from tests.test_streaming import at, places  # noqa: F401  (a fixture)
from trafficloom.operators import assemble
from trafficloom.schema import EVENT_SCHEMA
from trafficloom.streaming import batches as BT
from trafficloom.streaming import carried as CR
from trafficloom.streaming import reassembly as RS

MINUTE = 60_000


def deliver(spark, path, rows):
    events(spark, rows).coalesce(1).write.mode("append").parquet(path)


def run(spark, path, out, state, **how):
    CR.reassemble_batches(spark.readStream.schema(EVENT_SCHEMA).parquet(path), out, state, **how).awaitTermination()


class Value:
    def __init__(self):
        self.held = None

    def get(self):
        return self.held

    def update(self, x):
        self.held = x

    def clear(self):
        self.held = None

    def appendList(self, xs):  # noqa: N802
        self.held = [*(self.held or []), *xs]


class Handle:
    def __init__(self):
        self.timers = set()

    def getValueState(self, *_):  # noqa: N802
        return Value()

    getListState = getValueState  # noqa: N815

    def registerTimer(self, ms):  # noqa: N802
        self.timers.add(ms)

    def deleteTimer(self, ms):  # noqa: N802
        self.timers.discard(ms)


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.ms


def by_hand(deliveries, limit_ms, delay_ms, bodies):
    """Each id by the stateful processor, with a state that is a dict."""
    held, newest, made = {}, None, []
    for rows in deliveries:
        late = None if newest is None else newest - delay_ms
        groups = {}
        for key, seq, kind, more in rows:
            moment = more["event_time"]
            ms = round((moment.replace(tzinfo=datetime.timezone.utc) - RS.EPOCH).total_seconds() * 1000)
            if late is None or ms >= late:
                text = json.dumps({"line": more.get("start_line"), "status": more.get("status")})
                groups.setdefault(key, []).append((key, seq, RS.CODES.get(kind, RS.END + 1), moment.replace(tzinfo=datetime.timezone.utc), text, more.get("body")))
            newest = ms if newest is None else max(newest, ms)
        for key, group in groups.items():
            if key not in held:
                held[key] = RS.ExchangeProcessor(limit_ms, bodies)
                held[key].init(Handle())
            made += held[key].handleInputRows((key,), iter(group), Clock(max(0, late or 0)))
        for key, processor in held.items():
            for ms in [t for t in processor.handle.timers if t < newest - delay_ms]:
                processor.handle.deleteTimer(ms)
                made += processor.handleExpiredTimer((key,), Clock(newest - delay_ms), None)
    return made


@pytest.mark.parametrize("bodies", [True, False])
def test_batches_give_what_the_processor_gives(spark, places, bodies):  # noqa: F811
    path, out, state = places
    g, kinds = random.Random(5), [*assemble.SLICES, "REQUEST_BODY", "REQUEST_BODY", "RESPONSE_BODY", "END", "STRANGE"]
    deliveries = []
    for k in range(4):
        seqs = g.sample(range(1000), 60)
        times = sorted(g.uniform(k * 6, k * 6 + 8) for _ in seqs)
        when = dict(zip(sorted(seqs), times))
        rows = [(f"id{g.randrange(9 + 6 * k)}", n, g.choice(kinds), at(when[n])) for n in seqs]
        deliveries.append([(i, n, kind, more | ({"body": b"%d" % n} if kind.endswith("BODY") else {"start_line": f"L{n}", "status": g.choice([0, 200])})) for i, n, kind, more in rows])
    for rows in deliveries:
        deliver(spark, path, rows)
        run(spark, path, out, state, timeout="5 minutes", watermark="2 minutes", bodies=bodies)
    want = []
    for r in by_hand(deliveries, 5 * MINUTE, 2 * MINUTE, bodies):
        lines = [json.loads(x)["line"] if x else None for x in (r.client_request, r.upstream_request, r.upstream_response, r.client_response)]
        status = json.loads(r.ended)["status"] if r.ended else None
        outcome = "NO_STATUS" if r.outcome == "COMPLETE" and status <= 0 else r.outcome
        want.append((r.req_id, r.generation, outcome, status, *lines, r.request_body, r.response_body, r.request_fragments, r.response_fragments))
    rows = CR.exchanges_in(spark, out, bodies)
    assert rows.drop("batch").columns == spark.createDataFrame([], RS.EXCHANGE_ROW).columns
    got = rows.select("req_id", "generation", "outcome", "status", *[f"{k.lower()}.start_line" for k in assemble.SLICES], "request_body", "response_body", "request_fragments", "response_fragments")
    plain = lambda r: tuple([bytes(y) for y in x] if isinstance(x, list) else x for x in r)
    assert sorted(map(str, map(plain, got.collect()))) == sorted(map(str, want))
    assert {w[2] for w in want} == {"COMPLETE", "NO_STATUS", "NO_CLIENT_REQUEST", "ORPHAN_END", "IN_FLIGHT"} and {w[1] for w in want} > {0, 1}


def test_cut_exchanges_have_every_column(spark, places):  # noqa: F811
    path, out, state = places
    rows = [
        ("a", 1, "CLIENT_REQUEST", at(0, start_line="GET /a", client_ip="1.1.1.1", client_ip_source="SOCKET", headers=[("Host", "a"), ("Accept", None)], journal_level="FULL")),
        ("a", 2, "REQUEST_BODY", at(0, body=b"\xff")), ("a", 3, "UPSTREAM_RESPONSE", at(0, status=200, headers=[])), ("a", 4, "RESPONSE_BODY", at(1, body=b"ok")),
        ("a", 5, "END", at(1) | END | {"attributes": [("gateway.route.id", "r")]}), ("b", 1, "CLIENT_REQUEST", at(1, start_line="B")), ("b", 2, "END", at(1) | END),
    ]
    for part in (rows[:2], rows[2:3], [], rows[3:]):
        if part:
            deliver(spark, path, part)
        run(spark, path, out, state)
    whole, found = assemble.reassemble(events(spark, rows)), CR.exchanges_in(spark, out)
    assert sorted(map(str, found.select(whole.columns).collect())) == sorted(map(str, whole.collect())) and whole.count() == 2
    assert {(r.req_id, r.route_id, r.start_line, r.batch) for r in found.collect()} == {("a", "r", "GET /a", 2), ("b", None, "B", 2)}
    kept = {x.parent.name for x in Path(out.removeprefix("file://")).glob("rows/*/outcome=OPEN")}
    assert kept <= {"batch=1", "batch=2"}


def test_batches_replay(spark, places, monkeypatch):  # noqa: F811
    """A crash before a batch's mark: it comes again, is written once, and finds what was held before it."""
    path, out, state = places
    deliver(spark, path, [("a", 1, "CLIENT_REQUEST", at(0)), ("b", 1, "CLIENT_REQUEST", at(0)), ("c", 1, "END", at(0) | END)])
    run(spark, path, out, state)
    deliver(spark, path, [("a", 2, "END", at(0.5) | END), ("d", 1, "REQUEST_BODY", at(30, body=b"x"))])
    real, told = BT.write_batch, []

    def failing(df, where, batch, partition_by=()):
        if where.endswith("/marks"):
            raise RuntimeError("lost")
        real(df, where, batch, partition_by)

    then = lambda df, n: told.append((n, sorted((r.req_id, r.outcome) for r in df.collect())))
    monkeypatch.setattr(CR, "write_batch", failing)
    with pytest.raises(Exception, match="lost"):
        run(spark, path, out, state, then=then)
    monkeypatch.setattr(CR, "write_batch", real)
    run(spark, path, out, state, then=then)
    ended = [("a", "COMPLETE"), ("b", "IN_FLIGHT")]
    assert sorted((r.req_id, r.outcome) for r in CR.exchanges_in(spark, out).collect()) == [*ended, ("c", "ORPHAN_END")]
    assert told == [(1, ended)] * len(told) and told
    assert CR.exchanges_in(spark, out).where(F.col("batch") == 1).count() == 2
