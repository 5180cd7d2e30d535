"""Streams that are cut, replayed, late or read twice."""

import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests.test_operators import END, events
from trafficloom.operators import assemble
from trafficloom.sources import journal as J
from trafficloom.streaming import batches as BT
from trafficloom.streaming import exchanges as S
from trafficloom.streaming import reassembly as RS
from trafficloom.schema import EVENT_SCHEMA

NOON = datetime.datetime(2024, 1, 1, 12)


def at(minutes, **more):
    return {"event_time": NOON + datetime.timedelta(minutes=minutes), "shard": 0} | more


def deliver(spark, path, rows):
    J.write_events(events(spark, rows), path, mode="append")


@pytest.fixture
def places(tmp_path):
    return [f"file://{tmp_path}/{n}" for n in ("journal", "out", "state")]


def test_exchange_cut_over_deliveries(spark, places):
    """State of three runs gives what one batch gives; what stays open ends with what it has."""
    path, out, state = places
    headers = [("Host", "a"), ("Accept", "x")]
    a = [
        ("a", 1, "CLIENT_REQUEST", at(0, start_line="GET /a", client_ip="1.1.1.1", client_ip_source="SOCKET", headers=headers, journal_level="FULL")),
        ("a", 2, "REQUEST_BODY", at(0, body=b"one")), ("a", 3, "UPSTREAM_REQUEST", at(0, start_line="GET /u", headers=[])), ("a", 4, "REQUEST_BODY", at(0, body=b"two")),
        ("a", 5, "UPSTREAM_RESPONSE", at(1, status=200, start_line="HTTP/1.1 200")), ("a", 6, "RESPONSE_BODY", at(1, body=b"ok")), ("a", 7, "CLIENT_RESPONSE", at(1, status=201, headers=headers)),
        ("a", 8, "END", at(1) | END | {"attributes": [("gateway.route.id", "r"), ("x", "y")]}),
        ("a", 9, "CLIENT_REQUEST", at(2, start_line="again")), ("a", 10, "END", at(2) | END | {"status": 404}),
    ]
    others = [("open", 1, "CLIENT_REQUEST", at(0, start_line="O", headers=headers)), ("open", 2, "REQUEST_BODY", at(0, body=b"part")), ("orphan", 1, "REQUEST_BODY", at(0, body=b"lost")), ("orphan", 2, "END", at(0) | END)]
    end = [("later", 1, "CLIENT_REQUEST", at(60)), ("later", 2, "END", at(60) | END)]
    for rows in (a[:2] + others[:1], a[2:6] + others[1:], a[6:] + end):
        deliver(spark, path, rows)
        S.poll(RS.reassemble_stream(S.tail_events(spark, path)).writeStream.option("path", out), state, None).awaitTermination()
    found = spark.read.schema(RS.EXCHANGE_ROW).parquet(out)
    whole = assemble.reassemble(events(spark, a + others + end))
    same = found.where("outcome = 'COMPLETE'").select(whole.columns)
    assert sorted(map(str, same.collect())) == sorted(map(str, whole.collect())) and whole.count() == 3
    rest = {r.req_id: r for r in found.where("outcome <> 'COMPLETE'").collect()}
    assert {k: r.outcome for k, r in rest.items()} == {"open": "IN_FLIGHT", "orphan": "ORPHAN_END"}
    assert rest["open"].client_request.headers[0].value == "a" and rest["open"].request_body == [b"part"] and rest["open"].request_fragments == 1
    assert rest["orphan"].request_body == []


def test_bodies_can_stay_out_of_the_state(spark, places):
    path, out, state = places
    deliver(spark, path, [("a", 1, "CLIENT_REQUEST", at(0)), ("a", 2, "REQUEST_BODY", at(0, body=b"one")), ("a", 3, "END", at(0) | END)])
    S.poll(RS.reassemble_stream(S.tail_events(spark, path), bodies=False).writeStream.option("path", out), state, None).awaitTermination()
    row = spark.read.schema(RS.EXCHANGE_ROW).parquet(out).first()
    assert (row.outcome, row.request_body, row.request_fragments) == ("COMPLETE", None, 1)


def test_replayed_batch_is_written_once(spark, places, monkeypatch):
    """A crash between the two writes of a batch: the replay doubles and loses nothing."""
    path, out, state = places
    rows = [("a", 1, "CLIENT_REQUEST", at(0)), ("a", 2, "END", at(0) | END), ("b", 1, "CLIENT_REQUEST", at(0)), ("b", 2, "END", at(0) | END), ("c", 1, "END", at(0) | END), ("d", 1, "CLIENT_REQUEST", at(0)), ("d", 2, "END", at(0) | END | {"status": 0})]
    deliver(spark, path, rows)
    written, real = [], BT.write_batch

    def failing(df, where, batch, partition_by=()):
        written.append(where.rsplit("/", 1)[1])
        if len(written) == 2:
            raise RuntimeError("lost between the writes")
        real(df, where, batch, partition_by)

    monkeypatch.setattr(BT, "write_batch", failing)
    run = lambda: BT.split_outcomes(RS.reassemble_stream(S.tail_events(spark, path)), out, state).awaitTermination()
    with pytest.raises(Exception, match="lost between the writes"):
        run()
    assert BT.read_batches(spark, f"{out}/anomalies", RS.EXCHANGE_ROW).count() == 0
    run()
    assert written[:2] == ["exchanges", "anomalies"] and written.count("exchanges") >= 2
    assert sorted(r.req_id for r in BT.read_batches(spark, f"{out}/exchanges", RS.EXCHANGE_ROW).collect()) == ["a", "b"]
    assert sorted(r.outcome for r in BT.read_batches(spark, f"{out}/anomalies", RS.EXCHANGE_ROW).collect()) == ["NO_STATUS", "ORPHAN_END"]


def test_late_rows_are_kept_apart(spark, places):
    path, out, state = places
    minute = 60_000
    deliveries = [
        [("a", 1, "CLIENT_REQUEST", at(0)), ("b", 1, "CLIENT_REQUEST", at(30)), ("old", 1, "END", at(-600))],  # no watermark yet
        [("a", 2, "END", at(9) | END), ("b", 2, "END", at(10) | END), ("c", 1, "REQUEST_BODY", at(10, body=b"x")), ("d", 1, "CLIENT_REQUEST", at(20, shard=None) | {"event_time": None})],
        [("e", 1, "REQUEST_BODY", at(9.5)), ("e", 2, "CLIENT_REQUEST", at(9.9)), ("e", 3, "END", at(100) | END)],  # the mark never falls
        [("f", 1, "END", at(79) | END), ("f", 2, "END", at(80) | END)],
    ]
    for rows in deliveries:
        df = events(spark, rows)
        df.write.mode("append").parquet(path)
        stream = spark.readStream.schema(EVENT_SCHEMA).parquet(path)
        BT.late_gate(stream, out, state, 20 * minute).awaitTermination()
    rows = BT.gated(spark, out, EVENT_SCHEMA).collect()
    assert len(rows) == sum(map(len, deliveries))
    late = sorted((r.batch, r.req_id, r.seq) for r in rows if r.late)
    assert late == [(1, "a", 2), (2, "e", 1), (2, "e", 2), (3, "f", 1)]
    named = {(r.req_id, r.seq): r.anomaly for r in BT.late_anomalies(BT.gated(spark, out, EVENT_SCHEMA).where("late")).collect()}
    assert named == {("a", 2): "LATE_END", ("e", 1): "LATE_BODY", ("e", 2): "LATE_SLICE", ("f", 1): "LATE_END"}
    on_time = BT.on_time_stream(spark, out, EVENT_SCHEMA)
    S.poll(on_time.select("req_id", "seq").writeStream.option("path", f"{out}-on"), f"{state}-on", None).awaitTermination()
    assert spark.read.parquet(f"{out}-on").count() == len(rows) - len(late)


def test_gate_replays_a_batch(spark, places, monkeypatch):
    """A crash before the mark is written: the batch comes again, the mark before it still holds."""
    path, out, state = places
    events(spark, [("a", 1, "END", at(100) | END)]).write.parquet(path)
    gate = lambda: BT.late_gate(spark.readStream.schema(EVENT_SCHEMA).parquet(path), out, state, 0).awaitTermination()
    gate()
    events(spark, [("b", 1, "END", at(99) | END), ("b", 2, "END", at(300) | END)]).write.mode("append").parquet(path)
    real = BT.write_batch

    def failing(df, where, batch, partition_by=()):
        if where.endswith("/marks"):
            raise RuntimeError("lost")
        real(df, where, batch, partition_by)

    monkeypatch.setattr(BT, "write_batch", failing)
    with pytest.raises(Exception, match="lost"):
        gate()
    monkeypatch.setattr(BT, "write_batch", real)
    gate()
    assert sorted((r.req_id, r.seq, r.late) for r in BT.gated(spark, out, EVENT_SCHEMA).collect()) == [("a", 1, False), ("b", 1, True), ("b", 2, False)]


def test_events_read_again_stay_once(spark, places):
    path, out, state = places
    first = [("a", n, "REQUEST_BODY", at(n)) for n in range(6)]
    again = [*first[3:], ("a", 6, "REQUEST_BODY", at(6)), ("b", 3, "REQUEST_BODY", at(6))]
    for rows in (first, [*again, *again]):
        deliver(spark, path, rows)
        S.poll(BT.dedupe_stream(S.tail_events(spark, path), "4 minutes").select("req_id", "seq").writeStream.option("path", out), state, None).awaitTermination()
    assert sorted((r.req_id, r.seq) for r in spark.read.parquet(out).collect()) == [("a", n) for n in range(7)] + [("b", 3)]


def ids(df):
    return sorted((r.req_id, r.seq) for r in df.collect())


@pytest.mark.parametrize("most", [1_000, 0])
def test_segments_read_again_stay_once(spark, places, monkeypatch, most):
    """No id is held in a state; segments without copies are not written again (K4). Too many with copies: all are compared."""
    monkeypatch.setattr(BT, "MOST_FILES", most)
    path, out, state = places
    minute = 60_000
    first = [("a", n, "REQUEST_BODY", at(n, shard=n % 2, body=b"x", headers=[("H", "v")])) for n in range(6)]
    again = [*first[3:], ("a", 6, "REQUEST_BODY", at(6)), ("b", 3, "REQUEST_BODY", at(6))]
    timeless = ("t", 1, "REQUEST_BODY", at(0) | {"event_time": None})
    deliveries = [
        [first], [again, again, again], [[("late", 1, "REQUEST_BODY", at(1)), ("c", 1, "REQUEST_BODY", at(9, body=b"y"))], [("d", 1, "REQUEST_BODY", at(60)), timeless]],
        [[timeless, ("d", 1, "REQUEST_BODY", at(60)), ("a", 6, "REQUEST_BODY", at(6))], [("e", 1, "REQUEST_BODY", at(60))]],
    ]
    for parts in deliveries:
        for rows in parts:
            deliver(spark, path, rows) if rows[0] is not timeless and rows[-1] is not timeless else events(spark, rows).write.mode("append").parquet(f"{path}/shard=7/date=2024-01-01")
        BT.dedupe_segments(spark, path, out, state, 4 * minute).awaitTermination()
    found = BT.deduped(spark, path, out)
    assert ids(found) == [("a", n) for n in range(7)] + [("b", 3), ("c", 1), ("d", 1), ("e", 1), ("t", 1)]
    kept = {r.seq: r for r in found.where("req_id = 'a' and seq < 6").collect()}
    assert all((r.shard, r.body, r.headers[0].value) == (n % 2, b"x", "v") for n, r in kept.items()) and len(kept) == 6
    written = BT.read_batches(spark, f"{out}/events", EVENT_SCHEMA)
    if most:
        assert written.where("batch = 0").count() == 0 and ids(written.where("batch = 2")) == [("c", 1)]
    assert not (Path(state.removeprefix("file://")) / "state").exists()
    remembered = {x.name for x in (Path(out.removeprefix("file://")) / "ids").iterdir()}
    assert remembered == {"batch=2", "batch=3"} and ("a", 6) not in ids(spark.read.parquet(f"{out}/ids/batch=3"))


def test_segments_replay_a_batch(spark, places, monkeypatch):
    path, out, state = places
    run = lambda: BT.dedupe_segments(spark, path, out, state, 60_000).awaitTermination()
    deliver(spark, path, [("a", 1, "END", at(0)), ("a", 2, "END", at(0))])
    run()
    deliver(spark, path, [("a", 2, "END", at(0)), ("b", 1, "END", at(1))])
    real = BT.write_batch

    def failing(df, where, batch, partition_by=()):
        if where.endswith("/marks"):
            raise RuntimeError("lost")
        real(df, where, batch, partition_by)

    monkeypatch.setattr(BT, "write_batch", failing)
    with pytest.raises(Exception, match="lost"):
        run()
    monkeypatch.setattr(BT, "write_batch", real)
    run()
    assert ids(BT.deduped(spark, path, out)) == [("a", 1), ("a", 2), ("b", 1)]


def test_slices_without_headers(spark):
    rows = [("a", 1, "CLIENT_REQUEST", at(0, start_line="GET /", headers=[("X", "y")])), ("a", 2, "CLIENT_RESPONSE", at(0, status=201)), ("a", 3, "END", at(0) | END)]
    whole, bare = (assemble.reassemble(events(spark, rows), headers=h).first().asDict(recursive=True) for h in (True, False))
    for part in ("client_request", "client_response"):
        del whole[part]["headers"]
    assert bare == whole


def test_snapshots_keep_few_versions(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    for n in range(30):
        assert J.write_snapshot(spark.range(n, n + 1).coalesce(1), path, keep=3) == n + 1
    assert J.read_snapshot(spark, path).first().id == 29
    assert [x.name for x in sorted((tmp_path / "s/versions").iterdir())] == [f"{n:012d}" for n in (28, 29, 30)]
    assert len([x for x in (tmp_path / "s/pointer").iterdir() if not x.name.startswith(".")]) == 3
    spark.range(5).write.parquet(f"{path}/versions/{31:012d}")  # a writer that crashed before its pointer
    assert J.read_snapshot(spark, path).first().id == 29
    assert J.write_snapshot(spark.range(7), path, keep=3) == 32 and J.read_snapshot(spark, path).count() == 7


def test_snapshot_of_an_empty_stream_batch(spark, tmp_path):
    J.write_snapshot(spark.range(0).withColumn("x", F.lit("a")), f"file://{tmp_path}/e")
    assert J.read_snapshot(spark, f"file://{tmp_path}/e").columns == ["id", "x"]


def test_python_sees_six_values_of_an_event(spark, places):
    """Headers and times pass the stateful processor as one text; what an odd slice says comes back whole."""
    path, out, state = places
    rows = [("a", 1, "CLIENT_REQUEST", at(0, start_line='GET /"\\\né', headers=[("X", None), ("Y", "")])), ("a", 2, "CLIENT_RESPONSE", at(0)), ("a", 3, "END", at(0) | END | {"attributes": []}), ("b", 1, "STRANGE", at(0)), ("b", 2, "REQUEST_BODY", at(0, body=b"\xff")), ("b", 3, "END", at(0) | END)]
    assert RS._packed(events(spark, rows), True).columns == ["req_id", "seq", "code", "event_time", "text", "body"]
    deliver(spark, path, rows)
    S.poll(RS.reassemble_stream(S.tail_events(spark, path)).writeStream.option("path", out), state, None).awaitTermination()
    found = spark.read.schema(RS.EXCHANGE_ROW).parquet(out)
    whole = assemble.reassemble(events(spark, rows))
    assert found.where("outcome = 'COMPLETE'").select(whole.columns).collect() == whole.collect() != []
    odd = found.where("req_id = 'b'").first()
    assert (odd.outcome, odd.request_body) == ("NO_CLIENT_REQUEST", [b"\xff"])
