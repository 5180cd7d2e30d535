"""Segments that grow between runs: each whole line once."""

import json
import random

from trafficloom.sources import growing
from trafficloom.streaming import exchanges as S


def test_lines_appended_between_runs(spark, tmp_path):
    folder, out, state = tmp_path / "segments", f"file://{tmp_path}/out", f"file://{tmp_path}/state"
    folder.mkdir()
    g, want = random.Random(3), {}

    def append(name, lines, end=True):
        with open(folder / name, "ab") as file:
            for n, line in enumerate(lines):
                want.setdefault(name, []).append(line)
                file.write(line.encode() + (b"\n" if end or n + 1 < len(lines) else b""))

    def run():
        lines = growing.tail_lines(spark, f"file://{folder}", range_bytes=64)
        S.poll(lines.writeStream.option("path", out), state, None).awaitTermination()
        found = spark.read.schema("segment string, position bigint, line string").parquet(out).collect()
        return {n: [(r.position, r.line) for r in sorted(found, key=lambda r: r.position) if r.segment == n] for n in {r.segment for r in found}}

    def placed():
        made = {}
        for name, lines in want.items():
            at, made[name] = 0, []
            for line in lines:
                made[name].append((at, line))
                at += len(line.encode()) + 1
        return made

    append("a.jsonl", [g.choice(["x", "é" * 40, "", "y" * 200]) for _ in range(30)])
    append("b.jsonl", ["one", "two"])
    (folder / "c.txt").write_text("of another kind\n")
    assert run() == placed()
    append("a.jsonl", ["z" * 63, "", "tail without an end"], end=False)
    append("d.jsonl", ["new"])
    whole = placed()
    whole["a.jsonl"].pop()
    assert run() == whole
    assert run() == whole  # nothing new
    with open(folder / "a.jsonl", "ab") as file:
        file.write(b", ended\n")
    want["a.jsonl"][-1] += ", ended"
    (folder / "b.jsonl").unlink()  # read, and removed
    assert run() == placed()


def test_events_of_growing_segments(spark, tmp_path):
    folder = tmp_path / "segments"
    folder.mkdir()
    for part in range(2):
        with open(folder / "shard-0.jsonl", "a") as file:
            for n in range(3):
                file.write(json.dumps({"req_id": f"r{part}", "seq": n, "event_type": "END", "status": 200, "headers": [{"name": "Host", "value": "h"}]}) + "\n")
            file.write("broken\n" if part else "")
        rows = growing.tail_growing_events(spark, str(folder))
        S.poll(rows.select("req_id", "seq", "headers", "_bad").writeStream.option("path", f"file://{tmp_path}/out"), f"file://{tmp_path}/state", None).awaitTermination()
    found = spark.read.parquet(f"file://{tmp_path}/out").collect()
    assert sorted((r.req_id, r.seq) for r in found if r._bad is None) == [(f"r{p}", n) for p in range(2) for n in range(3)]
    assert [r._bad for r in found if r._bad] == ["broken"] and found[0].headers[0].name == "Host"


def test_ranges_cover_every_line_once(tmp_path):
    g = random.Random(4)
    for _ in range(60):
        lines = [b"x" * g.choice([0, 0, 1, 5, 40]) for _ in range(g.randrange(1, 30))]
        data = b"".join(x + b"\n" for x in lines) + g.choice([b"", b"open"])
        (tmp_path / "s.jsonl").write_bytes(data)
        reader = growing.SegmentReader({"path": str(tmp_path), "rangeBytes": str(g.randrange(1, 50))})
        end = reader.latestOffset()
        assert end == {"s.jsonl": len(b"".join(x + b"\n" for x in lines))}
        cut = {"s.jsonl": sum(len(x) + 1 for x in lines[: g.randrange(len(lines))])}
        for a, b, own in (({}, end, lines), (cut, end, None), ({}, cut, None)):
            got = [row[2] for part in reader.partitions(a, b) for row in reader.read(part)]
            text = data[a.get("s.jsonl", 0) : b["s.jsonl"]].decode()
            assert got == text.split("\n")[:-1] and (own is None or len(got) == len(own))


def test_lines_come_in_batches(tmp_path, monkeypatch):
    """Spark gets whole record batches; lines longer than what is read together, and bytes that aren't UTF-8, come as before."""
    monkeypatch.setattr(growing, "PIECE", 7)
    lines = [b"a", b"", b"long" * 20, b"\xff", "é".encode() * 9, b"z"]
    (tmp_path / "s.jsonl").write_bytes(b"\n".join(lines) + b"\n")
    for size in (1, 13, 1000):
        reader = growing.GrowingSegments({"path": str(tmp_path), "rangeBytes": str(size)}).streamReader(None)
        batches = [b for part in reader.partitions({}, reader.latestOffset()) for b in reader.read(part)]
        assert [x for b in batches for x in b.column(2).to_pylist()] == [x.decode("utf-8", "replace") for x in lines]
        assert [x for b in batches for x in b.column(1).to_pylist()] == [sum(len(y) + 1 for y in lines[:k]) for k in range(len(lines))]


def test_more_ranges_than_tasks_become_longer(tmp_path):
    lines = [b"x" * (n % 7) for n in range(400)]
    for name, part in (("a", lines[:300]), ("b", lines[300:])):
        (tmp_path / f"{name}.jsonl").write_bytes(b"".join(x + b"\n" for x in part))
    for ranges, most in ((0, 2000), (5, 7), (1, 2)):
        reader = growing.SegmentReader({"path": str(tmp_path), "rangeBytes": "1", "ranges": str(ranges)})
        parts = reader.partitions({"a.jsonl": 0}, reader.latestOffset())
        assert (len(parts) > 1000) == (not ranges) and len(parts) <= most
        assert [r[2].encode() for part in parts for r in reader.read(part)] == lines


def test_lines_are_parsed_once(spark):
    lines = spark.createDataFrame([("a", 0, '{"seq": 1}'), ("a", 11, "broken")], "segment string, position bigint, line string")
    rows = growing._events(lines).where("_bad is null").select("seq", "headers", "body")
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
    assert [tuple(r) for r in rows.collect()] == [(1, None, None)]


def test_read_segments_leave_the_disk(spark, sf_dir, monkeypatch):
    """More deliveries, the same rows; the folder never holds more than one of them."""
    from trafficloom.plans import exchange_queries as Q

    whole = sorted(map(tuple, Q.a02_growing_segments(spark, sf_dir).collect()))
    held, real = [], S.poll

    def polled(writer, state, every):
        held.append(spark.read.text(paths[0]).count())
        return real(writer, state, every)

    paths, made = [], Q.scratch
    monkeypatch.setattr(Q, "scratch", lambda s, name: paths.append(made(s, name)) or paths[-1])
    monkeypatch.setattr(S, "poll", polled)
    monkeypatch.setattr(Q, "DELIVERED", 400)
    assert sorted(map(tuple, Q.a02_growing_segments(spark, sf_dir).collect())) == whole
    assert sum(held) == sum(r[1] for r in whole) and max(held) < sum(held) / 2 and len(held) >= 4
    assert not Q.J.exists(spark, paths[0])
