"""Whole exchanges from a stream of journal events, with keyed state.

The state of an id is a value (counters, address, deadline, its four slices at most) and a list of its body
fragments, so a fragment adds to what is stored and rewrites none of the others. An exchange whose events arrive
in one micro-batch never enters the state. A timer in event time ends what stays open. What a slice or an END
says passes Python as one JSON text that is taken apart afterwards: Python pays for each value of a row.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.assemble import SLICES
from ..schema import END_COLUMNS, PAIRS
from ..workers import prepare

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NUMBERS = tuple(c for c in END_COLUMNS if c != "attributes")
SLICE = f"level string, status int, start_line string, headers {PAIRS}"
SIDES = ("REQUEST_BODY", "RESPONSE_BODY")
HEAD = "generation bigint, started boolean, seen bigint, request_parts int, response_parts int, deadline bigint, slices array<string>"
#: What Python sees of an event and makes of an exchange. A slice is a JSON text with its address, an END one with its status.
CODES = {kind: code for code, kind in enumerate((*SLICES, *SIDES, "END"))}
PACKED_SLICE = f"{SLICE}, client_ip string, client_ip_source string"
PACKED_END = "status int, " + ", ".join(f"{c} bigint" for c in NUMBERS) + f", attributes {PAIRS}"
PACKED_ROW = (
    "req_id string, generation bigint, outcome string, " + ", ".join(f"{k.lower()} string" for k in SLICES)
    + ", request_body array<binary>, response_body array<binary>, ended string, request_fragments int, response_fragments int"
)
PACKED = Row("req_id", "generation", "outcome", *[k.lower() for k in SLICES], "request_body", "response_body", "ended", "request_fragments", "response_fragments")


def _slice_type(kind: str) -> str:
    return f"struct<{SLICE}>" if kind.endswith("RESPONSE") else f"struct<{SLICE.replace('status int, ', '')}>"


EXCHANGE_ROW = (
    "req_id string, generation bigint, outcome string, "
    + ", ".join(f"{k.lower()} {_slice_type(k)}" for k in SLICES)
    + ", client_ip string, client_ip_source string, request_body array<binary>, response_body array<binary>, status int, "
    + ", ".join(f"{c} bigint" for c in NUMBERS)
    + f", attributes {PAIRS}, start_line string, route_id string, request_fragments int, response_fragments int"
)


class _Open:
    """An open exchange: what the state holds of it, fragments apart, and what this batch adds."""

    def __init__(self, generation: int = 0, started: bool = False, seen: int = 0, request_parts: int = 0, response_parts: int = 0, deadline: int | None = None, slices: Sequence[str | None] = (None,) * len(SLICES)):
        self.generation, self.started, self.seen, self.deadline = generation, started, seen, deadline
        self.parts = [request_parts, response_parts]
        self.slices = list(slices)
        self.bodies: list[tuple] = []

    def head(self) -> tuple:
        return self.generation, self.started, self.seen, *self.parts, self.deadline, self.slices


class ExchangeProcessor(StatefulProcessor):
    def __init__(self, limit_ms: int, bodies: bool):
        self.limit_ms, self.bodies = limit_ms, bodies

    def init(self, handle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", HEAD)
        self.parts = handle.getListState("parts", "side int, seq bigint, body binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803  (names that Spark calls)
        held = self.head.get()
        stored = held is not None
        now = _Open(*held) if stored else _Open()
        kept = sum(now.parts)  # fragments of `now` that the state holds
        timer, last, made = now.deadline, None, []
        for row in sorted(rows, key=_seq):
            _, seq, code, moment, text, body = row
            last = moment if last is None or moment is not None and moment > last else last
            now.seen += 1
            if code < len(SLICES):
                now.started = True
                now.slices[code] = text
            elif code < END:
                if now.started:  # a fragment counts only after the first slice of its generation
                    now.parts[code - len(SLICES)] += 1
                    if self.bodies:
                        now.bodies.append((code, seq, body))
            elif code != END:  # a slice of a kind that no row shows
                now.started = True
            else:
                made.append(self._row(key[0], now, kept, text))
                if stored:
                    self._clear(kept)
                stored, kept, now = False, 0, _Open(now.generation + 1)
        if timer is not None:
            self.handle.deleteTimer(timer)
        if now.seen:
            now.deadline = max(_millis(last), timerValues.getCurrentWatermarkInMs()) + self.limit_ms
            self.head.update(now.head())
            if now.bodies:
                self.parts.appendList(now.bodies)
            self.handle.registerTimer(now.deadline)
        return iter(made)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        held = self.head.get()
        if held is None:
            return iter(())
        now = _Open(*held)
        made = self._row(key[0], now, sum(now.parts), None)
        self._clear(sum(now.parts))
        return iter((made,))

    def close(self) -> None:
        pass

    def _clear(self, kept: int) -> None:
        self.head.clear()
        if kept and self.bodies:
            self.parts.clear()

    def _row(self, req_id: str, now: _Open, kept: int, end: str | None) -> Row:
        bodies = now.bodies
        if kept and self.bodies:
            bodies = sorted([tuple(x) for x in self.parts.get()] + bodies, key=lambda x: x[1])
        if end is None:
            outcome = "IN_FLIGHT"
        elif not now.started:
            outcome = "ORPHAN_END"
        elif now.slices[0] is None:
            outcome = "NO_CLIENT_REQUEST"
        else:
            outcome = "COMPLETE"  # or NO_STATUS, which the END's text decides
        texts = [[bytes(x[2]) for x in bodies if x[0] == CODES[side]] for side in SIDES] if self.bodies else [None, None]
        return PACKED(req_id, now.generation, outcome, *now.slices, *texts, end, *now.parts)


END = CODES["END"]
EPOCH = datetime.datetime(1970, 1, 1, tzinfo=datetime.timezone.utc)


def _seq(row: Row) -> int:
    return row[1]


def _millis(moment: datetime.datetime | None) -> int:
    """Milliseconds since 1970; a moment without a zone is one of the worker's own."""
    return 0 if moment is None else (moment.astimezone(datetime.timezone.utc) - EPOCH) // datetime.timedelta(milliseconds=1)


def _packed(events: DataFrame, bodies: bool) -> DataFrame:
    """The six columns that the processor reads."""
    kind = F.col("event_type")
    slice_ = F.struct(F.col("journal_level").alias("level"), "status", "start_line", "headers", "client_ip", "client_ip_source")
    text = F.when(kind.isin(list(SLICES)), F.to_json(slice_)).when(kind == "END", F.to_json(F.struct("status", *END_COLUMNS)))
    code = F.coalesce(*[F.when(kind == k, F.lit(n)) for k, n in CODES.items()], F.lit(END + 1))
    return events.select("req_id", "seq", code.alias("code"), "event_time", text.alias("text"), (F.col("body") if bodies else F.lit(None).cast("binary")).alias("body"))


def _unpacked(rows: DataFrame) -> DataFrame:
    """EXCHANGE_ROW from what the processor makes."""
    each = rows.select("*", *[F.from_json(k.lower(), PACKED_SLICE).alias(f"_{k.lower()}") for k in SLICES], F.from_json("ended", PACKED_END).alias("_end"))
    ended = F.col("ended").isNotNull()
    status = F.when(ended, F.coalesce("_end.status", F.lit(0)))
    outcome = F.when((F.col("outcome") == "COMPLETE") & (status <= 0), "NO_STATUS").otherwise(F.col("outcome"))
    made = ["req_id", "generation", outcome.alias("outcome")]
    for kind in SLICES:
        c = F.col(f"_{kind.lower()}")
        fields = ["level", *(["status"] if kind.endswith("RESPONSE") else []), "start_line", "headers"]
        made.append(F.when(F.col(kind.lower()).isNotNull(), F.struct(*[c[f].alias(f) for f in fields])).alias(kind.lower()))
    route = F.get(F.filter("_end.attributes", lambda a: a["name"] == "gateway.route.id"), F.lit(0))["value"]
    return each.select(
        *made, *[F.col(f"_{SLICES[0].lower()}.{c}").alias(c) for c in ("client_ip", "client_ip_source")], "request_body", "response_body", status.alias("status"),
        *[F.col(f"_end.{c}").alias(c) for c in END_COLUMNS], F.col(f"_{SLICES[0].lower()}.start_line").alias("start_line"), route.alias("route_id"), "request_fragments", "response_fragments",
    )


def use_rocksdb(spark: SparkSession) -> None:
    """Stateful processors need the RocksDB state store; set it where the session has Spark's default."""
    if "HDFSBackedStateStoreProvider" in spark.conf.get(PROVIDER, "HDFSBackedStateStoreProvider"):
        spark.conf.set(PROVIDER, ROCKS)


def reassemble_stream(events: DataFrame, timeout: str = "10 minutes", watermark: str = "1 minute", bodies: bool = True) -> DataFrame:
    """One row per exchange as its END arrives, with all that `assemble.reassemble` gives and its outcome.

    Outcomes: COMPLETE (the rows of reassemble), NO_STATUS, NO_CLIENT_REQUEST, ORPHAN_END, and IN_FLIGHT for what
    stays open for `timeout` of event time, with the slices and fragments it has. Rows behind the watermark are
    dropped; put batches.late_gate before, where they have to be kept. With bodies=False fragments are counted and
    not kept. An id's events within a micro-batch are taken by seq, and held until its END or the batch's end.
    """
    spark = events.sparkSession
    prepare(spark)
    use_rocksdb(spark)
    slim = _packed(events.withWatermark("event_time", watermark), bodies)
    processor = ExchangeProcessor(int(pd.Timedelta(timeout).total_seconds() * 1000), bodies)
    return _unpacked(slim.groupBy("req_id").transformWithState(processor, PACKED_ROW, "Append", "EventTime"))
