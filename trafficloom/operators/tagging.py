"""State carried along each key's time order: throttling, outages, health (H1-H5)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..workers import prepare
from . import segments


@dataclass(frozen=True)
class Allowance:
    """A token bucket: `capacity` tokens, refilled continuously by `refill` tokens each `period_ns`."""

    capacity: int
    refill: int
    period_ns: int
    ttl_ns: int | None = None

    @property
    def expiry_ns(self) -> int:
        return self.ttl_ns if self.ttl_ns is not None else max(10 * self.period_ns, 30_000_000_000)

    @property
    def pause_ns(self) -> int:
        """After such a pause the bucket is full, whatever it held."""
        return min(self.expiry_ns + 1, -(-self.capacity * self.period_ns // self.refill))

    def take(self, state: tuple[int, int] | None, at: int) -> tuple[tuple[int, int], bool, int, int]:
        """(new state, allowed, remaining tokens, seconds to wait or 0). Tokens count in units of 1/period_ns."""
        full = self.capacity * self.period_ns
        if state is None or at - state[1] > self.expiry_ns:
            level = full
        else:
            level = min(full, state[0] + (at - state[1]) * self.refill)
        if level >= self.period_ns:
            level -= self.period_ns
            return (level, at), True, level // self.period_ns, 0
        wait = -(-(self.period_ns - level) // self.refill)
        return (level, at), False, 0, wait // 1_000_000_000 + 1


@dataclass
class Breaker:
    """Outage state of one route; times in ns. A rejected request has no outcome."""

    threshold: int
    cooldown_ns: int
    state: str = "CLOSED"
    failures: int = 0
    opened: int = 0
    rejected: set = field(default_factory=set)  # rejected requests that haven't ended: as many as run at once

    def start(self, at: int, request: object) -> tuple[str, bool]:
        if self.state == "OPEN" and at - self.opened >= self.cooldown_ns:
            self.state = "HALF_OPEN"  # this request is the probe
            return self.state, False
        if self.state == "CLOSED":
            return self.state, False
        self.rejected.add(request)
        return self.state, True

    def end(self, at: int, request: object, failed: bool) -> None:
        if request in self.rejected:
            self.rejected.discard(request)
        elif not failed:
            self.failures = 0
            if self.state == "HALF_OPEN":
                self.state = "CLOSED"
        elif self.state == "HALF_OPEN":
            self.state, self.opened = "OPEN", at
        elif self.state == "CLOSED":
            self.failures += 1
            if self.failures >= self.threshold:
                self.state, self.opened = "OPEN", at


def _same(a: tuple, b: tuple) -> bool:
    return a == b or all(x == y or (x != x and y != y) for x, y in zip(a, b))  # pandas shows nulls among numbers as NaN


def _fold(df: DataFrame, keys: list[str], order: list[str], start: Callable, schema: str, shown: int | None = None) -> DataFrame:
    """Run `start()(row values) -> output or None` over each key's rows in order; state outlives batches.

    The first `shown` keys (all, unless given) come before what a step gives.

    Rows of a key are in one partition, sorted; batches stream through, so a hot key costs time, never
    memory.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, step = None, None
        for pdf in batches:
            out = []
            n = len(keys)
            for row in pdf.itertuples(index=False, name=None):
                if step is None or not _same(row[:n], key):
                    key, step = row[:n], start()
                made = step(*row[n:])
                if made is not None:
                    out.append((*key[:shown], *made))
            yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in schema.split(", ")])

    prepare(df.sparkSession)
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


THROTTLE_SCHEMA = "route_id string, key string, id bigint, allowed boolean, remaining bigint, retry_after bigint, limit bigint"


HOT_ROWS = 200_000  # rows of a key above which its history is cut into pieces


def throttle_tag(df: DataFrame, allowance: Allowance, key: Column | str = "client_ip", route: str = "route_id", at: str = "client_start_ns", id_: str = "event_id", hot_rows: int = HOT_ROWS) -> DataFrame:
    """(route_id, key, id, allowed, remaining, retry_after, limit) for each row; join on the id for more.

    A pause that fills the bucket, or outlives it, makes what follows independent of what came before. Where a
    count shows keys of more than hot_rows rows, these are cut at such pauses, and the pieces run apart; the
    result is the same. A key that never pauses stays one piece, whose rows stream through one task.
    """
    rows = df.select(F.col(route).alias("route_id"), (F.col(key) if isinstance(key, str) else key).alias("key"), F.col(at).alias("at"), F.col(id_).alias("id"))

    def start():
        state = None

        def step(when, request):
            nonlocal state
            state, ok, left, wait = allowance.take(state, int(when))
            return int(request), ok, left, wait, allowance.capacity

        return step

    keys, order = ["route_id", "key"], ["at", "id"]
    busy = rows.groupBy(*keys).count().where(F.col("count") > hot_rows)
    if busy.isEmpty():
        return _fold(rows, keys, order, start, THROTTLE_SCHEMA)
    rows = rows.join(busy.select(F.struct(*keys).alias("_hot")), F.struct(*keys) == F.col("_hot"), "left")
    hot = segments.pieces(rows.where("_hot is not null").drop("_hot"), keys, "at", allowance.pause_ns, segments.hours("at", ns=True))
    calm = rows.where("_hot is null").drop("_hot").withColumn("_piece", F.lit(None).cast(hot.schema["_piece"].dataType))
    pieces = hot.unionByName(calm).select(*keys, "_piece.bucket", "_piece.number", *order)
    return _fold(pieces, [*keys, "bucket", "number"], order, start, THROTTLE_SCHEMA, shown=2)


OUTAGE_SCHEMA = "route_id string, id bigint, state string, rejected boolean"


def outage_events(df: DataFrame, route: str = "route_id", id_: str = "event_id") -> DataFrame:
    """Starts and ends as one sequence; at equal times ends come first."""
    points = F.array(F.struct(F.col("client_start_ns").alias("at"), F.lit(1).alias("is_start")), F.struct(F.col("client_end_ns").alias("at"), F.lit(0).alias("is_start")))
    return df.select(F.col(route).alias("route_id"), F.explode(points).alias("p"), F.col(id_).alias("id"), (F.col("status").between(500, 599)).alias("failed")).select("route_id", "p.at", "p.is_start", "id", "failed")


def outage_state(df: DataFrame, failure_threshold: int, cooldown_ns: int, route: str = "route_id", id_: str = "event_id") -> DataFrame:
    """(route_id, id, state, rejected): the breaker's answer at each request's start."""

    def start():
        breaker = Breaker(failure_threshold, cooldown_ns)

        def step(at, is_start, request, failed):
            if is_start:
                return (int(request), *breaker.start(int(at), request))
            breaker.end(int(at), request, bool(failed))
            return None

        return step

    return _fold(outage_events(df, route, id_), ["route_id"], ["at", "is_start", "id"], start, OUTAGE_SCHEMA)


def target_health(probes: DataFrame, rise: int = 2, fall: int = 2, overrides: Mapping[str, str] | None = None, by: str = "target", order: tuple[str, ...] = ("ts", "event_id"), bucket: Column | None = None) -> DataFrame:
    """probes with streak, state (UP or DOWN after each) and was (the state before, null for a target's first).

    Targets start UP; FORCE_UP / FORCE_DOWN override. A target's history is cut at buckets of time (hours unless
    another is given), so it is no single task.
    """
    found = segments.runs(probes, [by], order, "ok", segments.hours(order[0]) if bucket is None else bucket, rise, fall)
    named = lambda c: F.when(F.col(c), "UP").when(~F.col(c), "DOWN").otherwise("UP")
    state, was = named("state"), named("was")
    for target, how in (overrides or {}).items():
        if how in ("FORCE_UP", "FORCE_DOWN"):
            state, was = (F.when(F.col(by) == target, how.removeprefix("FORCE_")).otherwise(x) for x in (state, was))
    return found.withColumns({"state": state, "was": F.when(~F.col("_head"), was)}).drop("_head")


def health_transitions(health: DataFrame) -> DataFrame:
    """Rows of target_health where the state differs from the one before (UP before the first)."""
    return health.where(F.col("state") != F.coalesce("was", F.lit("UP")))


def health_intervals(health: DataFrame, by: str = "target", at: str = "ts", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """(target, state, from_ts, to_ts) from the first observation on; the last interval is open.

    Only the rows that change a state are brought together by target.
    """
    cuts = health.where("was is null or state <> was")
    return cuts.select(by, "state", F.col(at).alias("from_ts"), F.lead(at).over(Window.partitionBy(by).orderBy(*order)).alias("to_ts"))


def route_availability(intervals: DataFrame, route: str = "route_id") -> DataFrame:
    """(route_id, from_ts, to_ts) with at least one target UP; neighbouring intervals are one."""
    up = intervals.where("state = 'UP'")
    steps = up.select(route, F.col("from_ts").alias("at"), F.lit(1).alias("d")).unionByName(up.where("to_ts is not null").select(route, F.col("to_ts").alias("at"), F.lit(-1).alias("d")))
    w = Window.partitionBy(route).orderBy("at")
    levels = steps.groupBy(route, "at").agg(F.sum("d").alias("d")).withColumn("n", F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    flags = levels.withColumn("up", F.col("n") > 0).withColumn("_was", F.lag(F.col("n") > 0).over(w)).where("_was is null or up <> _was")
    return flags.select(route, "up", F.col("at").alias("from_ts"), F.lead("at").over(w).alias("to_ts")).where("up").drop("up")
