"""Time series over exchanges and observations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import segments

KINDS = (("success", 2), ("client_error", 4), ("server_error", 5))


def tick_of(ns: str, interval_s: int) -> Column:
    return F.call_function("div", F.col(ns), F.lit(interval_s * 1_000_000_000))


def tick_counts(exchanges: DataFrame, interval_s: int, by: Sequence[str] = ("route_id",)) -> DataFrame:
    """Counts of each class per tick; ticks without rows are absent."""
    s = F.col("status")
    return exchanges.groupBy(*by, tick_of("client_start_ns", interval_s).alias("tick")).agg(*[F.count_if(s.between(k * 100, k * 100 + 99)).cast("int").alias(n) for n, k in KINDS])


def sparkline_ticks(exchanges: DataFrame, period_s: int = 120, interval_s: int = 1, end_ns: Column | None = None, by: Sequence[str] = ("route_id",)) -> DataFrame:
    """The last period div interval ticks of every route, gaps 0. The spine is routes x capacity rows."""
    capacity = period_s // interval_s
    counts = tick_counts(exchanges, interval_s, by)
    if end_ns is None:
        last = counts.agg(F.max("tick").alias("last"))
        routes = exchanges.select(*by).distinct().crossJoin(F.broadcast(last))  # one row
    else:
        routes = exchanges.select(*by).distinct().withColumn("last", F.call_function("div", end_ns, F.lit(interval_s * 1_000_000_000)))
    spine = routes.where("last is not null").select(*by, F.explode(F.sequence(F.col("last") - capacity + 1, F.col("last"))).alias("tick"))
    return spine.join(counts, [*by, "tick"], "left").fillna(0, [n for n, _ in KINDS])


def sparkline(exchanges: DataFrame, period_s: int = 120, interval_s: int = 1, end_ns: Column | None = None, by: Sequence[str] = ("route_id",)) -> DataFrame:
    """One row per route: capacity, interval_ms and an array per class, oldest tick first."""
    ticks = sparkline_ticks(exchanges, period_s, interval_s, end_ns, by)
    packed = F.array_sort(F.collect_list(F.struct("tick", *[n for n, _ in KINDS])))
    rows = ticks.groupBy(*by).agg(packed.alias("_t"))
    return rows.select(*by, F.lit(period_s // interval_s).alias("capacity"), F.lit(interval_s * 1000).cast("bigint").alias("interval_ms"), *[F.col("_t")[n].alias(n) for n, _ in KINDS])


def spark_rates(lines: DataFrame) -> DataFrame:
    """lines with the rounded rate per second of the newest tick of each class, and their sum."""
    seconds = F.greatest(F.lit(0.001), F.col("interval_ms") / 1000.0)
    out = lines.withColumns({f"{n}_rate": F.floor(F.element_at(n, -1) / seconds + 0.5).cast("int") for n, _ in KINDS})
    return out.withColumn("rate", reduce(Column.__add__, [F.col(f"{n}_rate") for n, _ in KINDS]))


def counter_delta(samples: DataFrame, by: Sequence[str], order: str, counters: Sequence[str]) -> DataFrame:
    """Differences of cumulative counters from sample to sample; the first sample gives 0."""
    w = Window.partitionBy(*by).orderBy(order)
    return samples.withColumns({f"{c}_delta": F.coalesce(F.col(c) - F.lag(c).over(w), F.lit(0)) for c in counters})


def resume_sparkline(old: DataFrame, new: DataFrame, capacity: int, by: Sequence[str] = ("route_id",)) -> DataFrame:
    """new ticks after the old ones, the oldest dropped; old ticks of another capacity are forgotten (zeros)."""
    names = [n for n, _ in KINDS]
    before = old.select(*by, F.col("capacity").alias("_capacity"), *[F.col(n).alias(f"_{n}") for n in names])
    both = new.join(before, list(by), "left")
    zeros = F.array_repeat(F.lit(0), capacity)
    kept = {n: F.slice(F.concat(F.when(F.col("_capacity") == capacity, F.col(f"_{n}")).otherwise(zeros), F.col(n)), -capacity, capacity) for n in names}
    return both.select(*by, F.lit(capacity).alias("capacity"), *[c.alias(n) for n, c in kept.items()])


def streaks(df: DataFrame, by: Sequence[str], order: Sequence[str], flag: str, bucket: Column | None = None) -> DataFrame:
    """df with `streak`: how many rows in a row, up to this one, have had this flag.

    Rows are cut at buckets of the order (hours of its first column, a time, unless another is given), so a key's
    history is spread over tasks.
    """
    found = segments.runs(df, by, order, flag, segments.hours(order[0]) if bucket is None else bucket)
    return found.select(*df.columns, "streak")


def order_segments(segments: DataFrame) -> DataFrame:
    return segments.orderBy("shard", "timestamp", "rotation")


def last_ticks(df: DataFrame, by: Sequence[str], n: int, order: str = "tick") -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc(order))
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def union_shards(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
