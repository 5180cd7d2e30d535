"""Streaming forms: tailing, metrics, tags, flushes (A2, L1-L4)."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import exchange as X
from ..operators.tagging import THROTTLE_SCHEMA, Allowance, Breaker
from ..schema import EVENT_SCHEMA
from ..sources.journal import write_snapshot
from ..workers import prepare


def tail_events(spark: SparkSession, path: str, max_files: int | None = None, clean: str = "off", archive: str | None = None) -> DataFrame:
    """Stream of journal events; every file once, resumed from the query's checkpoint.

    clean is off, archive (to `archive`) or delete: what happens to files that were read whole.
    """
    options = {"cleanSource": clean} | ({"maxFilesPerTrigger": str(max_files)} if max_files else {}) | ({"sourceArchiveDir": archive} if archive else {})
    return spark.readStream.schema(f"{EVENT_SCHEMA}, date date").options(**options).parquet(path)


def tail_segments(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Stream of the names of a journal's files, each once; what they hold isn't read."""
    options = {"pathGlobFilter": "*.parquet"} | ({"maxFilesPerTrigger": str(max_files)} if max_files else {})
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").options(**options).load(path).select("path")


def poll(writer: DataStreamWriter, checkpoint: str, every: str | None = "1 second") -> StreamingQuery:
    """Start with a fixed polling interval; every=None reads what there is and stops."""
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def stream_metrics(exchanges: DataFrame, interval: str = "1 second", watermark: str = "10 seconds", at: str = "ts") -> DataFrame:
    """Counts, class counts, byte and duration sums per route and tumbling tick."""
    s = F.col("status")
    rows = exchanges.withWatermark(at, watermark)
    return rows.groupBy(F.window(at, interval), "route_id").agg(
        F.count("*").alias("total"), *[F.count_if(s.between(k * 100, k * 100 + 99)).alias(f"n_{k}xx") for k in (2, 4, 5)],
        F.sum(F.col("client_end_ns") - F.col("client_start_ns")).alias("duration_ns_sum"), F.sum(X.total_bytes("request")).alias("request_bytes"),
    ).select(F.col("window.start").alias("tick"), "route_id", "total", "n_2xx", "n_4xx", "n_5xx", "duration_ns_sum", "request_bytes")


def throttle_stream(rows: DataFrame, allowance: Allowance, watermark: str = "1 minute") -> DataFrame:
    """throttle_tag over a stream of (route_id, key, at, id); idle keys lose their state after the TTL."""
    columns = [c.split(" ")[0] for c in THROTTLE_SCHEMA.split(", ")]

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        bucket, made = (tuple(state.get) if state.exists else None), []
        # groups are many and small: plain arrays cost a fraction of a frame's sort and rows
        at, ids = (np.concatenate(x) for x in zip(*[(f["at"].to_numpy(), f["id"].to_numpy()) for f in frames]))
        order = np.lexsort((ids, at))
        for moment in at[order].tolist():
            bucket, *taken = allowance.take(bucket, int(moment))
            made.append(taken)
        state.update(bucket)
        state.setTimeoutTimestamp(max(bucket[1] // 1_000_000, state.getCurrentWatermarkMs()) + max(1, allowance.expiry_ns // 1_000_000))
        n = len(made)
        yield pd.DataFrame(dict(zip(columns, ([key[0]] * n, [key[1]] * n, ids[order], *map(list, zip(*made)), [allowance.capacity] * n))))

    prepare(rows.sparkSession)
    timed = rows.withColumn("event_time", X.utc_micros("at")).withWatermark("event_time", watermark)
    return timed.groupBy("route_id", "key").applyInPandasWithState(run, THROTTLE_SCHEMA, "level bigint, at bigint", "append", GroupStateTimeout.EventTimeTimeout)


def outage_stream(points: DataFrame, failure_threshold: int, cooldown_ns: int) -> DataFrame:
    """outage_state over a stream of outage_events rows."""
    schema = "route_id string, id bigint, state string, rejected boolean"

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        breaker = Breaker(failure_threshold, cooldown_ns)
        if state.exists:
            breaker.state, breaker.failures, breaker.opened, held = state.get
            breaker.rejected = set(json.loads(held))
        out = []
        for at, is_start, request, failed in pd.concat(list(frames)).sort_values(["at", "is_start", "id"])[["at", "is_start", "id", "failed"]].itertuples(index=False):
            if is_start:
                out.append((key[0], int(request), *breaker.start(int(at), int(request))))
            else:
                breaker.end(int(at), int(request), bool(failed))
        state.update((breaker.state, breaker.failures, breaker.opened, json.dumps(sorted(breaker.rejected))))
        yield pd.DataFrame(out, columns=["route_id", "id", "state", "rejected"])

    prepare(points.sparkSession)
    return points.groupBy("route_id").applyInPandasWithState(run, schema, "state string, failures int, opened bigint, rejected string", "append", GroupStateTimeout.NoTimeout)


def flush_metrics(metrics: DataFrame, path: str, checkpoint: str, every: str | None = "2 seconds") -> StreamingQuery:
    """Replace the snapshot at `path` with each batch's complete metrics."""
    writer = metrics.writeStream.outputMode("complete").foreachBatch(lambda df, _: write_snapshot(df, path) and None)
    return poll(writer, checkpoint, every)
