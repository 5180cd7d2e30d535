"""Micro-batches written once, and rows behind the watermark kept instead of lost.

A batch has a folder of its own, which a replay replaces: after a crash between two writes nothing is
doubled and nothing is missing.
"""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.assemble import dedupe_events
from ..schema import EVENT_SCHEMA
from ..sources.journal import exists, remove
from .exchanges import poll, tail_segments


def batch_path(path: str, batch: int) -> str:
    return f"{path}/batch={batch}"


def write_batch(df: DataFrame, path: str, batch: int, partition_by: tuple[str, ...] = ()) -> None:
    """Write a micro-batch to its own folder under path, in place of what an earlier try left there."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(batch_path(path, batch))


def read_batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All batches under path, with their number as `batch`; none where nothing was written yet."""
    whole = f"{schema}, batch bigint"
    return spark.read.schema(whole).parquet(path) if exists(spark, path) else spark.createDataFrame([], whole)


def dedupe_stream(events: DataFrame, within: str = "10 minutes") -> DataFrame:
    """Events that a tailer may have read again after a crash, once each, as a stream (K4).

    A copy is recognised while the first one's event time is at most `within` behind the newest: ids leave
    the state after that, so it is bounded. Rows that come later than `within` are dropped by the watermark;
    put late_gate before, where they have to be kept. Every row is shuffled, and a backlog's ids are all held in the
    state until it is read: dedupe_segments takes large ones.
    """
    return events.withWatermark("event_time", within).dropDuplicatesWithinWatermark(["req_id", "seq"])


MARK = "newest_ms bigint"


def _newest(spark: SparkSession, path: str, batch: int) -> int | None:
    """The greatest event time, in ms, of the batches before this one: the last mark written holds it."""
    if batch == 0:
        return None
    return spark.read.schema(MARK).parquet(batch_path(f"{path}/marks", batch - 1)).first().newest_ms


def late_gate(events: DataFrame, path: str, checkpoint: str, delay_ms: int, every: str | None = None, at: str = "event_time") -> StreamingQuery:
    """Write a stream of events to path/events, apart as late=true and late=false.

    An event is late if its time is before the watermark: the newest event time of all earlier batches, less
    delay_ms. That is the rule by which a watermark drops rows; here they are kept, and can be counted,
    corrected or fed in again. One pass writes both sides; the batch's mark is written after it. Each batch
    reads one mark, however long the stream has run. Events without a time are not late.
    """

    def split(df: DataFrame, batch: int) -> None:
        spark, seen = df.sparkSession, Observation()
        before = _newest(spark, path, batch)
        ms = F.unix_millis(at)
        late = F.lit(False) if before is None else F.coalesce(ms < before - delay_ms, F.lit(False))
        write_batch(df.observe(seen, F.max(ms).alias("newest_ms")).withColumn("late", late), f"{path}/events", batch, ("late",))
        known = [x for x in (before, seen.get.get("newest_ms")) if x is not None]
        write_batch(spark.createDataFrame([(max(known, default=None),)], MARK).coalesce(1), f"{path}/marks", batch)

    return poll(events.writeStream.foreachBatch(split), checkpoint, every)


def gated(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What late_gate wrote: the events with `late` and `batch`."""
    return read_batches(spark, f"{path}/events", f"{schema}, late boolean")


def on_time_stream(spark: SparkSession, path: str, schema: str, max_files: int | None = None) -> DataFrame:
    """The events that late_gate let through, as a stream."""
    options = {"maxFilesPerTrigger": str(max_files)} if max_files else {}
    return spark.readStream.schema(schema).options(**options).parquet(f"{path}/events/batch=*/late=false")


IDS = "req_id string, seq bigint, ms bigint"
MOST_FILES = 1_000  # with repeated ids that are told apart; beyond it every row of the batch is compared


def _suspects(ids: DataFrame, seen: DataFrame) -> list[int] | None:
    """Files with an id that comes twice, among `ids` (hash, file) or in what was seen; None: it may be any file.

    Ids are counted by their hash. Two that share one name a file without need, which changes no result; a file
    is a hash as well.
    """
    old = seen.select(F.xxhash64("req_id", "seq").alias("hash"), F.lit(None).cast("bigint").alias("file"))
    counts = ids.unionByName(old).groupBy("hash").agg(F.count("*").alias("n"), F.count("file").alias("new"), F.min("file").alias("first"), F.max("file").alias("last"))
    # the least and the greatest name them all, unless there are three copies in different files
    named = F.when((F.col("new") <= 2) | (F.col("first") == F.col("last")), F.array("first", "last")).otherwise(F.array(F.lit(None).cast("bigint")))
    found = [r.file for r in counts.where("n > 1 and new > 0").select(F.explode(named).alias("file")).distinct().limit(MOST_FILES + 1).collect()]
    return None if None in found or len(found) > MOST_FILES else found


def _segments(spark: SparkSession, path: str, files: list[str]) -> DataFrame:
    """Events of some files of a folder; none of no files."""
    none = spark.createDataFrame([], EVENT_SCHEMA)
    return spark.read.schema(EVENT_SCHEMA).option("basePath", path).parquet(*files).select(none.columns) if files else none


def dedupe_segments(spark: SparkSession, path: str, out: str, checkpoint: str, within_ms: int, every: str | None = None, max_files: int | None = None) -> StreamingQuery:
    """Tell which events of a folder's segments are new, as the segments come, each batch once (K4); `deduped` reads them.

    The rows of dedupe_stream, with no id held in memory: the stream carries the names of new segments, and a batch
    reads the columns it needs. Ids are counted by hash, with those remembered. What a crash has read again lies in
    few segments: these are compared id by id and written anew to out/events. All others are named in out/segments and
    stay where they are, so the folder has to keep them. An id stays in out/ids while it is at most twice
    `within_ms` behind the newest event: a row is at most once that late, and its copy's time may differ by as much.
    Rows later than that are dropped as by a watermark.
    """

    def write(names: DataFrame, batch: int) -> None:
        spark, ms, file = names.sparkSession, F.unix_millis("event_time"), F.col("_metadata.file_path")
        before = _newest(spark, out, batch)
        rows = _segments(spark, path, [r.path for r in names.collect()])
        found = rows.groupBy(file.alias("file")).agg(F.min(ms).alias("oldest"), F.max(F.coalesce(ms, F.lit(2**62))).alias("last"), F.max(ms).alias("newest")).select("*", F.xxhash64("file").alias("hash")).collect()
        newest = max([x for x in (before, *[r.newest for r in found]) if x is not None], default=None)
        late = None if before is None else before - within_ms
        old_enough = F.lit(True) if late is None else F.coalesce(ms >= late, F.lit(True))
        seen = spark.read.schema(IDS).parquet(batch_path(f"{out}/ids", batch - 1)) if batch else spark.createDataFrame([], IDS)
        named = _suspects(rows.where(old_enough).select(F.xxhash64("req_id", "seq").alias("hash"), F.xxhash64(file).alias("file")), seen)
        changed = [named is None or r.hash in named or (late is not None and r.oldest is not None and r.oldest < late) for r in found]
        places = [unquote(r.file) for r in found]  # Spark gives them as URIs
        whole = [p for p, c in zip(places, changed) if not c]
        old = seen.select(F.col("req_id").alias("_req_id"), F.col("seq").alias("_seq"))
        doubted = _segments(spark, path, [p for p, c in zip(places, changed) if c]).where(old_enough)
        new = doubted.join(old, F.col("req_id").eqNullSafe(F.col("_req_id")) & F.col("seq").eqNullSafe(F.col("_seq")), "left_anti")
        write_batch(dedupe_events(new), f"{out}/events", batch)
        write_batch(spark.createDataFrame([(p,) for p in whole], "path string").coalesce(1), f"{out}/segments", batch)
        horizon = None if newest is None else newest - 2 * within_ms
        recent = [unquote(r.file) for r, c in zip(found, changed) if not c and (horizon is None or r.last >= horizon)]  # an event without a time counts as the newest
        kept = _segments(spark, path, recent).unionByName(spark.read.schema(EVENT_SCHEMA).parquet(batch_path(f"{out}/events", batch)))
        known = kept.select("req_id", "seq", F.coalesce(ms, F.lit(newest).cast("bigint")).alias("ms")).unionByName(seen)
        write_batch(known if horizon is None else known.where(F.coalesce(F.col("ms") >= horizon, F.lit(True))), f"{out}/ids", batch)
        write_batch(spark.createDataFrame([(newest,)], MARK).coalesce(1), f"{out}/marks", batch)
        remove(spark, batch_path(f"{out}/ids", batch - 2))  # a replay reads the ids of the batch before

    return poll(tail_segments(spark, path, max_files).writeStream.foreachBatch(write), checkpoint, every)


def deduped(spark: SparkSession, path: str, out: str) -> DataFrame:
    """The events of the folder that dedupe_segments went through, each once."""
    files = [r.path for r in read_batches(spark, f"{out}/segments", "path string").collect()]
    return _segments(spark, path, files).unionByName(read_batches(spark, f"{out}/events", EVENT_SCHEMA).drop("batch"))


def late_anomalies(late: DataFrame) -> DataFrame:
    """req_id, seq, event_type, anomaly of late rows whose loss is felt: an END, a body or a slice."""
    kind = F.col("event_type")
    named = F.when(kind == "END", "LATE_END").when(kind.endswith("_BODY"), "LATE_BODY").otherwise("LATE_SLICE")
    return late.select("req_id", "seq", "event_type", named.alias("anomaly"))


def split_outcomes(exchange_rows: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Reassembled rows: complete ones to path/exchanges, others to path/anomalies, each batch once."""

    def split(df: DataFrame, batch: int) -> None:
        df = df.persist()
        write_batch(df.where("outcome = 'COMPLETE'"), f"{path}/exchanges", batch)
        write_batch(df.where("outcome <> 'COMPLETE'"), f"{path}/anomalies", batch)
        df.unpersist()

    return poll(exchange_rows.writeStream.foreachBatch(split), checkpoint, every)


def on_complete(exchange_rows: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Call fn(batch of complete exchanges, batch id) for each micro-batch; after a crash a batch may come again, with its id."""
    return poll(exchange_rows.writeStream.foreachBatch(lambda df, n: fn(df.where("outcome = 'COMPLETE'"), n)), checkpoint, every)
