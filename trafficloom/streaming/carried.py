"""Whole exchanges from a stream of journal events, batch by batch, without Python and without keyed state.

A micro-batch is reassembled as a table is, by one shuffle on the id. What has no END yet is written as rows of its
own, and the next batch takes these rows in beside its events; so an exchange that is cut costs one row a batch, and
memory holds no more than a task's sort. For large deliveries; reassembly.reassemble_stream gives the same as one
streaming DataFrame, and pays Python for each event.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.assemble import SLICES
from ..schema import END_COLUMNS, PAIRS
from ..sources.journal import remove
from .batches import MARK, _newest, batch_path, read_batches, write_batch
from .exchanges import poll
from .reassembly import EXCHANGE_ROW, NUMBERS, SIDES, _slice_type

PARTS = "array<struct<seq: bigint, body: binary>>"
#: What a batch writes of an exchange; outcome is OPEN where no END came yet.
CARRIED = (
    "req_id string, generation bigint, " + ", ".join(f"{k.lower()} {_slice_type(k)}" for k in SLICES)
    + f", client_ip string, client_ip_source string, request_body {PARTS}, response_body {PARTS}, status int, " + ", ".join(f"{c} bigint" for c in NUMBERS)
    + f", attributes {PAIRS}, started boolean, request_fragments int, response_fragments int, deadline bigint, outcome string"
)


def _with_held(events: DataFrame, held: DataFrame | None) -> DataFrame:
    """The events, and before those of an id what is held of it, one row, with the generations of all."""
    kind = F.col("event_type")
    made = events.select(
        "req_id", "seq", "event_type", F.unix_millis("event_time").alias("ms"), F.col("journal_level").alias("level"), "status", "start_line", "headers", "client_ip", "client_ip_source", "body", *END_COLUMNS,
        F.lit(None).cast(f"struct<{CARRIED}>").alias("held"),
    )
    if held is not None:
        made = made.unionByName(held.select("req_id", F.struct(*held.columns).alias("held")), allowMissingColumns=True)
    before = Window.partitionBy("req_id").orderBy(F.col("held").isNull(), "seq").rowsBetween(Window.unboundedPreceding, -1)
    closed = F.coalesce(F.sum(F.coalesce(F.col("held.generation"), (kind == "END").cast("bigint"))).over(before), F.lit(0))
    return made.withColumn("generation", F.coalesce("held.generation", closed))


def _exchanges(events: DataFrame, limit_ms: int, watermark_ms: int, bodies: bool) -> DataFrame:
    """CARRIED rows of the ids and generations; a slice that comes later replaces the held one, fragments are added to the held ones."""
    def of(kind: str, aggregate: str) -> Column:
        return F.expr(f"{aggregate} filter (where event_type = '{kind}')")

    aggs = []
    for k in SLICES:
        fields = "level, status, start_line, headers" if k.endswith("RESPONSE") else "level, start_line, headers"
        aggs.append(of(k, f"max_by(struct({fields}{', client_ip, client_ip_source' if k == SLICES[0] else ''}), seq)").alias(f"_{k.lower()}"))
    aggs += [of(k, f"collect_list(struct(seq, {'body' if bodies else 'cast(null as binary) as body'}))").alias(f"_{k.lower()}") for k in SIDES]
    aggs += [
        of("END", f"any_value(struct(status, {', '.join(END_COLUMNS)}))").alias("_end"), F.expr("any_value(held) filter (where held is not null)").alias("_held"),
        F.expr(f"min(seq) filter (where held is null and coalesce(event_type, '') not in {('END', *SIDES)})").alias("_start"), F.max("ms").alias("_last"), F.expr("bool_or(held is null)").alias("_moved"),
    ]
    g = events.groupBy("req_id", "generation").agg(*aggs)
    held_start, ended = F.coalesce("_held.started", F.lit(False)), F.col("_end").isNotNull()
    # a fragment counts only after the first slice of its generation
    g = g.withColumns({f"_{k.lower()}": F.filter(f"_{k.lower()}", lambda x: held_start | (x["seq"] > F.col("_start"))) for k in SIDES})
    columns = ["req_id", "generation"]
    for k in SLICES:
        c = F.col(f"_{k.lower()}")
        fields = ["level", *(["status"] if k.endswith("RESPONSE") else []), "start_line", "headers"]
        columns.append(F.coalesce(F.when(c.isNotNull(), F.struct(*[c[f].alias(f) for f in fields])), F.col(f"_held.{k.lower()}")).alias(k.lower()))
    first = F.col(f"_{SLICES[0].lower()}")
    columns += [F.when(first.isNotNull(), first[c]).otherwise(F.col(f"_held.{c}")).alias(c) for c in ("client_ip", "client_ip_source")]
    for k in SIDES:
        # what is held and what came, in the order of seq
        every = F.when(F.col(f"_held.{k.lower()}").isNull(), F.col(f"_{k.lower()}")).otherwise(F.concat(F.col(f"_held.{k.lower()}"), F.col(f"_{k.lower()}")))
        columns.append((F.when(F.size(every) > 1, F.array_sort(every)).otherwise(every) if bodies else F.lit(None).cast(PARTS)).alias(k.lower()))
    status = F.when(ended, F.coalesce("_end.status", F.lit(0)))
    started, client = held_start | F.col("_start").isNotNull(), first.isNotNull() | F.col(f"_held.{SLICES[0].lower()}").isNotNull()
    deadline = F.when(F.col("_moved"), F.greatest(F.coalesce("_last", F.lit(0)), F.lit(watermark_ms)) + limit_ms).otherwise(F.col("_held.deadline"))
    outcome = F.when(~ended, "OPEN").when(~started, "ORPHAN_END").when(~client, "NO_CLIENT_REQUEST").when(status <= 0, "NO_STATUS").otherwise("COMPLETE")
    columns += [status.alias("status"), *[F.col(f"_end.{c}").alias(c) for c in END_COLUMNS], started.alias("started")]
    columns += [(F.coalesce(f"_held.{s}_fragments", F.lit(0)) + F.size(f"_{s}_body")).alias(f"{s}_fragments") for s in ("request", "response")]
    return g.select(*columns, deadline.alias("deadline"), outcome.alias("outcome"))


def _rows(spark: SparkSession, path: str, batch: int) -> DataFrame:
    return spark.read.schema(CARRIED).parquet(batch_path(f"{path}/rows", batch))


def _shown(rows: DataFrame, bodies: bool) -> DataFrame:
    """EXCHANGE_ROW (and batch, where rows have it) from CARRIED rows; what is still open then ends so."""
    outcome = F.when(F.col("outcome") == "OPEN", "IN_FLIGHT").otherwise(F.col("outcome"))
    route = F.get(F.filter("attributes", lambda a: a["name"] == "gateway.route.id"), F.lit(0))["value"]
    body = {k.lower(): F.col(k.lower())["body"] if bodies else F.lit(None).cast("array<binary>") for k in SIDES}
    made = rows.withColumns({"outcome": outcome, "start_line": F.col(f"{SLICES[0].lower()}.start_line"), "route_id": route, **body})
    return made.select(*StructType.fromDDL(EXCHANGE_ROW).names, *(["batch"] if "batch" in rows.columns else []))


def reassemble_batches(
    events: DataFrame, path: str, checkpoint: str, timeout: str = "10 minutes", watermark: str = "1 minute", bodies: bool = True,
    then: Callable[[DataFrame, int], None] | None = None, every: str | None = None,
) -> StreamingQuery:
    """Reassemble a stream of journal events under path, each batch once; `exchanges_in` reads the rows of reassemble_stream.

    Rows behind the watermark (the newest time of earlier batches less `watermark`) are dropped; put batches.late_gate
    before, where they have to be kept. What has had no event for `timeout` ends as IN_FLIGHT in the batch whose
    watermark passes that. Rows lie apart by outcome. `then` gets each batch's exchanges and number; after a crash a
    batch may come again, with its number. path has its own: one stream a folder.
    """
    limit, delay = (int(pd.Timedelta(x).total_seconds() * 1000) for x in (timeout, watermark))

    def run(df: DataFrame, batch: int) -> None:
        spark, seen, ms = df.sparkSession, Observation(), F.unix_millis("event_time")
        before = _newest(spark, path, batch)
        late = None if before is None else before - delay
        new = df.observe(seen, F.max(ms).alias("newest_ms"))
        held = None
        if batch:
            waits = F.col("deadline") >= late if late is not None else F.lit(True)
            held = _rows(spark, path, batch - 1).where((F.col("outcome") == "OPEN") & waits)
        new = new if late is None else new.where(F.coalesce(ms >= late, F.lit(True)))
        write_batch(_exchanges(_with_held(new, held), limit, max(0, late or 0), bodies), f"{path}/rows", batch, ("outcome",))
        newest = max([x for x in (before, seen.get.get("newest_ms")) if x is not None], default=None)
        ended = F.lit(False) if newest is None else F.col("deadline") < newest - delay
        write_batch(_rows(spark, path, batch).where((F.col("outcome") == "OPEN") & ended), f"{path}/ended", batch)
        if then:
            then(_shown(_rows(spark, path, batch).where("outcome <> 'OPEN'").unionByName(spark.read.schema(CARRIED).parquet(batch_path(f"{path}/ended", batch))), bodies), batch)
        write_batch(spark.createDataFrame([(newest,)], MARK).coalesce(1), f"{path}/marks", batch)
        remove(spark, f"{batch_path(f'{path}/rows', batch - 2)}/outcome=OPEN")  # a replay reads the rows of the batch before

    return poll(events.writeStream.foreachBatch(run), checkpoint, every)


def exchanges_in(spark: SparkSession, path: str, bodies: bool = True) -> DataFrame:
    """EXCHANGE_ROW and batch of all that reassemble_batches has ended under path."""
    closed = read_batches(spark, f"{path}/rows", CARRIED).where("outcome <> 'OPEN'")
    return _shown(closed.unionByName(read_batches(spark, f"{path}/ended", CARRIED)), bodies)
