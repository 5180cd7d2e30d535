"""Journal events to exchanges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.crc import crc32c_of_parts
from ..schema import END_COLUMNS
from ..workers import prepare

SLICES = ("CLIENT_REQUEST", "UPSTREAM_REQUEST", "UPSTREAM_RESPONSE", "CLIENT_RESPONSE")
ANOMALIES = ("ORPHAN_END", "BODY_WITHOUT_START", "NO_CLIENT_REQUEST", "NO_STATUS", "IN_FLIGHT")


def sequence_events(events: DataFrame) -> DataFrame:
    """events with `generation`: how many ENDs of the id came before (an id may be used again)."""
    before = Window.partitionBy("req_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("generation", F.coalesce(F.sum((F.col("event_type") == "END").cast("int")).over(before), F.lit(0)))


def _grouped(events: DataFrame, bodies: bool = True, slices: Sequence[str] = SLICES, headers: bool = True) -> DataFrame:
    """One row per id and generation, complete or not.

    Every aggregate stands alone, so Catalyst drops those that nobody reads, with their columns. A
    generation has one END at most, so a maximum or first value over ENDs is that END's value.
    """
    def of(kind: str, aggregate: str) -> str:
        return f"{aggregate} filter (where event_type = '{kind}')"

    aggs = {k.lower(): of(k, f"max_by(struct(journal_level, {'status, ' if k.endswith('RESPONSE') else ''}start_line{', headers' if headers else ''}), seq)") for k in slices}
    aggs["_address"] = of("CLIENT_REQUEST", "max_by(struct(client_ip, client_ip_source), seq)")
    aggs |= {f"_end_{c}": of("END", f"max({c})") for c in ("status", *END_COLUMNS) if c != "attributes"}
    aggs["_end_attributes"] = of("END", "first(attributes)")
    aggs |= {"_has_end": "bool_or(event_type = 'END')", "_has_client": "bool_or(event_type = 'CLIENT_REQUEST')"}
    # a fragment counts only after the first metadata event of its generation
    aggs["_start"] = f"min(seq) filter (where event_type in {SLICES})"
    aggs["_first_body"] = "min(seq) filter (where event_type in ('REQUEST_BODY', 'RESPONSE_BODY'))"
    if bodies:
        aggs |= {f"_{s.lower()}_body": f"array_sort({of(f'{s}_BODY', 'collect_list(struct(seq, body))')})" for s in ("REQUEST", "RESPONSE")}
    aggs = [F.expr(text).alias(name) for name, text in aggs.items()]
    return sequence_events(events).groupBy("req_id", "generation").agg(*aggs)


def reassemble(events: DataFrame, bodies: bool = True, slices: Sequence[str] = SLICES, headers: bool = True) -> DataFrame:
    """Complete exchanges: an END, a client request and a status above 0. One shuffle, on req_id.

    Each slice is the last one written; fragments stay in order; END supplies status, times, bytes
    and attributes. With bodies=False fragments are left out by the scan. slices names the slices that
    the result has; events of others are left out by the scan too, so metrics, which read what END
    supplies alone, take slices=(). With headers=False a slice has no header pairs, which the scan leaves out.
    """
    if unknown := set(slices) - set(SLICES):
        raise ValueError(f"unknown slices: {sorted(unknown)}")
    first = set() if not bodies else set(SLICES)  # a fragment's place is judged by all slices
    kinds = sorted({"CLIENT_REQUEST", "END", *slices, *first, *(("REQUEST_BODY", "RESPONSE_BODY") if bodies else ())})
    events = events.where(F.col("event_type").isin(kinds))
    g = _grouped(events if bodies else events.drop("body"), bodies, slices, headers)
    g = g.where(F.col("_has_end") & F.col("_has_client") & (F.col("_end_status") > 0))
    made = []
    for kind in (k for k in SLICES if k in slices):
        c = F.col(kind.lower())
        status = [c["status"].alias("status")] if kind.endswith("RESPONSE") else []
        fields = [c["journal_level"].alias("level"), *status, c["start_line"].alias("start_line"), *([c["headers"].alias("headers")] if headers else [])]
        made.append(F.when(c.isNotNull(), F.struct(*fields)).alias(kind.lower()))
    made += [F.col(f"_address.{c}").alias(c) for c in ("client_ip", "client_ip_source")]
    if bodies:
        for s in ("request", "response"):
            made.append(F.transform(F.filter(f"_{s}_body", lambda x: x["seq"] > F.col("_start")), lambda x: x["body"]).alias(f"{s}_body"))
    return g.select("req_id", "generation", *made, *[F.col(f"_end_{c}").alias(c) for c in ("status", *END_COLUMNS)])


def anomalies(events: DataFrame) -> DataFrame:
    """req_id, generation, anomaly of every group that reassemble leaves out or takes fragments from."""
    g = _grouped(events.drop("body"), bodies=False, slices=())
    end, start, client = F.col("_has_end"), F.col("_start").isNotNull(), F.col("_has_client")
    kinds = F.array(
        F.when(end & ~start, "ORPHAN_END"),
        F.when(F.col("_first_body") < F.coalesce("_start", F.lit(2**62)), "BODY_WITHOUT_START"),
        F.when(end & start & ~client, "NO_CLIENT_REQUEST"),
        F.when(end & client & ~F.coalesce(F.col("_end_status") > 0, F.lit(False)), "NO_STATUS"),
        F.when(~end, "IN_FLIGHT"),
    )
    return g.select("req_id", "generation", F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("anomaly"))


def journal_summary(exchanges: DataFrame) -> DataFrame:
    return exchanges.agg(F.count("*").alias("exchanges"), F.coalesce(F.sum(F.col("request_header_bytes") + F.col("request_body_bytes")), F.lit(0)).alias("request_bytes"))


def dedupe_events(events: DataFrame) -> DataFrame:
    """Events that a tailer may have read twice after a crash, once each."""
    return events.dropDuplicates(["req_id", "seq"])


def joined(parts: str) -> Column:
    """The binary values of an array, one after the other, in time that follows their length."""
    return F.unhex(F.array_join(F.transform(parts, F.hex), ""))


def body_integrity(exchanges: DataFrame, algo: str = "crc32") -> DataFrame:
    """Per exchange and direction: bytes journaled against bytes declared, checksum against checksum.

    Verdicts: NOT_CAPTURED (no fragment), LENGTH, CHECKSUM, OK. algo is crc32 or crc32c.
    """
    prepare(exchanges.sparkSession)
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{s}_body").alias("parts"), F.col(f"{s}_body_bytes").alias("declared"), F.col(f"{s}_crc").alias("crc")) for s in ("request", "response")])).alias("s")
    each = exchanges.select("req_id", sides).select("req_id", "s.*")
    captured = F.aggregate("parts", F.lit(0).cast("bigint"), lambda n, part: n + F.coalesce(F.octet_length(part), F.lit(0)))
    each = each.withColumn("captured", captured).withColumn("checksum", F.crc32(joined("parts")) if algo == "crc32" else crc32c_of_parts("parts"))
    verdict = F.when(F.size("parts") == 0, F.when(F.col("declared") == 0, "OK").otherwise("NOT_CAPTURED")).when(F.col("captured") != F.col("declared"), "LENGTH").when(F.col("checksum") != F.col("crc"), "CHECKSUM").otherwise("OK")
    return each.select("req_id", "side", "captured", "declared", verdict.alias("verdict"))
