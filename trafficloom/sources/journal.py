"""Journal sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import exchange as X
from ..functions import headers as H
from ..operators.assemble import joined
from ..schema import EVENT_SCHEMA


def write_events(events: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Partitioned by shard and day, so scans of either are pruned.

    Rows are rebalanced on both first: without that every task writes a file of its own for every shard
    and day. Adaptive execution splits a shard's day that is too large for one task.
    """
    dated = events.withColumn("date", F.to_date("event_time"))
    dated.hint("rebalance", "shard", "date").write.mode(mode).partitionBy("shard", "date").parquet(path)


def read_events(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Events under the explicit schema; rows of a text format that don't fit it go to `_bad`."""
    if fmt == "json":
        return spark.read.schema(f"{EVENT_SCHEMA}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    return spark.read.schema(f"{EVENT_SCHEMA}, date date").format(fmt).load(path)


def quarantine(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, text of the bad ones) of a JSON scan."""
    return events.where("_bad is null").drop("_bad"), events.where("_bad is not null").select("_bad")


def retention(segments: DataFrame, now: Column, min_age_s: int) -> DataFrame:
    """Segments that may be deleted: read to their end, and last modified at least min_age_s ago."""
    age = F.unix_timestamp(now) - F.unix_timestamp("modified")
    return segments.where((age >= min_age_s) & (F.col("read_bytes") >= F.col("size")))


def segment_catalog(paths: DataFrame, name: str = "file_name") -> DataFrame:
    """shard-<id>-<millis>-<rotation> names taken apart; one row per segment, whatever its extension.

    Malformed names have (0, 0, 0). Of several files of a segment the name without further extensions
    (the shortest, then the first) is kept.
    """
    base = F.element_at(F.split(F.col(name), "/"), -1)
    key = F.get(F.split(base, r"\."), F.lit(0))
    parts = F.split(key, "-")
    numbers = [F.get(parts, F.lit(i)).try_cast("bigint") for i in (1, 2, 3)]
    good = (F.size(parts) == 4) & (F.get(parts, F.lit(0)) == "shard") & numbers[0].isNotNull() & numbers[1].isNotNull() & numbers[2].isNotNull()
    made = paths.withColumns({"segment": key, **{c: F.when(good, n).otherwise(F.lit(0).cast("bigint")) for c, n in zip(("shard", "timestamp", "rotation"), numbers)}})
    first = Window.partitionBy("segment").orderBy(F.length(name), name)
    return made.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def _sparse(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _number(name: str) -> Column:
    return F.nullif(F.col(name), F.lit(0).cast("bigint")).alias(name)


def _headers(slice_: str) -> Column:
    c = F.col(f"{slice_}.headers")
    return F.when(F.size(F.coalesce(c, H.none())) > 0, H.pairs_to_map(c))


def to_flat_rows(exchanges: DataFrame) -> DataFrame:
    """One flat, sparse row per exchange: what is empty or zero is NULL, and is left out as JSON.

    response_*_bytes hold the response's counts.
    """
    e = H.with_gateway_attributes(exchanges) if "route_id" not in exchanges.columns else exchanges
    level = lambda s: F.when(F.col(f"{s}.level") != "NONE", F.col(f"{s}.level")).alias(f"{s}_level")
    columns = [F.col("req_id").alias("gateway_request_id"), F.col("client_start_ns").alias("timestamp"), X.duration_s().alias("duration")]
    columns += [level(s) for s in ("client_request", "upstream_request", "upstream_response", "client_response")]
    for side in ("client", "upstream"):
        line = X.split_start_line(f"{side}_request.start_line")
        headers = F.col(f"{side}_request.headers")
        columns += [line["method"].alias(f"{side}_method"), line["path"].alias(f"{side}_path"), _headers(f"{side}_request").alias(f"{side}_request_headers"),
                    _sparse(H.header_first(headers, "Host")).alias(f"{side}_host"), _sparse(H.header_first(headers, "User-Agent")).alias(f"{side}_user_agent")]
    for side in ("upstream", "client"):
        columns += [_headers(f"{side}_response").alias(f"{side}_response_headers"), _sparse(H.header_first(F.col(f"{side}_response.headers"), "Content-Type")).alias(f"{side}_content_type")]
    columns += [F.col("status"), X.is_error().cast("int").alias("is_error"), *map(_number, ("request_header_bytes", "request_body_bytes", "response_header_bytes", "response_body_bytes"))]
    columns += [F.nullif(F.col(f"{s}_crc"), F.lit(0).cast("bigint")).alias(f"{s}_crc32") for s in ("request", "response")]
    body = lambda c: F.when(F.size(c) > 0, F.base64(joined(c))).alias(c)
    columns += [body("request_body"), body("response_body"), F.when(F.size(F.coalesce(F.col("attributes"), H.none())) > 0, H.pairs_to_map("attributes")).alias("attributes")]
    return e.select(*columns)


def write_flat(exchanges: DataFrame, path: str) -> None:
    to_flat_rows(exchanges).write.option("ignoreNullFields", "true").json(path)


def _iso(ns: str) -> Column:
    return F.date_format(X.utc_micros(ns), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def _seconds(c: Column) -> Column:
    return F.format_string("%.6f", c)


def _node(side: str) -> Column:
    request, response = F.col(f"{side}_request"), F.col(f"{side}_response")
    line = X.split_start_line(request["start_line"], strict=True)
    return F.struct(
        F.coalesce(request["level"], F.lit("NONE")).alias("request_journal_level"), line["method"].alias("method"), line["path"].alias("path"), H.pairs_to_map(request["headers"]).alias("request_headers"),
        F.coalesce(response["level"], F.lit("NONE")).alias("response_journal_level"), H.pairs_to_map(response["headers"]).alias("response_headers"), H.header_first(response["headers"], "Content-Type").alias("content_type"),
    )


def to_audit_rows(exchanges: DataFrame) -> DataFrame:
    """One nested row per exchange, with ISO times, six-decimal seconds, Base64 bodies and explicit nulls."""
    proxied = X.was_proxied()
    body = lambda c: F.when(F.size(c) > 0, F.base64(joined(c))).alias(c)
    return exchanges.select(
        F.col("req_id").alias("gateway_request_id"), F.col("client_ip").alias("remote_address"), F.col("client_ip_source").alias("remote_address_source"),
        _iso("client_start_ns").alias("start"), _seconds(X.duration_s()).alias("duration"), _iso("client_end_ns").alias("end"), proxied.alias("was_proxied"),
        F.when(proxied, _iso("proxy_start_ns")).alias("proxy_start"), F.when(proxied, _iso("proxy_end_ns")).alias("proxy_end"), F.when(proxied, _seconds(X.proxy_duration_s())).alias("proxy_duration"),
        "status", X.is_error().alias("is_error"), "request_header_bytes", "request_body_bytes", X.total_bytes("request").alias("request_total_bytes"), "response_header_bytes", "response_body_bytes",
        X.total_bytes("response").alias("response_total_bytes"), _node("client").alias("client"), F.when(proxied, _node("upstream")).alias("upstream"), body("request_body"), body("response_body"), H.pairs_to_map("attributes").alias("attributes"),
    )


def write_audit(exchanges: DataFrame, path: str) -> None:
    to_audit_rows(exchanges).write.option("ignoreNullFields", "false").json(path)


KEEP = 8  # versions of a snapshot that stay readable


def _files(spark: SparkSession, path: str):
    """(file system, path) of a path, as Spark's own readers find them."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _files(spark, path)
    return fs.exists(where)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder with all that it holds, if there is one."""
    fs, where = _files(spark, path)
    fs.delete(where, True)


def _numbers(spark: SparkSession, path: str) -> list[int]:
    """Numbers that name the entries of a folder, ascending; none where there is no such folder."""
    fs, where = _files(spark, path)
    return sorted(int(x.getPath().getName()) for x in fs.listStatus(where)) if fs.exists(where) else []


def write_snapshot(df: DataFrame, path: str, keep: int = KEEP) -> int:
    """Write a new version, then point to it; readers see the old version or the new, never a part.

    Versions are numbered one after the other. A pointer is an empty file named by its version, so the newest
    is found by name alone; versions and pointers before the last `keep` are removed, so neither grows and a
    flush lists at most keep + 1 names. One writer at a time: two that take one number are an error for the
    second. A version that a crash left without a pointer is never read, and goes with the others.
    """
    spark = df.sparkSession
    versions = _numbers(spark, f"{path}/versions")
    number = max([0, *versions[-1:], *_numbers(spark, f"{path}/pointer")[-1:]]) + 1
    df.write.parquet(f"{path}/versions/{number:012d}")
    fs, pointer = _files(spark, f"{path}/pointer/{number:012d}")
    fs.create(pointer, False).close()
    for old in _numbers(spark, f"{path}/pointer")[:-keep]:  # pointers first: none may outlive its version
        fs.delete(_files(spark, f"{path}/pointer/{old:012d}")[1], False)
    for old in versions:
        if old <= number - keep:
            fs.delete(_files(spark, f"{path}/versions/{old:012d}")[1], True)
    return number


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The newest version that has a pointer."""
    found = _numbers(spark, f"{path}/pointer")
    if not found:
        raise ValueError(f"no snapshot under {path}")
    return spark.read.parquet(f"{path}/versions/{found[-1]:012d}")
