"""One definition of gateway traffic over the `events` table, for Spark and for the SQL oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schema import EVENT_SCHEMA
from .workers import prepare


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pairs(*items: tuple[str, Column, Column | None]) -> Column:
    """Header pairs in order; an item whose condition isn't true is left out."""
    made = [F.struct(F.lit(n).alias("name"), v.cast("string").alias("value")) for n, v, _ in items]
    return F.filter(F.array(*[m if c is None else F.when(c, m) for m, (_, _, c) in zip(made, items)]), lambda p: p.isNotNull())


def traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per exchange: times, sizes, status, addresses, headers."""
    return traffic_of(read(spark, sf_dir, "events"))


def address4() -> Column:
    """An IPv4 address of the user, for questions about networks: client_ip where that is one. From user 65,536 on its third number is above 255, so 255 stands there."""
    return F.expr("concat('10.', user_id % 4, '.', least(user_id div 256, 255), '.', user_id % 256)")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The `events` table as a stream of its files."""
    # a pattern, since a stream of a plain path wants a folder
    return spark.readStream.schema(read(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")


def traffic_of(e: DataFrame) -> DataFrame:
    """Traffic columns over rows of the `events` table, a batch or a stream."""
    k = F.get_json_object("props", "$.k").cast("int")
    start = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    duration = F.round(F.col("value") * 1_000_000).cast("bigint")
    e = e.select("event_id", "user_id", F.col("event_type").alias("route_id"), "value", k.alias("k"), start.alias("client_start_ns"), duration.alias("duration_ns"))
    status = F.expr(
        "case when route_id = 'error' then case k % 4 when 0 then 500 when 1 then 502 when 2 then 429 else 404 end "
        "when k % 10 = 0 then 304 when route_id = 'signup' then 201 else 200 end"
    )
    e = e.withColumns({
        "req_id": F.concat(F.lit("req-"), F.col("event_id")),
        "client_end_ns": F.col("client_start_ns") + F.col("duration_ns"),
        "method": F.expr("case k % 4 when 0 then 'GET' when 1 then 'POST' when 2 then 'PUT' else 'OPTIONS' end"),
        "path": F.concat(F.lit("/"), F.col("route_id"), F.lit("/"), F.col("user_id"), F.lit("/"), F.col("k")),
        "status": status,
        "client_ip": F.expr("concat('10.', user_id % 4, '.', user_id div 256, '.', user_id % 256)"),
    })
    proxied, tenth = F.col("status") != 429, F.expr("duration_ns div 10")
    e = e.withColumns({
        "proxy_start_ns": F.when(proxied, F.col("client_start_ns") + tenth).otherwise(F.lit(-1).cast("bigint")),
        "proxy_end_ns": F.when(proxied, F.col("client_end_ns") - tenth).otherwise(F.lit(-1).cast("bigint")),
        "targets": F.expr("case when status = 502 then array(concat('http://up-', k % 3), concat('http://up-', (k + 1) % 3)) else array(concat('http://up-', k % 3)) end"),
        "short_circuit": F.when(~proxied, F.lit("RateLimiter")),
        "request_header_bytes": (100 + F.length("path")).cast("bigint"),
        "request_body_bytes": F.expr("cast(case when method in ('POST', 'PUT') then k * 10 else 0 end as bigint)"),
        "response_header_bytes": F.lit(200).cast("bigint"),
        "response_body_bytes": F.floor(F.col("value") * 100).cast("bigint"),
    })
    k = F.col("k")
    headers = pairs(
        ("Host", F.concat("route_id", F.lit(".example.com:8080")), None),
        ("Authorization", F.concat(F.lit("Bearer "), F.col("user_id")), k % 5 != 0),
        ("Origin", F.concat(F.lit("https://app"), k % 3, F.lit(".example.com")), k % 7 == 0),
        ("Content-Length", F.col("request_body_bytes"), F.col("method").isin("POST", "PUT")),
        ("X-Forwarded-For", F.concat("client_ip", F.lit(", 10.9.9.9")), k % 3 == 0),
        ("Accept", F.lit("text/html"), k % 4 == 0),
        ("accept", F.lit("application/json"), k % 4 == 0),
        ("Accept", F.lit("*/*"), k % 8 == 0),
    )
    return e.withColumn("headers", headers)


#: The same rows in DuckDB: a CTE named t.
TRAFFIC_SQL = """t AS (
  SELECT * EXCLUDE (proxied_, tenth_),
    CASE WHEN proxied_ THEN client_start_ns + tenth_ ELSE -1 END AS proxy_start_ns, CASE WHEN proxied_ THEN client_end_ns - tenth_ ELSE -1 END AS proxy_end_ns,
    CASE WHEN status = 502 THEN ['http://up-' || (k % 3), 'http://up-' || ((k + 1) % 3)] ELSE ['http://up-' || (k % 3)] END AS targets,
    CASE WHEN NOT proxied_ THEN 'RateLimiter' END AS short_circuit,
    CAST(100 + length(path) AS BIGINT) AS request_header_bytes, CAST(200 AS BIGINT) AS response_header_bytes, CAST(floor(value * 100) AS BIGINT) AS response_body_bytes,
    list_filter([{'name': 'Host', 'value': route_id || '.example.com:8080'},
      CASE WHEN k % 5 <> 0 THEN {'name': 'Authorization', 'value': 'Bearer ' || user_id} END,
      CASE WHEN k % 7 = 0 THEN {'name': 'Origin', 'value': 'https://app' || (k % 3) || '.example.com'} END,
      CASE WHEN method IN ('POST', 'PUT') THEN {'name': 'Content-Length', 'value': CAST(request_body_bytes AS VARCHAR)} END,
      CASE WHEN k % 3 = 0 THEN {'name': 'X-Forwarded-For', 'value': client_ip || ', 10.9.9.9'} END,
      CASE WHEN k % 4 = 0 THEN {'name': 'Accept', 'value': 'text/html'} END,
      CASE WHEN k % 4 = 0 THEN {'name': 'accept', 'value': 'application/json'} END,
      CASE WHEN k % 8 = 0 THEN {'name': 'Accept', 'value': '*/*'} END], lambda h: h IS NOT NULL) AS headers
  FROM (SELECT *, status <> 429 AS proxied_, duration_ns // 10 AS tenth_, CAST(CASE WHEN method IN ('POST', 'PUT') THEN k * 10 ELSE 0 END AS BIGINT) AS request_body_bytes
    FROM (SELECT *, client_start_ns + duration_ns AS client_end_ns, 'req-' || event_id AS req_id, '/' || route_id || '/' || user_id || '/' || k AS path,
        CASE k % 4 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' WHEN 2 THEN 'PUT' ELSE 'OPTIONS' END AS method,
        CASE WHEN route_id = 'error' THEN CASE k % 4 WHEN 0 THEN 500 WHEN 1 THEN 502 WHEN 2 THEN 429 ELSE 404 END WHEN k % 10 = 0 THEN 304 WHEN route_id = 'signup' THEN 201 ELSE 200 END AS status,
        '10.' || (user_id % 4) || '.' || (user_id // 256) || '.' || (user_id % 256) AS client_ip
      FROM (SELECT event_id, user_id, event_type AS route_id, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
          epoch_us(ts) * 1000 AS client_start_ns, CAST(round(value * 1000000) AS BIGINT) AS duration_ns FROM events))))"""

#: Rendering of header pairs as text, the same in both engines.
HEADERS_TEXT_SQL = "array_to_string(list_transform({0}, lambda h: h.name || '=' || h.value), ';')"


def headers_text(column) -> Column:
    return F.array_join(F.transform(column, lambda h: F.concat(h["name"], F.lit("="), h["value"])), ";")


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Journal events of the traffic, in EVENT_SCHEMA, with gaps: some requests, ends and statuses are missing."""
    return journal_of(traffic(spark, sf_dir))


def journal_of(t: DataFrame) -> DataFrame:
    attributes = F.concat(
        pairs(("gateway.route.id", F.col("route_id"), None)),
        F.when(F.col("proxy_start_ns") != -1, F.transform("targets", lambda x: F.struct(F.lit("gateway.target").alias("name"), x.alias("value")))).otherwise(F.expr("cast(array() as array<struct<name: string, value: string>>)")),
        pairs(("gateway.shortcircuit.name", F.col("short_circuit"), F.col("short_circuit").isNotNull())),
    )
    n, proxied = F.col("event_id"), F.col("proxy_start_ns") != -1
    kinds = [
        ("CLIENT_REQUEST", 0, n % 97 != 0), ("UPSTREAM_REQUEST", 1, proxied), ("REQUEST_BODY", 2, F.col("request_body_bytes") > 0), ("REQUEST_BODY", 3, F.col("request_body_bytes") > 300),
        ("UPSTREAM_RESPONSE", 4, proxied), ("RESPONSE_BODY", 5, F.lit(True)), ("CLIENT_RESPONSE", 6, F.lit(True)), ("END", 7, n % 89 != 0),
    ]
    parts = F.filter(F.array(*[F.when(c, F.struct(F.lit(kind).alias("event_type"), F.lit(i).alias("i"))) for kind, i, c in kinds]), lambda x: x.isNotNull())
    rows = t.select("*", attributes.alias("attributes"), F.explode(parts).alias("part")).select("*", "part.event_type", "part.i")
    kind = F.col("event_type")
    slice_, end = kind.isin("CLIENT_REQUEST", "UPSTREAM_REQUEST", "UPSTREAM_RESPONSE", "CLIENT_RESPONSE"), kind == "END"
    status = F.when(n % 83 == 0, 0).otherwise(F.col("status"))
    body = F.concat(kind, F.lit(":"), F.col("event_id"), F.lit(":"), F.col("i"))
    values = {
        "seq": n * 10 + F.col("i"), "event_time": F.timestamp_micros(F.expr("client_start_ns div 1000")), "shard": F.pmod(n, F.lit(4)),
        "journal_level": F.when(slice_, F.when(F.col("k") % 2 == 0, "FULL").otherwise("HEADERS")),
        "start_line": F.when(kind.endswith("REQUEST"), F.concat_ws(" ", "method", "path", F.lit("HTTP/1.1"))).when(kind.endswith("RESPONSE"), F.concat(F.lit("HTTP/1.1 "), F.col("status"))),
        "headers": F.when(kind.endswith("REQUEST"), F.col("headers")).when(kind.endswith("RESPONSE"), pairs(("Content-Type", F.lit("text/plain"), None), ("Server", F.lit("edge"), F.col("k") % 2 == 0))),
        "status": F.when(kind.endswith("RESPONSE") | end, status), "client_ip": F.when(kind == "CLIENT_REQUEST", F.col("client_ip")),
        "client_ip_source": F.when(kind == "CLIENT_REQUEST", F.when(F.col("k") % 3 == 0, "X_FORWARDED_FOR").otherwise("SOCKET")),
        "body": F.when(kind.endswith("BODY"), body.cast("binary")), "proxy_first_byte_ns": F.when(end, F.lit(-1)),
        "request_crc": F.when(end, F.crc32(F.lit("").cast("binary"))), "response_crc": F.when(end, F.crc32(F.concat(F.lit("RESPONSE_BODY:"), F.col("event_id"), F.lit(":5")).cast("binary"))),
        **{c: F.when(end, F.col(c)) for c in ("client_start_ns", "client_end_ns", "proxy_start_ns", "proxy_end_ns", "request_header_bytes", "request_body_bytes", "response_header_bytes", "response_body_bytes", "attributes")},
    }
    made = rows.select("req_id", "event_type", *[v.alias(c) for c, v in values.items()])
    wanted = T.StructType.fromDDL(EVENT_SCHEMA)
    return made.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in wanted])

#: The journal in DuckDB: CTEs t and v (without bodies' bytes: body is text).
JOURNAL_SQL = TRAFFIC_SQL + """, v AS (
  SELECT req_id, event_id * 10 + i AS seq, kind AS event_type, client_start_ns // 1000 AS event_us, CAST(event_id % 4 AS INTEGER) AS shard,
    CASE WHEN kind LIKE '%REQUEST' OR kind LIKE '%RESPONSE' THEN CASE WHEN k % 2 = 0 THEN 'FULL' ELSE 'HEADERS' END END AS journal_level,
    CASE WHEN kind LIKE '%REQUEST' THEN method || ' ' || path || ' HTTP/1.1' WHEN kind LIKE '%RESPONSE' THEN 'HTTP/1.1 ' || status END AS start_line,
    CASE WHEN kind LIKE '%RESPONSE' OR kind = 'END' THEN CASE WHEN event_id % 83 = 0 THEN 0 ELSE status END END AS status,
    CASE WHEN kind = 'CLIENT_REQUEST' THEN client_ip END AS client_ip, CASE WHEN kind = 'CLIENT_REQUEST' THEN CASE WHEN k % 3 = 0 THEN 'X_FORWARDED_FOR' ELSE 'SOCKET' END END AS client_ip_source,
    CASE WHEN kind LIKE '%BODY' THEN kind || ':' || event_id || ':' || i END AS body, t.* EXCLUDE (req_id, status, client_ip)
  FROM t, (VALUES ('CLIENT_REQUEST', 0), ('UPSTREAM_REQUEST', 1), ('REQUEST_BODY', 2), ('REQUEST_BODY', 3), ('UPSTREAM_RESPONSE', 4), ('RESPONSE_BODY', 5), ('CLIENT_RESPONSE', 6), ('END', 7)) AS x(kind, i)
  WHERE CASE i WHEN 0 THEN event_id % 97 <> 0 WHEN 1 THEN proxy_start_ns <> -1 WHEN 2 THEN request_body_bytes > 0 WHEN 3 THEN request_body_bytes > 300 WHEN 4 THEN proxy_start_ns <> -1 WHEN 7 THEN event_id % 89 <> 0 ELSE true END),
x AS (SELECT t.*, CASE WHEN event_id % 83 = 0 THEN 0 ELSE status END AS end_status FROM t WHERE event_id % 97 <> 0 AND event_id % 89 <> 0 AND event_id % 83 <> 0)"""


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Health observations (target, ts, ok); event_id breaks ties of ts."""
    return read(spark, sf_dir, "events").select("event_id", F.expr("concat('up-', user_id % 3)").alias("target"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") != "error").alias("ok"))


PROBES_SQL = "p AS (SELECT event_id, 'up-' || (user_id % 3) AS target, epoch_us(ts) AS us, event_type <> 'error' AS ok FROM events)"
