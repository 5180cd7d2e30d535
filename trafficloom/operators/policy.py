"""Journal policy and privacy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exchange import col, fingerprint
from ..functions.headers import none
from ..schema import LEVELS
from .joins import expand_overrides, resolve_level

# Header names whose values may be kept, for both directions, requests and responses.
COMMON_SAFE = (
    "connection", "keep-alive", "upgrade", "te", "x-request-id", "x-correlation-id", "x-b3-traceid", "x-b3-spanid", "x-b3-parentspanid", "x-b3-sampled", "x-b3-flags", "b3",
    "traceparent", "tracestate", "date",
)
SAFE_REQUEST = COMMON_SAFE + (
    "host", "user-agent", "accept", "accept-encoding", "accept-language", "accept-charset", "content-type", "content-length", "dnt", "origin", "sec-ch-ua", "sec-ch-ua-mobile",
    "sec-ch-ua-platform", "cache-control", "pragma", "if-match", "if-none-match", "if-modified-since", "if-unmodified-since", "x-forwarded-for", "x-forwarded-proto", "x-forwarded-host",
    "x-forwarded-port", "x-real-ip", "forwarded", "via",
)
SAFE_RESPONSE = COMMON_SAFE + (
    "server", "x-powered-by", "content-type", "content-length", "content-encoding", "content-language", "content-disposition", "etag", "vary", "expires", "age", "retry-after",
    "access-control-allow-origin", "access-control-allow-methods", "access-control-allow-headers", "access-control-expose-headers", "access-control-max-age",
    "access-control-allow-credentials", "x-content-type-options", "x-ratelimit-remaining", "x-ratelimit-limit", "x-frame-options", "strict-transport-security",
)


def ordinal(level) -> Column:
    """0 (NONE) to 3 (FULL); NULL counts as NONE."""
    return F.coalesce(F.array_position(F.lit(list(LEVELS)), col(level)).cast("int") - 1, F.lit(0))


def effective_level(request="request_level", response="response_level") -> Column:
    """The request's level; METADATA if only the response is journaled. NONE: the row isn't kept."""
    return F.when((ordinal(request) <= 0) & (ordinal(response) > 0), "METADATA").otherwise(F.coalesce(col(request), F.lit("NONE")))


def is_kept(*levels) -> Column:
    """Any of the levels is METADATA or more."""
    return F.greatest(*[ordinal(x) for x in levels]) >= 1


def redact_headers(pairs, level, side: str) -> Column:
    """METADATA and NONE keep no headers; else names on the side's list keep their value, others a fingerprint."""
    safe = F.lit(list(SAFE_REQUEST if side == "request" else SAFE_RESPONSE))
    treated = F.transform(F.coalesce(col(pairs), none()), lambda h: F.when(F.array_contains(safe, F.lower(h["name"])), h).otherwise(F.struct(h["name"].alias("name"), fingerprint(h["value"]).alias("value"))))
    return F.when(ordinal(level) <= 1, none()).otherwise(treated)


def apply_policy(exchanges: DataFrame, policy: DataFrame) -> DataFrame:
    """Kept exchanges with slices at their resolved levels, redacted headers, and bodies only at FULL."""
    e = resolve_level(exchanges, policy)
    e = e.where(is_kept("request_base", "response_base", "request_level", "response_level")).withColumn("_request", effective_level()).where("_request <> 'NONE'")
    out = {}
    for name in ("client_request", "upstream_request"):
        c = F.col(name)
        out[name] = F.when(c.isNotNull(), F.struct(F.col("_request").alias("level"), c["start_line"].alias("start_line"), redact_headers(c["headers"], "_request", "request").alias("headers")))
    for name in ("upstream_response", "client_response"):
        c = F.col(name)
        out[name] = F.when(c.isNotNull() & (ordinal("response_level") > 0), F.struct(F.col("response_level").alias("level"), c["status"].alias("status"), c["start_line"].alias("start_line"), redact_headers(c["headers"], "response_level", "response").alias("headers")))
    empty = F.array().cast("array<binary>")
    out["request_body"] = F.when(F.col("request_base") == "FULL", F.col("request_body")).otherwise(empty)
    out["response_body"] = F.when((F.col("response_base") == "FULL") & (F.col("response_level") == "FULL"), F.col("response_body")).otherwise(empty)
    return e.withColumns(out).drop("_request")


def validate_policy(policy: DataFrame) -> DataFrame:
    """(route_id, direction, status, problem): STATUS_BELOW_100, or FULL_OVER_LOWER_BASE."""
    bases = policy.groupBy("route_id", "direction").agg(F.max("base_level").alias("base"))
    each = expand_overrides(policy).join(bases, ["route_id", "direction"], "left")
    problems = F.array(F.when(F.col("status") < 100, "STATUS_BELOW_100"), F.when((F.col("level") == "FULL") & (F.coalesce("base", F.lit("NONE")) != "FULL"), "FULL_OVER_LOWER_BASE"))
    return each.select("route_id", "direction", "status", F.explode(F.filter(problems, lambda x: x.isNotNull())).alias("problem"))
