"""Derived exchange columns: timings, sizes, status, start lines, ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Reason phrases by status code.
REASONS = {
    200: "OK", 201: "Created", 202: "Accepted", 204: "No Content", 301: "Moved Permanently", 302: "Found", 304: "Not Modified", 400: "Bad Request", 401: "Unauthorized",
    403: "Forbidden", 404: "Not Found", 405: "Method Not Allowed", 409: "Conflict", 429: "Too Many Requests", 500: "Internal Server Error", 501: "Not Implemented",
    502: "Bad Gateway", 503: "Service Unavailable", 504: "Gateway Timeout",
}
# The alphabet of Base58, in the order of its digits.
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
IPV4 = r"^(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(\.(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}$"
IPV6 = (
    r"^(([0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}|([0-9a-fA-F]{1,4}:){1,7}:|([0-9a-fA-F]{1,4}:){1,6}:[0-9a-fA-F]{1,4}|([0-9a-fA-F]{1,4}:){1,5}(:[0-9a-fA-F]{1,4}){1,2}"
    r"|([0-9a-fA-F]{1,4}:){1,4}(:[0-9a-fA-F]{1,4}){1,3}|([0-9a-fA-F]{1,4}:){1,3}(:[0-9a-fA-F]{1,4}){1,4}|([0-9a-fA-F]{1,4}:){1,2}(:[0-9a-fA-F]{1,4}){1,5}"
    r"|[0-9a-fA-F]{1,4}:(:[0-9a-fA-F]{1,4}){1,6}|:((:[0-9a-fA-F]{1,4}){1,7}|:))$"
)


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def duration_s(start_ns="client_start_ns", end_ns="client_end_ns") -> Column:
    return (col(end_ns) - col(start_ns)) / F.lit(1e9)


def was_proxied(proxy_start_ns="proxy_start_ns") -> Column:
    return F.coalesce(col(proxy_start_ns) != -1, F.lit(False))


def proxy_duration_s(start_ns="proxy_start_ns", end_ns="proxy_end_ns") -> Column:
    return F.when(was_proxied(start_ns), duration_s(start_ns, end_ns))


def first_byte_s(proxy_start_ns="proxy_start_ns", first_byte_ns="proxy_first_byte_ns") -> Column:
    return (F.nullif(col(first_byte_ns), F.lit(-1)) - F.nullif(col(proxy_start_ns), F.lit(-1))) / F.lit(1e9)


def total_bytes(side: str) -> Column:
    """side: request or response."""
    return F.col(f"{side}_header_bytes") + F.col(f"{side}_body_bytes")


def is_error(status="status") -> Column:
    return col(status) >= 400


def status_class(status="status") -> Column:
    """'1xx' to '5xx'; NULL outside 100-599."""
    s = col(status)
    return F.when(s.between(100, 599), F.concat(F.floor(s / 100).cast("string"), F.lit("xx")))


def reason_phrase(status="status") -> Column:
    table = F.create_map(*[F.lit(x) for pair in REASONS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, col(status).cast("int")), F.lit("Unknown"))


def utc_micros(ns) -> Column:
    """Timestamp in microseconds of an epoch-nanosecond column."""
    return F.timestamp_micros(F.call_function("div", col(ns), F.lit(1000)))


def split_start_line(line="start_line", strict: bool = False) -> Column:
    """struct(method, path). strict cuts at single blanks, else at runs of white space (blank: NULL)."""
    c = col(line)
    if strict:
        parts = F.split(c, " ")
        method = F.get(parts, F.lit(0))
        # a last part that is empty is not written
        path = F.when(F.size(parts) > 2, F.get(parts, F.lit(1))).otherwise(F.nullif(F.get(parts, F.lit(1)), F.lit("")))
        return F.struct(F.when((F.size(parts) == 1) & (method == ""), None).otherwise(method).alias("method"), path.alias("path"))
    parts = F.split(F.nullif(F.regexp_replace(c, r"\s+$", ""), F.lit("")), r"\s+")
    return F.struct(F.nullif(F.get(parts, F.lit(0)), F.lit("")).alias("method"), F.nullif(F.get(parts, F.lit(1)), F.lit("")).alias("path"))


def request_line(method="method", uri="path") -> Column:
    return F.concat(col(method), F.lit(" "), col(uri), F.lit(" HTTP/1.1"))


def status_line(status="status") -> Column:
    return F.concat(F.lit("HTTP/1.1 "), col(status).cast("string"), F.lit(" "), reason_phrase(status))


def _header_bytes(pairs: Column) -> Column:
    return F.aggregate(F.coalesce(pairs, F.array().cast("array<struct<name: string, value: string>>")), F.lit(0).cast("bigint"), lambda n, h: n + F.length(h["name"]) + F.length(h["value"]) + 4)


def request_head_bytes(method="method", uri="path", query=None, protocol=None, pairs="headers") -> Column:
    """Bytes of a request head on the wire: request line, headers, empty line."""
    q = F.lit(0) if query is None else F.when(F.coalesce(F.length(col(query)), F.lit(0)) > 0, 1 + F.length(col(query))).otherwise(0)
    p = F.lit("HTTP/1.1") if protocol is None else col(protocol)
    return (F.length(col(method)) + 1 + F.length(col(uri)) + q + 1 + F.length(p) + 2 + _header_bytes(col(pairs)) + 2).cast("bigint")


def response_head_bytes(status="status", protocol=None, pairs="headers") -> Column:
    p = F.lit("HTTP/1.1") if protocol is None else col(protocol)
    return (F.length(p) + 1 + F.length(col(status).cast("string")) + 1 + F.length(reason_phrase(status)) + 2 + _header_bytes(col(pairs)) + 2).cast("bigint")


def valid_ip(text) -> Column:
    return F.coalesce(col(text).rlike(IPV4) | col(text).rlike(IPV6), F.lit(False))


def request_id_millis(request_id) -> Column:
    """Epoch milliseconds in the first eight Base58 characters of a sortable id; NULL if it has none."""
    c = col(request_id)
    digits = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.call_function("instr", F.lit(BASE58), F.substring(c, i, F.lit(1))))
    value = F.aggregate(digits, F.lit(0).cast("bigint"), lambda a, d: a * 58 + d - 1)
    return F.when(c.rlike(f"^[{BASE58}]{{8}}"), value)


def _base58(number: Column, digits: int = 8) -> Column:
    letters = [F.substring(F.lit(BASE58), (F.call_function("div", number, F.lit(58**i)) % 58 + 1).cast("int"), F.lit(1)) for i in range(digits - 1, -1, -1)]
    return F.concat(*letters)


def sortable_id(millis, salt) -> Column:
    """16 characters: eight of the time, eight of a non-negative number."""
    return F.concat(_base58(col(millis)), _base58(col(salt)))


def shard_of(request_id, shards: int) -> Column:
    """Shard of an id: Java string hash, upper half folded in, masked. `shards` is a power of two."""
    if shards < 1 or shards & (shards - 1):
        raise ValueError("shards must be a power of two")
    c = col(request_id)
    codes = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x).cast("bigint"))
    h = F.aggregate(codes, F.lit(0).cast("bigint"), lambda a, x: (a * 31 + x).bitwiseAND(F.lit(0xFFFFFFFF)))
    return h.bitwiseXOR(F.shiftright(h, 16)).bitwiseAND(F.lit(shards - 1)).cast("int")


def fingerprint(text) -> Column:
    return F.concat(F.lit("id:sha256:"), F.substring(F.sha2(col(text), 256), 1, 6))


def human_bytes(number) -> Column:
    n = col(number)
    out = F.when(n < 0, "Unknown").when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
    units = ("KB", "MB", "GB", "TB", "PB", "EB")
    for k, unit in enumerate(units, 1):
        shown = F.format_string(f"%.1f {unit}", n.cast("double") / float(1024**k))
        out = out.otherwise(shown) if k == len(units) else out.when(n.cast("double") < float(1024 ** (k + 1)), shown)
    return out


def duration_ms(text) -> Column:
    """Milliseconds of 10ms, 5s, 2m, 1h; NULL for anything else."""
    c = F.lower(F.trim(col(text)))
    unit = F.create_map(*[F.lit(x) for x in ("ms", 1, "s", 1000, "m", 60_000, "h", 3_600_000)])
    shape = r"^(\d+)\s*(ms|s|m|h)$"
    return F.when(c.rlike(shape), F.regexp_extract(c, shape, 1).try_cast("bigint") * F.try_element_at(unit, F.regexp_extract(c, shape, 2)))


def size_bytes(text) -> Column:
    """Bytes of 1024, 8kb, 200mb, 1gb (1024-based, any case); NULL for anything else."""
    c = F.lower(F.trim(col(text)))
    unit = F.create_map(*[x for u, n in (("", 1), ("b", 1), ("kb", 1 << 10), ("mb", 1 << 20), ("gb", 1 << 30)) for x in (F.lit(u), F.lit(n).cast("bigint"))])
    shape = r"^(\d+)\s*(b|kb|mb|gb)?$"
    return F.when(c.rlike(shape), F.regexp_extract(c, shape, 1).try_cast("bigint") * F.try_element_at(unit, F.regexp_extract(c, shape, 2)))
