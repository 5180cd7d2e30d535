"""Header multimaps: arrays of (name, value), order kept, duplicates allowed."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import PAIRS
from .exchange import col, fingerprint, valid_ip


def none() -> Column:
    return F.array().cast(PAIRS)


def _or_none(pairs) -> Column:
    return F.coalesce(col(pairs), none())


def _same(h: Column, name: str, ignore_case: bool) -> Column:
    return F.lower(h["name"]) == name.lower() if ignore_case else h["name"] == name


def pairs_to_map(pairs) -> Column:
    """MAP<name, ARRAY<value>>; names keep their case, values their order."""
    c = _or_none(pairs)
    names, values = c["name"], c["value"]
    distinct = F.array_distinct(names)
    gathered = F.transform(distinct, lambda n: F.struct(n, F.transform(F.filter(c, lambda h: h["name"] == n), lambda h: h["value"])))
    # only where a name comes twice are the pairs searched for each name
    return F.when(F.size(distinct) == F.size(names), F.map_from_arrays(names, F.transform(values, lambda v: F.array(v)))).otherwise(F.map_from_entries(gathered))


def header_all(pairs, name: str, ignore_case: bool = True) -> Column:
    return F.transform(F.filter(_or_none(pairs), lambda h: _same(h, name, ignore_case)), lambda h: h["value"])


def header_first(pairs, name: str, ignore_case: bool = True) -> Column:
    return F.get(header_all(pairs, name, ignore_case), F.lit(0))


def _pair(name: str, value) -> Column:
    return F.array(F.struct(F.lit(name).alias("name"), (value if isinstance(value, Column) else F.lit(value)).cast("string").alias("value")))


def header_remove(pairs, name: str) -> Column:
    return F.filter(_or_none(pairs), lambda h: ~_same(h, name, True))


def header_add(pairs, name: str, value) -> Column:
    return F.concat(_or_none(pairs), _pair(name, value))


def header_set(pairs, name: str, value) -> Column:
    """All values of the name are replaced by one, at the first one's place; without any it is appended."""
    c = _or_none(pairs)
    kept = F.transform(c, lambda h, i: F.when(_same(h, name, True), F.when(i == F.array_position(F.transform(c, lambda x: F.lower(x["name"])), name.lower()).cast("int") - 1, _pair(name, value)[0])).otherwise(h))
    replaced = F.filter(kept, lambda h: h.isNotNull())
    return F.when(F.exists(c, lambda h: _same(h, name, True)), replaced).otherwise(header_add(c, name, value))


def edit_headers(pairs, set: Mapping | None = None, add: Mapping | None = None, remove: Iterable[str] = ()) -> Column:  # noqa: A002
    """Removals, then replacements, then additions."""
    out = _or_none(pairs)
    for name in remove:
        out = header_remove(out, name)
    for name, value in (set or {}).items():
        out = header_set(out, name, value)
    for name, value in (add or {}).items():
        out = header_add(out, name, value)
    return out


def add_correlation_id(df: DataFrame, request_id: str = "req_id", columns: Iterable[str] = ("request_headers", "response_headers"), name: str = "X-Correlation-Id") -> DataFrame:
    """The request id in both directions' headers."""
    return df.withColumns({c: header_set(c, name, F.col(request_id)) for c in columns})


def strip_cache_headers(pairs) -> Column:
    return edit_headers(pairs, set={"Cache-Control": "no-cache", "Pragma": "no-cache"}, remove=("If-Modified-Since", "If-None-Match"))


def client_ip(pairs, socket_ip) -> Column:
    """struct(ip, source): first X-Forwarded-For entry, else X-Real-IP, else socket; malformed ones fall through."""
    forwarded = F.trim(F.get(F.split(header_first(pairs, "X-Forwarded-For"), ","), F.lit(0)))
    real = F.trim(header_first(pairs, "X-Real-IP"))
    made = lambda ip, source: F.struct(ip.alias("ip"), F.lit(source).alias("source"))
    return (
        F.when(valid_ip(forwarded), made(forwarded, "X_FORWARDED_FOR")).when(valid_ip(real), made(real, "X_REAL_IP"))
        .when(col(socket_ip).isNotNull(), made(col(socket_ip), "SOCKET")).otherwise(made(F.lit(None).cast("string"), "UNKNOWN"))
    )


def with_gateway_attributes(exchanges: DataFrame, attributes: str = "attributes") -> DataFrame:
    first = lambda n: header_first(attributes, n, ignore_case=False)
    return exchanges.withColumns({
        "route_id": first("gateway.route.id"), "targets": header_all(attributes, "gateway.target", ignore_case=False),
        "short_circuit": first("gateway.shortcircuit.name"), "fallback_id": first("gateway.fallback.id"),
    })


def _instructions(lines: Iterable[str], default: str) -> dict[str, str]:
    """'Name', 'Name,r' (redact) or 'Name,d' (delete) to a lower-case name and its treatment."""
    out: dict[str, str] = {}
    for line in lines:
        name, _, how = line.partition(",")
        if how and how.lower() not in ("r", "d"):
            raise ValueError(f"unknown treatment {how!r} of header {name!r}; use r or d")
        out[name.lower()] = {"": default, "r": "redact", "d": "delete"}[how.lower()]
    return out


def header_policy(pairs, includes: Iterable[str] = (), excludes: Iterable[str] = ()) -> Column:
    """Included headers are kept (all others go) unless told otherwise; excluded ones go or are redacted."""
    include, exclude = _instructions(includes, "keep"), _instructions(excludes, "delete")
    table = include or exclude
    default = "delete" if include else "keep"
    if not table:
        return _or_none(pairs)
    how = F.create_map(*[F.lit(x) for item in table.items() for x in item])

    def treated(h: Column) -> Column:
        what = F.coalesce(F.try_element_at(how, F.lower(h["name"])), F.lit(default))
        return F.when(what == "keep", h).when(what == "redact", F.struct(h["name"].alias("name"), fingerprint(h["value"]).alias("value")))

    return F.filter(F.transform(_or_none(pairs), treated), lambda h: h.isNotNull())
