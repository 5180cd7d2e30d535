"""Path edits and request rules."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exchange import col
from .headers import header_first, header_set


def strip_path_prefix(path, parts: int) -> Column:
    """The path from its (parts + 1)-th slash on; `/` if it has fewer."""
    rest = F.regexp_extract(col(path), rf"(?s)^.[^/]*(?:/[^/]*){{{parts - 1}}}(/.*)$", 1)
    return F.when(col(path).isNotNull(), F.when(rest == "", "/").otherwise(rest))


def rewrite_path(path, regexp: str, replacement: str) -> Column:
    """All matches replaced; groups are $1, $2."""
    return F.regexp_replace(col(path), regexp, replacement)


def template_redirect(path, source: str, target: str, status: int = 302) -> Column:
    """struct(location, status): the first match replaced by a {{1}} or {{name}} template; NULL without a match.

    `source` is a pattern in Java's syntax. Numbered groups 1 to 9 can be referred to, named ones by name.
    """
    c = col(path)
    # Only the first match is replaced: the pattern is tied to the start; what it skips is group 1 and the
    # match is group 2, so the numbers of the pattern's own groups move up by two.
    moved = re.sub(r"\\(?:Q.*?(?:\\E|$)|([1-9])|.)", lambda m: f"\\{int(m[1]) + 2}" if m[1] else m[0], source, flags=re.S)
    template = re.sub(r"\$(\d+)", lambda m: f"${int(m[1]) + 2}", target)
    template = re.sub(r"\{\{(\w+)\}\}", lambda m: f"${int(m[1]) + 2}" if m[1].isdigit() else f"${{{m[1]}}}", template)
    location = F.regexp_replace(c, rf"\A((?s:.*?))({moved})", f"$1{template}")
    return F.when(F.coalesce(c.rlike(source), F.lit(False)), F.struct(location.alias("location"), F.lit(status).alias("status")))


@dataclass(frozen=True)
class CorsConfig:
    allowed_origins: str = "*"
    allowed_headers: str | None = None

    @property
    def origins(self) -> list[str]:
        return re.split(r"\s*,\s*", self.allowed_origins)


def cors_class(method, pairs, config: CorsConfig) -> Column:
    """struct(kind, allow_origin, allow_headers); kind is NO_ORIGIN, PREFLIGHT, ALLOWED or DENIED."""
    origin = header_first(pairs, "Origin")
    allow = F.when(origin.isNull(), None).when(F.lit(config.allowed_origins == "*"), "*").when(origin.isin(config.origins), origin)
    preflight = origin.isNotNull() & (col(method) == "OPTIONS")
    kind = F.when(origin.isNull(), "NO_ORIGIN").when(preflight, "PREFLIGHT").when(allow.isNotNull(), "ALLOWED").otherwise("DENIED")
    headers = F.when(preflight, F.lit(config.allowed_headers))
    return F.struct(kind.alias("kind"), allow.alias("allow_origin"), headers.alias("allow_headers"))


def over_size(pairs, max_bytes: int) -> Column:
    """Content-Length above the limit; absent or not a number counts as 0."""
    return F.coalesce(header_first(pairs, "Content-Length").try_cast("bigint"), F.lit(0)) > max_bytes


def lacks_authorization(pairs) -> Column:
    value = header_first(pairs, "Authorization")
    return ~F.coalesce(value.startswith("Bearer ") | value.startswith("Basic "), F.lit(False))


# Rules: (rejects, status, location) from the current columns, or an edit of path or headers.
PHASES = ("client_request", "upstream_request", "client_response", "completed")
_FILTERS: dict[str, tuple[str, Callable]] = {}


def register_filter(name: str, phase: str, fn: Callable[[dict[str, Column], Mapping], dict[str, Column]]) -> None:
    """fn(columns, config) gives changed columns; `reject_status` (and `location`) reject where not NULL."""
    if name in _FILTERS:
        raise ValueError(f"filter {name!r} is registered already")
    if phase not in PHASES:
        raise ValueError(f"unknown phase {phase!r}; known: {', '.join(PHASES)}")
    _FILTERS[name] = (phase, fn)


def _reject(when: Column, status: int) -> dict[str, Column]:
    return {"reject_status": F.when(when, F.lit(status))}


def _redirect(c, k):
    got = template_redirect(c["path"], k["source"], k["target"], k.get("status", 302))
    return {"reject_status": got["status"], "location": got["location"]}


def _cors(c, k):
    return _reject(cors_class(c["method"], c["headers"], CorsConfig(**k))["kind"] == "PREFLIGHT", 204)


register_filter("StripPathPrefix", "client_request", lambda c, k: {"path": strip_path_prefix(c["path"], k["parts"])})
register_filter("RewritePath", "client_request", lambda c, k: {"path": rewrite_path(c["path"], k["regexp"], k["replacement"])})
register_filter("TemplateRedirect", "client_request", _redirect)
register_filter("RequestSize", "client_request", lambda c, k: _reject(over_size(c["headers"], k["max"]), 413))
register_filter("RequireAuthorizationHeader", "client_request", lambda c, k: _reject(lacks_authorization(c["headers"]), 401))
register_filter("Cors", "client_request", _cors)
register_filter("RejectWhere", "client_request", lambda c, k: _reject(c[k["column"]], k["status"]))
register_filter("AddRequestHeader", "client_request", lambda c, k: {"headers": header_set(c["headers"], k["name"], k["value"])})
register_filter("AddResponseHeader", "client_response", lambda c, k: {"response_headers": header_set(c["response_headers"], k["name"], k["value"])})


def first_violation(df: DataFrame, rules: Sequence[tuple[str, Mapping]], route_rules: Mapping[str, Sequence[tuple[str, Mapping]]] | None = None, route: str = "route_id") -> DataFrame:
    """df with rejected_by, reject_status, location and the columns as edited up to the rejection.

    Global rules come first, then the route's. Response edits apply in reverse order to all rows.
    Columns such as throttle or outage tags enter through RejectWhere.
    """
    plan = [(n, k, None) for n, k in rules] + [(n, k, r) for r, own in (route_rules or {}).items() for n, k in own]
    for name, _, _ in plan:
        if name not in _FILTERS:
            raise ValueError(f"unknown filter {name!r}; known: {', '.join(sorted(_FILTERS))}")
    now = {c: F.col(c) for c in df.columns}
    by, status, location = (F.lit(None).cast(t) for t in ("string", "int", "string"))
    for name, config, only in plan:
        phase, fn = _FILTERS[name]
        if phase in ("client_response", "completed"):
            continue
        applies = by.isNull() if only is None else by.isNull() & F.coalesce(F.col(route) == only, F.lit(False))
        change = fn(now, config)
        hit = applies & change["reject_status"].isNotNull() if "reject_status" in change else F.lit(False)
        for c, v in change.items():
            if c in now:
                now[c] = F.when(applies, v).otherwise(now[c])
        if "reject_status" in change:
            by, status, location = F.when(hit, F.lit(name)).otherwise(by), F.when(hit, change["reject_status"]).otherwise(status), F.when(hit, change.get("location", F.lit(None).cast("string"))).otherwise(location)
    for name, config, only in reversed(plan):
        phase, fn = _FILTERS[name]
        if phase in ("client_response", "completed"):
            for c, v in fn(now, config).items():
                now[c] = v if only is None else F.when(F.coalesce(F.col(route) == only, F.lit(False)), v).otherwise(now[c])
    return df.select(*[v.alias(c) for c, v in now.items()], by.alias("rejected_by"), status.alias("reject_status"), location.alias("location"))
