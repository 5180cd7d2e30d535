"""Joins of requests with routes, networks, policies, config versions and health."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import condition, ipv4_number, ipv6_groups
from . import segments

#: Rule or network tables up to this many rows may be broadcast; larger ones are joined by shuffling.
SMALL = 100_000


def small(df: DataFrame, limit: int = SMALL) -> DataFrame:
    """df with a broadcast hint if a count shows that it is small."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def route_of(routes: Sequence[tuple[str, object]]) -> Column:
    """Id of the first (id, condition) in the list that holds; NULL if none does."""
    return F.coalesce(*[F.when(condition(rule, f"routes[{i}]"), F.lit(name)) for i, (name, rule) in enumerate(routes)], F.lit(None).cast("string"))


def assign_route(requests: DataFrame, routes: Sequence[tuple[str, object]] | DataFrame, column: str = "route_id") -> DataFrame:
    """First matching route in list order. A route table's rules (JSON) are read to the driver as configuration.

    A table of more than SMALL rules is an error; `match_prefixes` joins those.
    """
    if isinstance(routes, DataFrame):
        rules = routes.orderBy("ordinal").limit(SMALL + 1).collect()
        if len(rules) > SMALL:
            raise ValueError(f"more than {SMALL} route rules: use match_prefixes")
        routes = [(r.route_id, json.loads(r.rule) if r.rule else None) for r in rules]
    return requests.withColumn(column, route_of(routes))


def rule_problems(routes: DataFrame) -> DataFrame:
    """(route_id, problem) of rules (JSON) that `condition` refuses, found before any request is read.

    Rules are configuration, so they are read to the driver; more than SMALL are an error.
    """
    rules = routes.select("route_id", "rule").where("rule is not null").limit(SMALL + 1).collect()
    if len(rules) > SMALL:
        raise ValueError(f"more than {SMALL} route rules")
    found = []
    for r in rules:
        try:
            condition(json.loads(r.rule), r.route_id)
        except ValueError as refused:
            found.append((r.route_id, str(refused)))
    return routes.sparkSession.createDataFrame(found, "route_id string, problem string")


def match_prefixes(requests: DataFrame, rules: DataFrame, path: str = "path") -> DataFrame:
    """For rule tables too long for a CASE: first of (ordinal, route_id, prefix) whose prefix starts the path.

    Every distinct path is joined by equality on its own prefixes of the lengths that occur, the least
    ordinal wins, and requests find their path's route; so requests need no id of their own.
    """
    names = [c for c in requests.columns if c != "route_id"]
    lengths = [r.n for r in rules.select(F.length("prefix").alias("n")).where("n is not null").distinct().orderBy("n").collect()]
    if not lengths:
        return requests.select(*names, F.lit(None).cast("string").alias("route_id"))
    own = F.array(*[F.when(F.length("_path") >= n, F.substring("_path", 1, n)) for n in lengths])
    paths = requests.select(F.col(path).alias("_path")).where("_path is not null").distinct()
    hits = paths.select("_path", F.explode(own).alias("prefix")).where("prefix is not null").join(small(rules.select("prefix", "ordinal", "route_id")), "prefix")
    hits = hits.groupBy("_path").agg(F.min_by("route_id", "ordinal").alias("_route"))
    return requests.select(*names).join(hits, F.col(path) == F.col("_path"), "left").select(*names, F.col("_route").alias("route_id"))


def _masked4(number: Column, bits: Column) -> Column:
    shift = (32 - bits).cast("int")
    return F.call_function("shiftleft", F.call_function("shiftright", number, shift), shift)


def match_networks(requests: DataFrame, networks: DataFrame, ip: str = "client_ip") -> DataFrame:
    """requests with network_id of the longest matching prefix (NULL if none), IPv4 and IPv6.

    Joins by equality on (family, prefix length, masked address), once for each prefix length in use.
    """
    cidr = F.split("cidr", "/")
    address = F.get(cidr, F.lit(0))
    nets = networks.select("network_id", ipv4_number(address).alias("v4"), ipv6_groups(address).alias("v6"), F.get(cidr, F.lit(1)).try_cast("int").alias("bits"))
    nets = nets.withColumn("bits", F.coalesce("bits", F.when(F.col("v4").isNotNull(), 32).otherwise(128))).where((F.col("v4").isNotNull() & F.col("bits").between(0, 32)) | (F.col("v6").isNotNull() & F.col("bits").between(0, 128)))
    binary = lambda c: F.array_join(F.transform(F.split(c, ""), lambda h: F.lpad(F.conv(h, 16, 2), 4, "0")), "")
    key = lambda v4, v6, bits: F.when(v4.isNotNull(), F.concat(F.lit("4:"), bits.cast("string"), F.lit(":"), _masked4(v4, bits).cast("string"))).when(v6.isNotNull(), F.concat(F.lit("6:"), bits.cast("string"), F.lit(":"), F.call_function("substring", binary(v6), F.lit(1), bits)))
    table = nets.select(key(F.col("v4"), F.col("v6"), F.col("bits")).alias("_key"), "network_id", "bits", F.col("v4").isNotNull().alias("is4")).groupBy("_key", "bits", "is4").agg(F.min("network_id").alias("network_id"))
    lengths = table.select("is4", "bits").distinct().collect()  # at most 33 + 129
    v4, v6 = ipv4_number(F.col(ip)), ipv6_groups(F.col(ip))
    own = [F.when(v4.isNotNull() if r.is4 else v6.isNotNull(), key(v4 if r.is4 else F.lit(None).cast("bigint"), v6, F.lit(r.bits))) for r in lengths]
    hosts = requests.select(ip).distinct()
    hits = hosts.select(ip, F.explode(F.array(*own)).alias("_key")).where("_key is not null").join(small(table), "_key").groupBy(ip).agg(F.max_by("network_id", "bits").alias("network_id")) if lengths else hosts.select(ip, F.lit(None).cast("string").alias("network_id"))
    return requests.join(hits, ip, "left")


def _statuses() -> Column:
    text = F.lower(F.trim("override_key"))
    family = F.substring(text, 1, 1).try_cast("int") * 100
    return F.when(text.rlike("^[0-9]xx$"), F.sequence(family, family + 99)).otherwise(F.transform(F.split(text, ","), lambda c: F.trim(c).try_cast("int")))


def expand_overrides(policy: DataFrame) -> DataFrame:
    """(route_id, direction, status, level): '5xx', '401,403' and '429' as one row per status; later keys win."""
    rows = policy.where("override_key is not null").select("route_id", "direction", "ordinal", "override_level", F.explode(_statuses()).alias("status")).where("status is not null")
    return rows.groupBy("route_id", "direction", "status").agg(F.max_by("override_level", "ordinal").alias("level"))


def route_policies(policy: DataFrame) -> DataFrame:
    """One row per route: request_base, response_base, and the overridden statuses of each direction as a map."""
    rows = policy.select("route_id", "direction", "base_level", "ordinal", "override_level", F.explode_outer(_statuses()).alias("status"))
    each = rows.groupBy("route_id", "direction", "status").agg(F.max("base_level").alias("base"), F.max_by("override_level", "ordinal").alias("level"))
    own = lambda d, c: F.when(F.col("direction") == d, c)
    changed = F.when(F.col("status").isNotNull(), F.struct("status", "level"))
    return each.groupBy("route_id").agg(
        *[F.max(own(d, F.col("base"))).alias(f"{d}_base") for d in ("request", "response")],
        *[F.map_from_entries(F.collect_list(own(d, changed))).alias(f"_{d}") for d in ("request", "response")],
    )


def resolve_level(exchanges: DataFrame, policy: DataFrame) -> DataFrame:
    """exchanges with request_base, response_base, request_level, response_level (NONE without a policy), by one join."""
    out = exchanges.join(small(route_policies(policy)), "route_id", "left")
    for d in ("request", "response"):
        out = out.withColumn(f"{d}_base", F.coalesce(f"{d}_base", F.lit("NONE")))
        out = out.withColumn(f"{d}_level", F.coalesce(F.try_element_at(f"_{d}", F.col("status").cast("int")), F.col(f"{d}_base"))).drop(f"_{d}")
    return out


def config_as_of(requests: DataFrame, versions: DataFrame, at: str = "ts", bucket: Column | None = None) -> DataFrame:
    """requests with the config version active at `at` (NULL before the first one).

    Requests and reloads stand on one timeline, cut at buckets of time (hours unless another is given, of the column
    _at); each bucket hands its last version to the next. At equal times reloads come first, of several the greatest.
    """
    starts = versions.select(F.lit(None).cast(requests.schema).alias("_row"), F.col("valid_from").alias("_at"), F.lit(0).alias("_kind"), F.col("version").alias("_version"))
    asked = requests.select(F.struct("*").alias("_row"), F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(versions.schema["version"].dataType).alias("_version"))
    line = segments.latest(asked.union(starts), [], ["_at", "_kind", "_version"], "_version", segments.hours("_at") if bucket is None else bucket, "_active")
    return line.where("_kind = 1").select("_row.*", F.col("_active").alias("version"))


def availability_join(requests: DataFrame, intervals: DataFrame, at: str = "ts", route: str = "route_id", bucket: Column | None = None) -> DataFrame:
    """requests with healthy: how many targets of the route are up at that time, and outcome.

    `intervals`: route, target, state, from_ts, to_ts (NULL: open). A route's requests and the beginnings and ends of
    its UP intervals stand on one timeline, cut at buckets of time (hours unless another is given, of the column _at);
    each bucket hands the number of targets that are up to the next. outcome: PROXY, FALLBACK (fallback_route_id is
    set) or 503.
    """
    up, none = intervals.where(F.col("state") == "UP").where(F.col(route).isNotNull()), F.lit(None).cast(requests.schema).alias("_row")
    ends = [up.where(F.col(c).isNotNull()).select(none, F.col(route).alias("_route"), F.col(c).alias("_at"), F.lit(0).alias("_kind"), F.lit(n).alias("_step")) for c, n in (("from_ts", 1), ("to_ts", -1))]
    asked = requests.select(F.struct("*").alias("_row"), F.col(route).alias("_route"), F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.lit(0).alias("_step"))
    line = segments.running_sum(asked.union(ends[0]).union(ends[1]), ["_route"], ["_at", "_kind"], "_step", segments.hours("_at") if bucket is None else bucket, "_up")
    out = line.where("_kind = 1").select("_row.*", F.when(F.col("_at").isNull(), 0).otherwise(F.col("_up")).alias("healthy"))
    fallback = F.col("fallback_route_id").isNotNull() if "fallback_route_id" in requests.columns else F.lit(False)
    return out.withColumn("outcome", F.when(F.col("healthy") > 0, "PROXY").when(fallback, "FALLBACK").otherwise("503"))


def resolve_fallback(routes: DataFrame) -> DataFrame:
    """routes with the fallback route's targets."""
    other = routes.select(F.col("route_id").alias("fallback_route_id"), F.col("targets").alias("fallback_targets"))
    return routes.join(other, "fallback_route_id", "left")


def validate_fallbacks(routes: DataFrame) -> DataFrame:
    """(route_id, fallback_route_id, problem): SELF_REFERENCE or MISSING_TARGET."""
    named = routes.where("fallback_route_id is not null").select("route_id", "fallback_route_id")
    own = named.where("route_id = fallback_route_id").withColumn("problem", F.lit("SELF_REFERENCE"))
    ids = routes.select(F.col("route_id").alias("_id"))
    lost = named.where("route_id <> fallback_route_id").join(ids, F.col("fallback_route_id") == F.col("_id"), "left_anti").withColumn("problem", F.lit("MISSING_TARGET"))
    return own.unionByName(lost)


def unrouted(requests: DataFrame, routes: DataFrame) -> DataFrame:
    return requests.join(routes.select("route_id"), "route_id", "left_anti")


def idle_routes(requests: DataFrame, routes: DataFrame) -> DataFrame:
    return routes.join(requests.select("route_id").distinct(), "route_id", "left_anti")
