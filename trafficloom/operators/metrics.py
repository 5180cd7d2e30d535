"""Route metrics and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exchange as X
from .series import spark_rates, sparkline, tick_of

BYTES = ("request_header_bytes", "request_body_bytes", "response_header_bytes", "response_body_bytes")
SUMS = ("total", "upstream", "websocket", *BYTES, "journal_bytes", "duration_ns_sum")


def _sum(c: Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0).cast("bigint"))


def route_metrics(exchanges: DataFrame, by: Sequence[str] = ("route_id",)) -> DataFrame:
    """Counts, byte sums, duration sum and last activity per route. One shuffle, of partial sums.

    A websocket exchange has status 101. journal_bytes is summed if the column exists.
    """
    journal = F.col("journal_bytes") if "journal_bytes" in exchanges.columns else F.lit(0).cast("bigint")
    return exchanges.groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if(X.was_proxied()).alias("upstream"), F.count_if(F.col("status") == 101).alias("websocket"), *[_sum(F.col(c)).alias(c) for c in BYTES], _sum(journal).alias("journal_bytes"),
        _sum(F.col("client_end_ns") - F.col("client_start_ns")).alias("duration_ns_sum"), X.utc_micros(F.max("client_end_ns")).alias("last_active"),
    )


def avg_latency_ns(exchanges: DataFrame, by: Sequence[str] = ("route_id",)) -> DataFrame:
    m = route_metrics(exchanges, by)
    return m.select(*by, F.when(F.col("total") > 0, F.expr("duration_ns_sum div total")).otherwise(0).alias("avg_latency_ns"))


def status_counts(exchanges: DataFrame, by: Sequence[str] = ("route_id",), side: str = "client") -> DataFrame:
    """(by, status, n) with statuses clamped to 100-599; side upstream counts proxied rows only."""
    rows = exchanges if side == "client" else exchanges.where(X.was_proxied())
    return rows.groupBy(*by, F.least(F.lit(599), F.greatest(F.lit(100), F.col("status"))).alias("status")).agg(F.count("*").alias("n"))


def status_histogram(exchanges: DataFrame, by: Sequence[str] = ("route_id",), side: str = "client") -> DataFrame:
    """One map per route, sorted by code; codes without rows are absent."""
    counts = status_counts(exchanges, by, side)
    return counts.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("statuses"))


def class_counts(exchanges: DataFrame, by: Sequence[str] = ("route_id",)) -> DataFrame:
    s = F.col("status")
    return exchanges.groupBy(*by).agg(*[F.count_if(s.between(k * 100, k * 100 + 99)).alias(f"n_{k}xx") for k in (2, 4, 5)])


def merge_metrics(a: DataFrame, b: DataFrame, by: Sequence[str] = ("route_id",)) -> DataFrame:
    """Rollups of two parts as one: sums add, the later activity counts."""
    both = a.unionByName(b)
    return both.groupBy(*by).agg(*[_sum(F.col(c)).alias(c) for c in SUMS], F.max("last_active").alias("last_active"))


def connector_stats(exchanges: DataFrame) -> DataFrame:
    duration = F.col("client_end_ns") - F.col("client_start_ns")
    return exchanges.agg(
        F.count("*").alias("requests"), _sum(X.total_bytes("request")).alias("bytes_in"), _sum(X.total_bytes("response")).alias("bytes_out"), F.count_if(F.col("status") >= 500).alias("errors"),
        _sum(duration).alias("processing_ns"), F.coalesce(F.max(duration), F.lit(0)).alias("max_processing_ns"),
    )


def concurrency(exchanges: DataFrame, by: Sequence[str] = ("route_id",), bucket_ns: int = 3_600_000_000_000) -> DataFrame:
    """Greatest number of exchanges at work at once, and how many never end (active).

    Starts and ends are summed per time bucket first; the running sum over buckets (few rows) is added
    to the running sum within each bucket, so a key's rows are never ordered in one task. At equal
    times ends come before starts.
    """
    points = F.explode(F.array(F.struct(F.col("client_start_ns").alias("at"), F.lit(1).alias("step")), F.struct(F.col("client_end_ns").alias("at"), F.lit(-1).alias("step")))).alias("p")
    rows = exchanges.select(*by, points).select(*by, "p.at", "p.step").where("at is not null").withColumn("_bucket", F.expr(f"at div {bucket_ns}"))
    # an exchange of no length must not leave -1 before its own +1
    steps = rows.groupBy(*by, "_bucket", "at").agg(F.sum(F.when(F.col("step") < 0, F.col("step"))).alias("down"), F.sum(F.when(F.col("step") > 0, F.col("step"))).alias("up"))
    steps = steps.select(*by, "_bucket", "at", F.coalesce("down", F.lit(0)).alias("down"), F.coalesce("up", F.lit(0)).alias("up"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = steps.groupBy(*by, "_bucket").agg(F.sum(F.col("up") + F.col("down")).alias("net")).select(*by, "_bucket", F.coalesce(F.sum("net").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy(*by, "_bucket").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    running = steps.join(base, [*by, "_bucket"]).withColumn("now", F.col("base") + F.sum(F.col("up") + F.col("down")).over(within))
    return running.groupBy(*by).agg(F.max("now").alias("max_concurrent"), F.sum(F.col("up") + F.col("down")).alias("active"))


def target_stats(exchanges: DataFrame) -> DataFrame:
    """Per upstream target: attempts, final attempts (the last of a retried list), their errors and bytes."""
    each = exchanges.select(F.posexplode("targets").alias("place", "target"), F.size("targets").alias("n"), "status", X.total_bytes("response").alias("bytes"))
    final = F.col("place") == F.col("n") - 1
    return each.groupBy("target").agg(F.count("*").alias("attempts"), F.count_if(final).alias("final_attempts"), F.count_if(final & (F.col("status") >= 500)).alias("errors"), _sum(F.when(final, F.col("bytes"))).alias("response_bytes"))


def rejections(exchanges: DataFrame, name: str = "short_circuit") -> DataFrame:
    return exchanges.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("filter"), "status").agg(F.count("*").alias("n"))


def parser_rejections(lines: DataFrame, marker: str = "UT0050") -> DataFrame:
    return lines.agg(F.count_if(F.col("value").contains(marker)).alias("rejections"))


def latency_report(exchanges: DataFrame, by: Sequence[str] = ("route_id",), window: str | None = None, probs: Sequence[float] = (0.5, 0.99), exact: bool = False) -> DataFrame:
    """Volume, error rate and latency percentiles per key and window; exact=False sketches the percentiles."""
    keys = [F.col(c) for c in by] + ([F.window(X.utc_micros("client_start_ns"), window)["start"].alias("window_start")] if window else [])
    latency = F.col("client_end_ns") - F.col("client_start_ns")
    cut = (lambda p: F.percentile(latency, F.lit(p))) if exact else (lambda p: F.percentile_approx(latency, p, 10_000))
    name = lambda p: f"p{100 * p:g}_ns".replace(".", "_")
    return exchanges.groupBy(*keys).agg(F.count("*").alias("requests"), F.avg(X.is_error().cast("int")).alias("error_rate"), *[cut(p).alias(name(p)) for p in probs], F.max(latency).alias("max_ns"), _sum(X.total_bytes("request") + X.total_bytes("response")).alias("bytes"))


def latency_ticks(exchanges: DataFrame, interval_s: int, by: Sequence[str] = ("route_id",), k: int = 800) -> DataFrame:
    """Rollups per key and tick that can be stored and merged: requests, errors, duration sum and maximum, latency sketch.

    Sketches are KLL ones of size k, a few KB a row whatever the traffic: percentiles of any merger are within about
    2.3 / k ** 0.9 of their rank (0.6 % at 800), exact while a sketch holds fewer than k values.
    """
    latency = F.col("client_end_ns") - F.col("client_start_ns")
    return exchanges.groupBy(*by, tick_of("client_start_ns", interval_s).alias("tick")).agg(
        F.count("*").alias("requests"), F.count_if(X.is_error()).alias("errors"), _sum(latency).alias("duration_ns_sum"), F.max(latency).alias("max_ns"), F.kll_sketch_agg_bigint(latency, k).alias("latency"),
    )


def merge_latency(ticks: DataFrame, by: Sequence[str | Column] = ("route_id",)) -> DataFrame:
    """Rollups of ticks as one per key: other keys, longer windows, parts written apart."""
    return ticks.groupBy(*by).agg(
        _sum(F.col("requests")).alias("requests"), _sum(F.col("errors")).alias("errors"), _sum(F.col("duration_ns_sum")).alias("duration_ns_sum"), F.max("max_ns").alias("max_ns"), F.kll_merge_agg_bigint("latency").alias("latency"),
    )


def latency_quantiles(rollups: DataFrame, probs: Sequence[float] = (0.5, 0.99)) -> DataFrame:
    """rollups with p50_ns and the like in place of the sketch; null where nothing was measured."""
    name = lambda p: f"p{100 * p:g}_ns".replace(".", "_")
    some = F.kll_sketch_get_n_bigint("latency") > 0
    return rollups.withColumns({name(p): F.when(some, F.kll_sketch_get_quantile_bigint("latency", F.lit(p))) for p in probs}).drop("latency")


def status_report(exchanges: DataFrame, period_s: int = 120, interval_s: int = 1, end: Column | None = None) -> DataFrame:
    """One nested row per route: request_statistics, traffic_flow, performance_telemetry, sparkline."""
    m = route_metrics(exchanges)
    for part in (class_counts(exchanges), status_histogram(exchanges).withColumnRenamed("statuses", "client_statuses"), status_histogram(exchanges, side="upstream").withColumnRenamed("statuses", "upstream_statuses"),
                 spark_rates(sparkline(exchanges, period_s, interval_s, end))):
        m = m.join(part, "route_id", "left")
    ingress, egress = F.col("request_header_bytes") + F.col("request_body_bytes"), F.col("response_header_bytes") + F.col("response_body_bytes")
    return m.select(
        "route_id", F.struct("total", "upstream", "websocket", "n_2xx", "n_4xx", "n_5xx", "client_statuses", "upstream_statuses").alias("request_statistics"),
        F.struct(F.struct(F.col("request_header_bytes").alias("header"), F.col("request_body_bytes").alias("body"), ingress.alias("total")).alias("ingress"), F.struct(F.col("response_header_bytes").alias("header"), F.col("response_body_bytes").alias("body"), egress.alias("total")).alias("egress"), (ingress + egress).alias("total")).alias("traffic_flow"),
        F.struct(F.expr("duration_ns_sum div total").alias("avg_latency_ns"), "last_active", "journal_bytes").alias("performance_telemetry"),
        F.struct("success", "client_error", "server_error", "success_rate", "client_error_rate", "server_error_rate", "rate").alias("sparkline"),
    )


def ip_source_counts(exchanges: DataFrame) -> DataFrame:
    return exchanges.groupBy("client_ip_source").agg(F.count("*").alias("n"))


def level_counts(exchanges: DataFrame) -> DataFrame:
    """(slice, level, n); a missing slice counts as NONE."""
    parts = F.array(*[F.struct(F.lit(s).alias("slice"), F.coalesce(F.col(f"{s}.level"), F.lit("NONE")).alias("level")) for s in ("client_request", "upstream_request", "upstream_response", "client_response")])
    return exchanges.select(F.explode(parts).alias("x")).groupBy("x.slice", "x.level").agg(F.count("*").alias("n"))


def hydrate(metrics: DataFrame, snapshot: DataFrame, by: Sequence[str] = ("route_id",)) -> DataFrame:
    """metrics plus the sums of the last snapshot; routes that are no longer configured are ignored."""
    old = snapshot.select(*by, *[F.col(c).alias(f"_{c}") for c in (*SUMS, "last_active")])
    both = metrics.join(old, list(by), "left")
    return both.select(*by, *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in SUMS], F.greatest("last_active", "_last_active").alias("last_active"))
