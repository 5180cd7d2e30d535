"""Scans along a key's order, cut at time buckets.

Rows are worked on within (key, bucket); what a bucket hands to the next is a summary of fixed size, carried
over the key's buckets, of which there are few. So no task holds more rows than a bucket has, whatever the
key's history.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BEFORE = (Window.unboundedPreceding, -1)
SO_FAR = (Window.unboundedPreceding, 0)


def hours(at: Column | str, ns: bool = False) -> Column:
    """Bucket of an hour, of a timestamp or of nanoseconds since the epoch."""
    at = F.col(at) if isinstance(at, str) else at
    return F.floor(at / 3_600_000_000_000) if ns else F.floor(F.unix_seconds(at.cast("timestamp")) / 3600)


def _cut(df: DataFrame, by: Sequence[str], bucket: Column) -> DataFrame:
    # one struct as the key: a struct isn't null where its fields are, so joins on it lose nothing
    return df.withColumn("_seg", F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(by)], bucket.alias("bucket")))


def _summary(rows: DataFrame, by: Sequence[str], *aggs: Column):
    """(one row per key and bucket, the window over a key's buckets); keys stand as columns, so windows share one exchange."""
    keys = [f"_k{i}" for i in range(len(by))]
    named = [F.col(f"_seg.k{i}").alias(k) for i, k in enumerate(keys)]
    found = rows.groupBy("_seg").agg(*aggs).select("*", *named, F.col("_seg.bucket").alias("_bucket"))
    return found, Window.partitionBy(*keys).orderBy(F.col("_bucket").asc_nulls_first())


def runs(df: DataFrame, by: Sequence[str], order: Sequence[str], flag: str, bucket: Column, rise: int = 1, fall: int = 1) -> DataFrame:
    """df with streak, state and was.

    streak: how many rows in a row, up to this one, have had this flag. state: true once `rise` rows in a row
    were true, false once `fall` were false, else what it was before, null as long as neither has happened.
    was: the state before this row, and _head: whether the row is its key's first. bucket must not fall along
    the order. A null flag makes a run of its own and changes no state.
    """
    rows = _cut(df, by, bucket)
    w = Window.partitionBy("_seg").orderBy(*order)
    new = F.coalesce(F.col(flag) != F.lag(flag).over(w), F.lit(True))
    rows = rows.withColumns({"_new": new, "_n": F.row_number().over(w)})
    so_far = w.rowsBetween(*SO_FAR)
    rows = rows.withColumns({"_run": F.sum(F.col("_new").cast("int")).over(so_far), "_pos": F.col("_n") + 1 - F.max(F.when(F.col("_new"), F.col("_n"))).over(so_far)})

    def turned(length: Column) -> Column:
        return F.when(F.col(flag) & (length >= rise), True).when(~F.col(flag) & (length >= fall), False)

    inner = F.when(F.col("_run") > 1, turned(F.col("_pos")))
    summary, v = _summary(
        rows, by, F.max("_run").alias("runs"), F.min_by(flag, "_n").alias(flag), F.max_by(flag, "_n").alias("last"), F.count_if(F.col("_run") == 1).alias("first_len"),
        F.max_by("_pos", "_n").alias("last_len"), F.max_by(inner, F.when(inner.isNotNull(), F.col("_n"))).alias("inner"),
    )
    goes_on = F.coalesce(F.col(flag) == F.lag("last").over(v), F.lit(False))
    up_to = v.rowsBetween(*SO_FAR)
    summary = summary.withColumns({"goes_on": goes_on, "head": F.row_number().over(v) == 1, "total": F.sum("last_len").over(up_to)})
    # buckets of one run that goes on add to the run before them: its length so far is the total since its beginning
    begun = F.last(F.when(~(F.col("goes_on") & (F.col("runs") == 1)), F.col("total") - F.col("last_len")), ignorenulls=True).over(up_to)
    summary = summary.withColumn("trailing", F.col("total") - begun)
    summary = summary.withColumn("_carry", F.when(F.col("goes_on"), F.lag("trailing").over(v)).otherwise(0))
    after = F.coalesce("inner", turned(F.col("_carry") + F.col("first_len")))
    summary = summary.withColumn("after", after).select("_seg", "_carry", F.col("head").alias("_head"), F.last("after", ignorenulls=True).over(v.rowsBetween(*BEFORE)).alias("_before"))
    rows = rows.join(summary, "_seg")
    rows = rows.withColumn("streak", (F.col("_pos") + F.when(F.col("_run") == 1, F.col("_carry")).otherwise(0)).cast("int"))
    changed = turned(F.col("streak"))
    rows = rows.withColumn("state", F.coalesce(F.last(changed, ignorenulls=True).over(so_far), F.col("_before")))
    was = F.when(F.col("_n") == 1, F.col("_before")).otherwise(F.lag("state").over(w))
    return rows.withColumn("was", was).withColumn("_head", F.col("_head") & (F.col("_n") == 1)).drop("_seg", "_new", "_n", "_run", "_pos", "_carry", "_before")


def pieces(df: DataFrame, by: Sequence[str], at: str, gap: int, bucket: Column) -> DataFrame:
    """df with _piece: rows of a key that come gap or more after the one before begin a new piece.

    A piece is named by the bucket in which it begins and by how many began there before it.
    """
    rows = _cut(df, by, bucket)
    w = Window.partitionBy("_seg").orderBy(at)
    rows = rows.withColumn("_cut", F.col(at) - F.lag(at).over(w) >= gap)  # null for a bucket's first row: the bucket before decides
    rows = rows.withColumn("_cuts", F.sum(F.coalesce("_cut", F.lit(False)).cast("int")).over(w.rowsBetween(*SO_FAR)))
    summary, v = _summary(rows, by, F.min(at).alias("first"), F.max(at).alias("last"), F.max("_cuts").alias("cuts"))
    summary = summary.withColumn("begins", F.coalesce(F.col("first") - F.lag("last").over(v) >= gap, F.lit(True)))
    # the newest piece that a bucket leaves open: its own last cut, or its own beginning, or an earlier bucket's
    own = F.struct(F.col("_seg.bucket").alias("bucket"), F.col("cuts").alias("number"))
    left = F.when(F.col("begins") | (F.col("cuts") > 0), own)
    summary = summary.withColumn("left", left)
    summary = summary.select("_seg", "begins", F.last("left", ignorenulls=True).over(v.rowsBetween(*BEFORE)).alias("_open"))
    rows = rows.join(summary, "_seg")
    here = F.struct(F.col("_seg.bucket").alias("bucket"), F.col("_cuts").alias("number"))
    return rows.withColumn("_piece", F.when(F.col("begins") | (F.col("_cuts") > 0), here).otherwise(F.col("_open"))).drop("_seg", "_cut", "_cuts", "begins", "_open")


def running_sum(df: DataFrame, by: Sequence[str], order: Sequence[str], step: str, bucket: Column, name: str) -> DataFrame:
    """df with the sum of `step` over the key's rows up to each row."""
    rows = _cut(df, by, bucket)
    summary, v = _summary(rows, by, F.sum(step).alias("net"))
    base = F.coalesce(F.sum("net").over(v.rowsBetween(*BEFORE)), F.lit(0))
    within = F.sum(step).over(Window.partitionBy("_seg").orderBy(*order).rowsBetween(*SO_FAR))
    return rows.join(summary.select("_seg", base.alias("_base")), "_seg").withColumn(name, F.col("_base") + within).drop("_seg", "_base")


def latest(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, bucket: Column, name: str) -> DataFrame:
    """df with the key's last value that isn't null, up to each row; nulls come first in the order."""
    rows = _cut(df, by, bucket)
    summary, v = _summary(rows, by, F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("last"))
    before = F.last("last", ignorenulls=True).over(v.rowsBetween(*BEFORE))
    within = F.last(value, ignorenulls=True).over(Window.partitionBy("_seg").orderBy(*order).rowsBetween(*SO_FAR))
    return rows.join(summary.select("_seg", before.alias("_before")), "_seg").withColumn(name, F.coalesce(within, F.col("_before"))).drop("_seg", "_before")
