"""Exact search for links inside large groups of near copies, without making all their pairs.

Every member of a group is described by its symmetric difference D to a reference set, so that
|A ^ B| = |D(A)| + |D(B)| - 2 |D(A) & D(B)|. With p = den + num, m = den - num and the integer
lack(A) = p |D(A)| - m |A|, two members link exactly if lack(A) + lack(B) <= 2 p |D(A) & D(B)|.

* The member of least lack is the hub. Members whose lack and the hub's don't exceed 0 are its core: they
  link with it, and so do both ends of any pair whose sum isn't above 0.
* Each other pair has an outer member and needs a common difference of at least
  (lack(A) + lack(B)) / 2p tokens. Tokens of a single member can't be common. The others are put in order,
  rarest first, and a prefix filter finds the pairs: the end of smaller lack indexes a prefix short
  enough for partners of at least its lack, the outer end looks up a longer one.

Any reference gives the same links; it decides only the work. It is the majority of a bounded sample of
members, `SAMPLE` texts in a group. Counting, ordering and joining are joins and aggregates on tokens
(salted by their group), so no task holds a group.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_sample, join_ids, materialise, prepare

FEW = 8  # members of a group whose pairs (at most 28) are made at once
BROADCAST_GROUPS = 100_000  # groups (a few MB) whose rows may be broadcast
SAMPLE = 9  # members whose majority is a group's reference

ROWS_SQL = "grp long, node long, part long, lack long, tokens array<long>"
ROWS = pa.schema([("grp", pa.int64()), ("node", pa.int64()), ("part", pa.int64()), ("lack", pa.int64()), ("tokens", pa.list_(pa.int64()))])


def _references(members: DataFrame, texts: DataFrame, grams: Callable[[str], np.ndarray]) -> DataFrame:
    """(grp, reference): the tokens that most of a sample of the group's members have."""

    def majority(key, rows):
        sets = [grams(t or "") for t in rows["text"]]
        token, n = np.unique(np.concatenate(sets), return_counts=True)
        return rows.iloc[:1][["grp"]].assign(reference=[token[2 * n > len(sets)].view(np.int64)])

    drawn = hash_sample(members.select("grp", F.col("node").alias("doc_id")), "grp", SAMPLE)
    return drawn.join(texts, "doc_id").select("grp", "text").groupBy("grp").applyInPandas(majority, "grp long, reference array<long>")


def _differences(members: DataFrame, documents: DataFrame, grams: Callable[[str], np.ndarray], p: int, m: int) -> DataFrame:
    ids = materialise(members.select(F.col("node").alias("doc_id")).distinct(), "open-ids")
    texts = materialise(join_ids(documents.select("doc_id", "text"), ids, "left_semi").distinct(), "open-texts")
    references = materialise(_references(members, texts, grams), "references")
    both = members.join(texts, F.col("node") == F.col("doc_id")).join(references, "grp", "left").select("grp", "node", "part", "text", "reference")

    def run(it):
        held, reference, salt = None, None, None
        for batch in it:
            groups, lack, tokens = batch.column(0).to_pylist(), [], []
            for i, grp in enumerate(groups):
                if grp != held:
                    held, reference = grp, np.asarray(batch.column(4)[i].values if batch.column(4)[i].is_valid else [], np.int64).view(np.uint64)
                    salt = np.uint64(grp * 0x9E3779B97F4A7C15 & 2**64 - 1)
                own = grams(batch.column(3)[i].as_py() or "")
                apart = np.setxor1d(own, reference, assume_unique=True)
                lack.append(p * len(apart) - m * len(own))
                tokens.append(((apart ^ salt) * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64))
            ends = np.cumsum([0, *map(len, tokens)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(tokens) if tokens else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(lack, pa.int64()), lists], schema=ROWS)

    return materialise(both.mapInArrow(run, ROWS_SQL), "differences")


def _beside(groups: DataFrame) -> DataFrame:
    """A table of one row a group, to be joined with members: broadcast if a count shows it to be short, so no hot group is shuffled."""
    return F.broadcast(groups) if groups.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS else groups


def pairs_of_few(members: DataFrame, group: str) -> DataFrame:
    """All pairs (a, b) of different parts in groups of at most FEW members."""
    b = members.select(group, F.col("node").alias("b"), F.col("part").alias("y"))
    return members.select(group, F.col("node").alias("a"), F.col("part").alias("x")).join(b, group).where("x <> y and a < b").select("a", "b")


def candidates(members: DataFrame, documents: DataFrame, grams: Callable[[str], np.ndarray], num: int, den: int) -> DataFrame:
    """Pairs (a, b) that hold a link between any two parts of a group that links join; some don't link.

    members: distinct (grp, node, part), node being a doc_id and part what it is known to be joined with.
    grams: the sorted distinct token hashes of a text. Pairs link if den * common >= num * union.
    """
    prepare(documents.sparkSession)
    p, m = den + num, den - num
    sizes = members.groupBy("grp").agg(F.count("*").alias("size"), F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("grp", "size")
    sized = materialise(members.join(_beside(materialise(sizes, "open-sizes")), "grp"), "open-groups")
    few = pairs_of_few(sized.where(F.col("size") <= FEW), "grp")
    rows = _differences(sized.where(F.col("size") > FEW).select("grp", "node", "part"), documents, grams, p, m)

    hubs = _beside(materialise(rows.groupBy("grp").agg(F.min(F.struct("lack", "node", "part")).alias("hub")), "first-hubs"))
    least_out = F.min(F.when(F.col("lack") + F.col("hub.lack") > 0, F.col("lack"))).alias("least_out")
    plain = rows.select("grp", "node", "part", "lack")
    hubs = _beside(materialise(plain.join(hubs, "grp").groupBy("grp").agg(F.min("hub").alias("hub"), least_out), "hubs"))
    placed = plain.join(hubs, "grp").withColumn("outer", F.col("lack") + F.col("hub.lack") > 0)
    core = placed.where("not outer and part <> hub.part").select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b"))

    tokens = rows.select("grp", "node", F.explode("tokens").alias("token"))
    shared = materialise(tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 1"), "shared-tokens")
    ranked = tokens.join(shared, "token").groupBy("grp", "node").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("ranked"))
    ranked = ranked.join(placed.where("least_out is not null"), ["grp", "node"])

    def prefix(lack_of_partner: F.Column) -> F.Column:
        """Number of leading tokens to look at for partners of at least this lack."""
        need = F.greatest(F.lit(1), F.ceil((F.col("lack") + lack_of_partner) / F.lit(2.0 * p)))
        return (F.size("ranked") - need + 1).cast("int")

    ranked = materialise(ranked.withColumn("indexed", prefix(F.greatest("lack", "least_out"))).drop("part"), "ranked")
    least_in = ranked.where("indexed > 0").groupBy("grp").agg(F.min("lack").alias("least_in"))
    parts = rows.select("grp", "node", "part")

    def spread(df: DataFrame, length: str, side: str) -> DataFrame:
        """A row for each token of the prefix; `left` counts the tokens from there on."""
        taken = df.where(F.col(length) > 0).join(parts, ["grp", "node"])
        taken = taken.select("node", "part", "lack", "outer", F.size("ranked").alias("n"), F.posexplode(F.slice("ranked", F.lit(1), F.col(length))).alias("at", "r"))
        return taken.select(F.col("r.token").alias("token"), *(F.col(c).alias(f"{c}_{side}") for c in ("node", "part", "lack", "outer")), (F.col("n") - F.col("at")).alias(f"left_{side}"))

    seeking = ranked.where("outer").join(least_in, "grp").withColumn("sought", prefix(F.col("least_in")))
    seek, index = spread(seeking, "sought", "a"), spread(ranked, "indexed", "b")
    met = seek.join(index, "token").where("part_a <> part_b and (not outer_b or lack_b < lack_a or (lack_b = lack_a and node_b < node_a))")
    met = met.where((F.col("lack_a") + F.col("lack_b")) <= F.lit(2 * p) * F.least("left_a", "left_b"))
    found = met.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))
    return few.unionByName(core).unionByName(found).distinct()
