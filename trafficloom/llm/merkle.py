"""Merkle manifest of a table: nested-struct rollups by rank digits, proofs for every row.

Rows of a tree (a source) are ranked by key. Digits of the rank in base 16 are grouped away one after the
other within blocks of 256 consecutive nodes, so each block becomes one row of structs nested in structs
and no group ever holds more than 16 children. The digests of blocks are the nodes of the next tier, and
the digests of trees are the nodes of the tree of trees, rolled up in the same way. Proofs are emitted by
transforming and exploding the nested rows; the part of a proof above a block is attached once a block.

Everything is DataFrame work. Ranks come from ranges of the order, so a tree with any share of the rows
is spread over tasks; one small row per range and tree is summed.
"""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, partitions_for

FAN = 16  # children of a node
DIGITS = 2  # digits grouped away in a tier: blocks of FAN ** DIGITS nodes
BLOCK = FAN**DIGITS
NO_PATH = "cast(array() as array<struct<left: string, right: string>>)"


def hashed(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf_digest(*values: Column) -> Column:
    """Digest of a row: each value as its UTF-8 byte count, a colon and the value, or - where it is null."""
    parts = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return hashed(F.concat(*parts))


def ranked(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """rows with `rank` (from 0, within the tree, by `order`) and `n` (rows of the tree); nulls come first.

    Rows that agree in all of tree and order are taken in any order. Sorted ranges number their rows; what a
    tree has in earlier ranges is added from one row per range and tree.
    """
    keys = [F.col(c).asc_nulls_first() for c in (tree, *order)]
    dealt = rows.repartitionByRange(partitions_for(rows), *keys).sortWithinPartitions(*keys)
    # the lower 33 bits number the rows of a partition; written down, since another run might cut other ranges
    place = F.monotonically_increasing_id()
    table = materialise(dealt.select("*", F.shiftright(place, 33).alias("_part"), place.bitwiseAND((1 << 33) - 1).alias("_place")), "ranked")
    parts = table.groupBy(tree, "_part").agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
    whole = Window.partitionBy(tree)
    before = F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(F.col(tree).alias("_tree"), F.col("_part").alias("_of"), (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_base"), F.sum("_n").over(whole).alias("n"))
    found = table.join(parts, F.col(tree).eqNullSafe(F.col("_tree")) & (F.col("_part") == F.col("_of")))
    return found.withColumn("rank", F.col("_place") + F.col("_base")).drop("_part", "_place", "_tree", "_of", "_base")


def rollup(nodes: DataFrame, payload: list[str]) -> DataFrame:
    """tree, block, n, child of nodes (tree, rank, n, digest, payload): one row per block.

    child is a struct of digest and kids, whose children are such structs again, down to the nodes. A level
    exists where the tree still has several nodes; below that a node stands for itself.
    """
    digits = [F.shiftright("rank", 4 * k).bitwiseAND(FAN - 1).alias(f"d{k}") for k in range(DIGITS)]
    rows = nodes.select("tree", F.shiftright("rank", 4 * DIGITS).alias("block"), "n", *digits, F.struct("digest", *payload).alias("child")).repartition("tree", "block")
    for k in range(DIGITS):  # all groupings keep the partitioning by tree and block
        rest = [f"d{i}" for i in range(k + 1, DIGITS)]
        rows = rows.groupBy("tree", "block", "n", *rest).agg(F.sort_array(F.collect_list(F.struct(f"d{k}", "child"))).alias("kids"))
        digests = F.transform("kids", lambda x: x["child"]["digest"])
        digest = F.when(F.col("n") > FAN**k, hashed(F.array_join(digests, ""))).otherwise(F.element_at(digests, 1))
        rows = rows.select("tree", "block", "n", *rest, F.struct(digest.alias("digest"), "kids").alias("child"))
    return rows


def unfold(blocks: DataFrame, keep: list[str], payload: list[str]) -> DataFrame:
    """keep, digest, payload, path of every node of blocks that carry the path above them.

    path has, for each level from the node upwards, the digests left and right of it, concatenated.
    """
    rows = blocks
    for k in reversed(range(DIGITS)):
        rows = rows.withColumn("digests", F.transform("child.kids", lambda x: x["child"]["digest"]))
        beside = lambda x, i: F.struct(
            x["child"].alias("child"),
            F.array_join(F.slice("digests", F.lit(1), i), "").alias("left"),
            F.array_join(F.slice("digests", i + 2, F.lit(FAN)), "").alias("right"),
            i.alias("digit"),
        )
        rows = rows.select(*keep, "tree", "block", "n", "path", F.explode(F.transform("child.kids", beside)).alias("kid"))
        step = F.when(F.col("n") > FAN**k, F.array(F.struct("kid.left", "kid.right"))).otherwise(F.expr(NO_PATH))
        rows = rows.select(*keep, "tree", (F.col("block") * FAN + F.col("kid.digit")).alias("block"), "n", F.concat(step, "path").alias("path"), F.col("kid.child").alias("child"))
    return rows.select(*keep, "tree", F.col("block").alias("rank"), "child.digest", *[f"child.{c}" for c in payload], "path")


def proofs(nodes: DataFrame, payload: list[str], keep: list[str], crown: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """tree, rank, digest, payload, path and keep of every node (tree, rank, n, digest, payload).

    crown takes (tree, tier, digest) of the trees and gives tree, tier, path and keep: what is above a tree.
    """
    most = nodes.agg(F.max("n")).first()[0] or 0
    tiers, names = [], payload
    while True:
        tiers.append(materialise(rollup(nodes, names), "blocks"))
        if most <= BLOCK:
            break
        many = tiers[-1].where(F.col("n") > BLOCK)
        nodes, names = many.select("tree", F.col("block").alias("rank"), F.ceil(F.col("n") / BLOCK).alias("n"), "child.digest"), []
        most = -(-most // BLOCK)
    tops = [t.where(F.col("n") <= BLOCK).select("tree", F.lit(k).alias("tier"), "child.digest") for k, t in enumerate(tiers)]
    whole = tops[0]
    for t in tops[1:]:
        whole = whole.union(t)
    above = materialise(crown(whole), "above_trees")
    found = None
    for k in reversed(range(len(tiers))):
        over = above.where(F.col("tier") == k).select(*keep, F.col("tree").alias("_tree"), F.lit(0).cast("long").alias("_block"), "path")
        if found is not None:  # blocks of the larger trees are nodes of the tier above
            over = over.union(found.select(*keep, "tree", "rank", "path"))
        joined = tiers[k].join(over, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("block") == F.col("_block"))).drop("_tree", "_block")
        found = unfold(joined, keep, payload if k == 0 else [])
    return found


def manifest(leaves: DataFrame, tree: str, order: list[str], payload: list[str]) -> DataFrame:
    """Proofs of leaves (tree, order, digest, payload): tree, digest, payload, path, subroot, root.

    Trees are ordered by their name, null first, bytewise. A lone leaf or tree stands for itself.
    """

    def crown(tops: DataFrame) -> DataFrame:
        named = tops.select(F.lit(0).alias("all"), F.col("tree").alias("name"), "tier", "digest")
        ranks = ranked(named, "all", ["name"]).withColumnsRenamed({"all": "tree"})
        whole = lambda t: t.select("tree", "tier", F.expr(NO_PATH).alias("path"), F.col("digest").alias("root"))
        # tier and name travel as payload: the tree of trees has tiers of its own
        up = proofs(ranks.withColumnRenamed("tier", "of_tier"), ["name", "of_tier"], ["root"], whole)
        return up.select(F.col("name").alias("tree"), F.col("of_tier").alias("tier"), "path", F.col("digest").alias("subroot"), "root")

    ranks = ranked(leaves, tree, [*order, "digest"]).withColumnRenamed(tree, "tree")
    return proofs(ranks, payload, ["subroot", "root"], crown)


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and the digests beside its way up give."""
    return F.aggregate(path, start, lambda node, step: hashed(F.concat(step["left"], node, step["right"])))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings, level by level, left to right."""
    return hashed(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""))


def tamper_report(documents: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every document.

    Documents whose crc32(doc_id) is divisible by 5 are checked with A-Z of their text lower-cased, all others
    as they are. Null columns are leaves' `-`; documents without a source make a tree of their own, the first;
    null ids come first in it and are never tampered with. Documents of one id are ordered by their digests, so
    repeated rows get one proof each, as different places. Empty tables give no rows; other columns are ignored.
    """
    columns = ["doc_id", "source", "lang", "n_chars"]
    text = F.col("text")
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.translate(text, ascii_uppercase, ascii_lowercase))
    altered = F.when(changed != text, leaf_digest(*map(F.col, columns), changed))  # null: nothing was changed
    leaves = materialise(documents.select("doc_id", "source", leaf_digest(*map(F.col, columns), text).alias("digest"), altered.alias("altered")), "leaves")
    got = manifest(leaves, "source", ["doc_id"], ["doc_id", "altered"])
    folded = got.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), fold(F.coalesce("altered", "digest"), F.col("path")).alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))
