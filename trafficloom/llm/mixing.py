"""Operator 7: mixing sources to target weights by hierarchical budgeting.

The tree's levels are columns (here domain, language, source). A budget of tokens flows from the root
to the leaves in proportion to the weights. No node gets more than its subtree can give (its tokens
times `max_epochs`); what a child can't take goes to its siblings first, and leaves their parent only
when all of them are full. A leaf then takes whole epochs of its documents and a token-prefix of one
more, in an order that the seed and the epoch's number fix.

The tree is configuration: its leaves (at most `max_leaves`, else ValueError) are budgeted on the
driver. Documents stay distributed. The prefix is found by two steps: token sums of buckets of the
order within each leaf (about as many as the root of the leaf's rows), then a running sum over the one
bucket in which the leaf's prefix ends; so a leaf with a third of all rows is never ordered in one task.

Defined cases: null values of a level are a node of their own; nodes without a weight get the least
weight given on their level; null and empty texts have 0 tokens (a leaf without tokens keeps its rows
once); a very long text is one document like any other, drawn only if it fits whole; repeated rows count
and are drawn one by one, and rows that tie in the order are ordered by doc_id; an empty table gives an
empty table; all columns pass through, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import quoted

DEFAULT_LEVELS = ("domain", "lang", "source")
DEFAULT_WEIGHTS: dict[str, dict[str, float]] = {
    "domain": {"web": 0.4, "forum": 0.2, "books": 0.2, "reference": 0.2},
    "lang": {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1},
    "source": {},
}


def domain_of(source: Column) -> Column:
    """The domain of a source by its number: 0-4 web, 5-9 forum, 10-14 books, others reference."""
    number = F.regexp_extract(source, "([0-9]+)$", 1).try_cast("int")
    return F.when(number < 5, "web").when(number < 10, "forum").when(number < 15, "books").otherwise("reference")


def count_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t-\\r]+")), F.lit(0)).cast("long")


def share_out(amount: float, weights: Sequence[float], limits: Sequence[float]) -> list[float]:
    """Parts of `amount` in proportion to the weights, none above its limit."""
    parts, free, left = [0.0] * len(weights), set(range(len(weights))), min(amount, sum(limits))
    while free and left > 0:
        total = sum(weights[i] for i in free) or 1.0
        full = [i for i in sorted(free) if limits[i] <= left * weights[i] / total]
        if not full:
            for i in free:
                parts[i] = left * weights[i] / total
            break
        for i in full:
            parts[i] = limits[i]
            free.discard(i)
        left = min(amount, sum(limits)) - sum(parts)
    return parts


def leaf_budgets(tokens: Mapping[tuple, int], weights: Mapping[str, Mapping[str, float]], levels: Sequence[str], budget: float, max_epochs: int) -> dict[tuple, int]:
    """Whole tokens for each leaf (a tuple of level values)."""
    out: dict[tuple, int] = {}

    def give(prefix: tuple, leaves: list[tuple], amount: float) -> None:
        depth = len(prefix)
        if depth == len(levels):
            out[prefix] = int(amount + 1e-6)
            return
        children: dict = {}
        for leaf in leaves:
            children.setdefault(leaf[depth], []).append(leaf)
        names = sorted(children, key=lambda x: (x is not None, x or ""))
        known = weights.get(levels[depth], {})
        least = min(known.values(), default=1.0)
        parts = share_out(amount, [known.get(n, least) for n in names], [float(max_epochs * sum(tokens[x] for x in children[n])) for n in names])
        for n, part in zip(names, parts):
            give((*prefix, n), children[n], part)

    give((), list(tokens), float(budget))
    return out


def _drawn(
    documents: DataFrame, levels: Mapping[str, Column], weights: Mapping[str, Mapping[str, float]], budget: int | None, max_epochs: int, seed: int, max_leaves: int,
) -> DataFrame:
    """row (a struct of the drawn row's columns), n_tokens, epoch. The levels' columns come from `documents`."""
    spark, places = documents.sparkSession, [f"l{k}" for k in range(len(levels))]
    # The row travels as one struct, so that no column of it can clash with those of the plan.
    row, node = F.struct(*quoted(documents.columns)).alias("row"), [c.alias(p) for p, c in zip(places, levels.values())]
    docs = documents.select(row, *node, count_tokens(F.col("text")).alias("n_tokens"))
    sums = docs.groupBy(*places).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows")).limit(max_leaves + 1).collect()
    if len(sums) > max_leaves:
        raise ValueError(f"the tree has more than {max_leaves} leaves")
    tokens = {tuple(r[:len(places)]): int(r.tokens) for r in sums}
    parts = {tuple(r[:len(places)]): max(1, math.isqrt(r.rows)) for r in sums}
    given = leaf_budgets(tokens, weights, list(levels), sum(tokens.values()) if budget is None else budget, max_epochs)
    plan = []
    for leaf, amount in given.items():
        full, rest = divmod(amount, tokens[leaf]) if tokens[leaf] else (1, 0)
        plan.append((*leaf, int(full), int(rest), parts[leaf]))
    kinds = ", ".join(f"p{k} {docs.schema[p].dataType.simpleString()}" for k, p in enumerate(places))

    def at_leaf(plan: list[tuple], more: str) -> DataFrame:
        """Documents with their leaf's row of the plan (at most max_leaves rows), place in its order and bucket of the order."""
        same = F.lit(True)
        for k, p in enumerate(places):
            same = same & F.col(p).eqNullSafe(F.col(f"p{k}"))
        found = docs.join(F.broadcast(spark.createDataFrame(plan, f"{kinds}, whole int, rest long, parts long{more}")), same)
        order = F.xxhash64(F.lit(seed), F.col("whole"), F.col("row.doc_id"), F.coalesce(F.col("row.text"), F.lit("")))
        bucket = F.floor((order / F.lit(2.0**64) + 0.5) * F.col("parts"))
        return found.withColumn("order", order).withColumn("bucket", F.least(bucket, F.col("parts") - 1))

    sums = at_leaf(plan, "").where("rest > 0").groupBy(*places, "rest", "bucket").agg(F.sum("n_tokens").alias("n"))
    along = Window.partitionBy(*places).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    running = sums.withColumn("after", F.sum("n").over(along)).where("after > rest")
    edges = running.groupBy(*places).agg(F.min("bucket").alias("edge"), F.min_by(F.col("after") - F.col("n"), "bucket").alias("base")).collect()  # at most a row for each leaf
    found = {tuple(r[: len(places)]): (r.edge, r.base) for r in edges}
    plan = [(*p, *found.get(p[: len(places)], (p[-1] if p[-2] else -1, 0))) for p in plan]
    dealt = at_leaf(plan, ", edge long, base long")
    clear = dealt.where("bucket <> edge").select("row", "n_tokens", (F.col("whole") + (F.col("bucket") < F.col("edge")).cast("int")).alias("times"))
    within = Window.partitionBy(*places).orderBy("order", F.col("row.doc_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    taken = (F.col("base") + F.sum("n_tokens").over(within)) <= F.col("rest")
    edge = dealt.where("bucket = edge").select("row", "n_tokens", (F.col("whole") + taken.cast("int")).alias("times"))
    return clear.unionByName(edge).where("times > 0").select("row", "n_tokens", F.explode(F.sequence(F.lit(0), F.col("times") - 1)).alias("epoch"))


def mix(
    documents: DataFrame, levels: Sequence[str] = DEFAULT_LEVELS, weights: Mapping[str, Mapping[str, float]] = DEFAULT_WEIGHTS, budget: int | None = None,
    max_epochs: int = 4, seed: int = 17, max_leaves: int = 100_000,
) -> DataFrame:
    """The drawn rows, with their columns and n_tokens, epoch (0 is the first).

    `budget` is in tokens; without one it is what the table holds. Columns named n_tokens and epoch are
    replaced.
    """
    rows = documents.drop("n_tokens", "epoch")
    return _drawn(rows, {c: F.col(c) for c in levels}, weights, budget, max_epochs, seed, max_leaves).select("row.*", "n_tokens", "epoch")


def draw(documents: DataFrame) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens, epoch of every drawn document under the default tree."""
    rows = documents.select("doc_id", "text", "lang", "source").withColumn("domain", domain_of(F.col("source")))
    return mix(rows).select("doc_id", "domain", "lang", "source", "n_tokens", "epoch")


def keep_mixed(documents: DataFrame, budget: int | None = None, max_epochs: int = 4, seed: int = 17, max_leaves: int = 100_000) -> DataFrame:
    """The drawn rows in the columns of `documents`, all untouched; a document drawn for several epochs is repeated."""
    levels = {"domain": domain_of(F.col("source")), "lang": F.col("lang"), "source": F.col("source")}
    return _drawn(documents, levels, DEFAULT_WEIGHTS, budget, max_epochs, seed, max_leaves).select("row.*")
