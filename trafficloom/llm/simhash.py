"""Operator 6: SimHash fingerprints of documents, DataFrame functions only.

A text's terms are its words, each with the word after it. Every term's 64-bit hash votes on 64
signed bits with a weight that grows with the term's length; the signs are the fingerprint. The votes
are counted two bits to a long, so the aggregation has 32 sums.

Search: a fingerprint is cut into blocks. Two fingerprints within the radius agree in all but
`radius` blocks at least, so for each choice of blocks a table keyed by them holds both under one key;
candidates are checked with the exact Hamming distance. Equal fingerprints are one entry. Where many
fingerprints share a key their pairs are not made: two of them within the radius have a fingerprint between
them, at most half the radius from the one and the rest from the other, so each is entered under all
fingerprints that near and linked with the smallest of those at most half the radius off. All members of such
an entry are within the radius of that one, so the classes are the same and the work is linear in members.

Classes: documents whose fingerprints are reached from each other by steps within the radius are one class,
named by its smallest doc_id.

Defined cases: null and empty texts have one empty term, so all of them share one fingerprint; a bit
whose votes tie is 0; very long texts are taken whole, as rows of terms; null ids come before all others,
and a class of null ids alone has a null name; rows of equal doc_id are ordered by their text's hash; the
document after the last is the first, so a single document follows itself; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, partitions_for
from .components import components

LANES = 0x0000000100000001
FEW = 100_000  # rows of two or three longs (some MB on the driver) that may be broadcast
CROWD = 128  # members of a key above which they are linked through the fingerprints between them: no link depends on it


def terms(text: Column) -> Column:
    """Array of (word, next word); the last word stands alone."""
    words = F.split(F.lower(text), "[ \\t-\\r]+")
    return F.arrays_zip(words.alias("word"), F.slice(words, 2, F.greatest(F.size(words), F.lit(1))).alias("after"))


def votes(term: Column) -> list[Column]:
    """The sums that hold a text's votes: 32 of two lanes each, and the total weight."""
    weight = F.when(term.isNull(), 0).otherwise(1 + F.least(F.lit(3), F.length(term["word"]) / 4).cast("int")).cast("long")
    h = F.xxhash64(term["word"], term["after"])
    lanes = [F.sum(F.shiftrightunsigned(h, i).bitwiseAND(F.lit(LANES)) * weight).alias(f"v{i}") for i in range(32)]
    return [*lanes, F.sum(weight).alias("weight")]


def signs() -> Column:
    """The fingerprint from the columns that votes() made."""
    bits = []
    for i in range(32):
        low, high = F.col(f"v{i}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(F.col(f"v{i}"), 32)
        for at, ones in ((i, low), (i + 32, high)):
            bits.append(F.when(2 * ones > F.col("weight"), F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")) if at == 0 else F.shiftleft(F.when(2 * ones > F.col("weight"), F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")), at))
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return total


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits, 0 to 1."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / 64


def hex_of(fingerprint: Column) -> Column:
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")


def fingerprints(df: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """One fingerprint for each distinct `key`; rows of a key are parts of one text."""
    each = df.select(*key, F.explode_outer(terms(F.coalesce(F.col(text), F.lit("")))).alias("term"))
    return each.groupBy(*key).agg(*votes(F.col("term"))).select(*key, signs().alias("fingerprint"))


def _id_ranges(ids: DataFrame, parts: int) -> tuple[list[int], bool]:
    """Ids that begin a range, the smallest first, and whether there are null ids."""
    at = [k / parts for k in range(1, parts)]
    got = ids.agg(F.min("doc_id").alias("least"), F.percentile_approx("doc_id", at or [0.5], 10_000).alias("cuts"), (F.count("*") > F.count("doc_id")).alias("nulls")).first()
    cuts = {*([got.least] if got.least is not None else []), *(got.cuts or [] if at else [])}
    return sorted(cuts), bool(got.nulls)


def with_next(documents: DataFrame) -> DataFrame:
    """Columns range, place, doc_id, text, next_range, next_place, next_id, next_text; place numbers the rows of a range.

    Rows are dealt to ranges of doc_id; the first document of a range is also put after the range
    before it (of all: after the last range), so each range finds its followers by itself.
    """
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    starts, nulls = _id_ranges(documents.select("doc_id"), min(20_000, 4 * partitions_for(rows)))
    # Two steps over a list of lists keep the comparisons at the square root of the number of ranges.
    step = max(1, int(len(starts) ** 0.5))
    groups = [starts[a: a + step] for a in range(0, len(starts), step)] or [[0]]
    coarse = F.greatest(F.lit(1), F.size(F.filter(F.lit([g[0] for g in groups]), lambda b: b <= F.col("doc_id"))))
    fine = F.size(F.filter(F.element_at(F.array(*[F.lit(g) for g in groups]), coarse), lambda b: b <= F.col("doc_id")))
    own = F.when(F.col("doc_id").isNull(), 0).otherwise((coarse - 1) * step + fine - 1)
    begins = F.col("doc_id").isNull() if nulls else F.lit(False)
    if starts:
        begins = begins | F.coalesce(F.element_at(F.lit(starts), F.col("range") + 1) == F.col("doc_id"), F.lit(False))
        if nulls:  # then the smallest id is no longer the first
            begins = begins & (F.col("doc_id").isNull() | (F.col("range") > 0))
    before = F.when(F.col("range") == 0, max(0, len(starts) - 1)).otherwise(F.col("range") - 1)
    place = F.struct(F.col("range").alias("range"), F.lit(False).alias("guest"))
    guest = F.struct(before.alias("range"), F.lit(True).alias("guest"))
    dealt = rows.withColumn("range", own).withColumn("place", F.explode(F.when(begins, F.array(place, guest)).otherwise(F.array(place))))
    dealt = dealt.select(F.col("place.range").alias("range"), F.col("place.guest").alias("guest"), F.col("range").alias("home"), "doc_id", "text")
    order = Window.partitionBy("range").orderBy("guest", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    place = F.row_number().over(order)
    follower = [F.lead(c).over(order).alias(f"next_{c}") for c in ("doc_id", "text", "guest", "home")]
    found = dealt.select("*", place.alias("place"), *follower).where(~F.col("guest"))
    return found.select(
        "range", "place", "doc_id", "text", F.col("next_home").alias("next_range"),
        F.when(F.col("next_guest"), 1).otherwise(F.col("place") + 1).alias("next_place"),  # a guest is the first of its own range
        F.col("next_doc_id").alias("next_id"), "next_text",
    )


def edited(documents: DataFrame) -> DataFrame:
    """with_next, and the text whose last half the next document's beginning replaces, with its SHA-256."""
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    text = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 2) as int))"), F.substring(F.col("next_text"), F.lit(1), half))
    return with_next(documents).withColumn("edited", text).withColumn("n_chars", n.cast("long")).withColumn("sha", F.unhex(F.sha2(F.col("edited"), 256)))


def digest() -> Column:
    return F.lower(F.hex("sha")).alias("edited_sha256")


def edit_digests(documents: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256 of edit_report by its own editing step, without fingerprints and classes."""
    return edited(documents).select("doc_id", "n_chars", digest())


def block_tables(prints: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """One row for each fingerprint and choice of blocks - radius blocks: table, key, fingerprint."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    masks = []
    for chosen in combinations(range(blocks), blocks - radius):
        mask = sum(((1 << (edges[k + 1] - edges[k])) - 1) << edges[k] for k in chosen)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    each = prints.select("fingerprint", F.posexplode(F.lit(masks)).alias("table", "mask"))
    return each.select("table", F.col("fingerprint").bitwiseAND(F.col("mask")).alias("key"), "fingerprint")


def near(prints: DataFrame, others: DataFrame, radius: int = 3, blocks: int = 6, how: str = "inner") -> DataFrame:
    """Pairs (fingerprint, other) of different fingerprints within the radius, each once: a stated set against others.

    Both inputs have distinct fingerprints. With how="left_semi" the fingerprints that have a partner. The pairs of
    a whole table grow with the square of its groups; `classes` is for these.
    """
    a, b = block_tables(prints, radius, blocks).alias("a"), block_tables(others, radius, blocks).withColumnRenamed("fingerprint", "other").alias("b")
    close = (F.col("a.table") == F.col("b.table")) & (F.col("a.key") == F.col("b.key")) & (F.col("fingerprint") != F.col("other")) & (F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("other"))) <= radius)
    joined = a.join(b, close, how)
    return joined.select("fingerprint").distinct() if how == "left_semi" else joined.select("fingerprint", "other").distinct()


def _wide(masks: list[int]) -> Column:
    return F.lit([m - (1 << 64) if m >> 63 else m for m in masks])


def _between(radius: int) -> tuple[list[int], list[int]]:
    """Bits to flip towards fingerprints at most half the radius off, and at most the rest of it off."""
    def within(reach: int) -> list[int]:
        return [sum(1 << b for b in bits) for n in range(reach + 1) for bits in combinations(range(64), n)]

    return within(radius // 2), within(radius - radius // 2)


def _small(df: DataFrame) -> DataFrame:
    """df, broadcast if a count shows that it has at most FEW rows."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def links(prints: DataFrame, radius: int = 3, blocks: int = 6, crowd: int = CROWD) -> DataFrame:
    """Pairs (a, b) of the distinct fingerprints `prints` that are within the radius and connect all that are.

    Keys of at most `crowd` members give their pairs within the radius, but for those that a smaller member is near
    on both sides (that one's own pairs connect them). Members of other keys are linked through the fingerprints
    between them.
    """
    def close(x: Column, y: Column) -> Column:
        return F.bit_count(x.bitwiseXOR(y)) <= radius

    table = block_tables(prints, radius, blocks)
    shared = table.groupBy("table", "key").agg(F.count("*").alias("n")).where("n > 1")
    members = materialise(table.join(shared, ["table", "key"]), "fingerprint-keys")
    lists = members.where(F.col("n") <= crowd).groupBy("table", "key").agg(F.collect_list("fingerprint").alias("of"))
    each = lists.select("of", F.explode("of").alias("a"))
    below = each.withColumn("below", F.filter("of", lambda z: (z < F.col("a")) & close(z, F.col("a"))))
    above = F.filter("of", lambda b: (b > F.col("a")) & close(b, F.col("a")) & ~F.exists("below", lambda z: close(z, b)))
    direct = below.select("a", F.explode(above).alias("b"))

    hot = materialise(members.where(F.col("n") > crowd).select("fingerprint").distinct(), "fingerprint-crowds")
    near, far = _between(radius)
    entered = [hot.select("fingerprint", F.explode(_wide(m)).alias("flip")).select("fingerprint", F.col("fingerprint").bitwiseXOR(F.col("flip")).alias("middle")) for m in (near, far)]
    heads = materialise(entered[0].groupBy("middle").agg(F.min("fingerprint").alias("head")), "fingerprint-heads")
    around = entered[1].join(_small(heads), "middle").where(F.col("head") != F.col("fingerprint"))
    starred = around.select(F.least("head", "fingerprint").alias("a"), F.greatest("head", "fingerprint").alias("b"))
    return direct.unionByName(starred).distinct()


def classes(table: DataFrame, radius: int = 3, blocks: int = 6, crowd: int = CROWD) -> DataFrame:
    """fingerprint, class_id, class_size of each fingerprint of `table` (doc_id, fingerprint) that more than one document is near."""
    distinct = materialise(table.groupBy("fingerprint").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")), "fingerprints-distinct")
    linked = components(links(distinct.select("fingerprint"), radius, blocks, crowd)).withColumnRenamed("node", "fingerprint")
    placed = materialise(distinct.join(linked, "fingerprint", "left").where("n > 1 or component is not null").withColumn("component", F.coalesce("component", "fingerprint")), "fingerprint-classes")
    named = placed.groupBy("component").agg(F.min("first").alias("class_id"), F.sum("n").alias("class_size"))
    return placed.select("fingerprint", "component").join(_small(named), "component").select("fingerprint", "class_id", "class_size")


def edit_report(documents: DataFrame, radius: int = 3) -> DataFrame:
    """doc_id, n_chars, edited_sha256, both fingerprints, likenesses, whether another document is near, class and its size."""
    key = ["range", "place", "doc_id", "next_range", "next_place", "n_chars", "sha"]
    versions = F.array(*[F.struct(F.lit(k).alias("which"), F.col(c).alias("text")) for k, c in enumerate(("text", "edited"))])
    rows = edited(documents).select(*key, F.explode(versions).alias("version"))
    prints = fingerprints(rows.select(*key, "version.which", "version.text"), [*key, "which"])
    of = [F.max(F.when(F.col("which") == k, F.col("fingerprint"))).alias(c) for k, c in enumerate(("fingerprint", "edited_fingerprint"))]
    table = materialise(prints.groupBy(*key).agg(*of), "fingerprints")
    after = table.select(F.col("range").alias("next_range"), F.col("place").alias("next_place"), F.col("fingerprint").alias("next_fingerprint"))
    grouped = materialise(classes(table.select("doc_id", "fingerprint"), radius, 6), "classes")
    found = table.join(after, ["next_range", "next_place"]).join(_small(grouped), "fingerprint", "left")
    return found.select(
        "doc_id", "n_chars", digest(),
        hex_of(F.col("fingerprint")).alias("fingerprint"), hex_of(F.col("edited_fingerprint")).alias("edited_fingerprint"),
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
        F.col("class_size").isNotNull().alias("has_near"), F.when(F.col("class_size").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"),
    )
