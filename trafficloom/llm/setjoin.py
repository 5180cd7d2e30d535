"""Operator 2: exact Jaccard self-join of word n-gram sets by universe-partition pigeonhole.

Sets that can link have sizes in one band or in neighbouring bands. Pairs whose larger set is in band i
use the scheme of band i, which hashes the universe of n-grams into `exact` segments, whose subset is a
key, and `loose` segments, whose subset and all its one-deletion neighbours are keys. A link whose
symmetric difference is at most H and that has no common loose key differs by two or more in each loose
segment, hence in at most D = H - 2 * loose exact segments. Both sets put their exact segments into one
shared order (largest first, then by hash): the j-th equal segment has at most D unequal and j - 1 equal
ones before it. So each set keeps only its first D + 1 + extra segments, with its own D (from its size
and the largest partner it can have in the band), and linked sets still share 1 + extra of them.
`allocate` picks the numbers of segments by the expected cost of keys and of false candidates. Hashes of
subsets are sums of hashes, so a deletion is a subtraction.

Hot groups. Equal sets are one class. Under a key, members are paired with one of them (first within
a task's rows, then over all), not with each other. Verified links give components; pairs within a
component need no check. Where a key still joins members of different components, the rest of its pairs
matter: they are made if the key has few members. Of its keys with many members each set may leave out
its `extra` hottest ones (in an order that all sets share), because a link that has no other key has
1 + extra of them; the groups that remain are searched by `differences`. So no link that matters is lost
and no bucket is capped.

Verification is exact, on the n-grams of the whole texts; pairs whose sizes or sketches (counts of members
in parts of the hash range) already differ by more than a link allows are left out before it. A class of
equal set digests is checked in the same way where its members' word sequences differ.

Defined cases: null and empty texts have no n-grams and link with nothing; texts with fewer words
than n are one n-gram; very long texts are taken whole, one at a time; rows of one doc_id count as one
document, whose links are those of any of its texts, with one result row each; repeated rows and ties
give the same result in any order; rows with a null id get a null component; an empty table gives an
empty result; further columns, whatever their names, are ignored, and kept by `keep_one`.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, join_ids, materialise, prepare, quoted, record_batch
from .components import components
from .differences import FEW, candidates, pairs_of_few


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass(frozen=True)
class Likeness:
    """Word n-grams, and the threshold: link if den * common >= num * union."""

    words: int = 5
    num: int = 80
    den: int = 100


@dataclass(frozen=True)
class Scheme:
    """Segments for the pairs whose larger set is in one size band.

    spare: exact segments beyond those that the band's largest difference needs; extra: how many keys,
    beyond the first, a link without a common loose key has in common.
    """

    exact: int
    loose: int
    spare: int
    extra: int = 0


def band_starts(like: Likeness, largest: int) -> list[int]:
    """First size of each band; a set's partners are in its own or a neighbouring band.

    Wide bands: only sets whose partners can reach the next band have keys there.
    """
    ratio = like.den / like.num
    steps = max(1, round(math.log(BAND_RATIO) / math.log(ratio)))
    out = [1]
    while out[-1] <= largest:
        end = out[-1]
        for _ in range(steps):
            end = end * like.den // like.num + 1
        out.append(end)
    return out


def difference_limit(like: Likeness, size: int, partner: int | None = None) -> int:
    """Greatest symmetric difference of linked sets of at most these sizes (one size: for both)."""
    return (size + (size if partner is None else partner)) * (like.den - like.num) // (like.den + like.num)


BAND_RATIO = 1.5625
EXTRA = 8  # a link has one more common key for each so many keys that it needs


@lru_cache(maxsize=4096)
def allocate(limit: int, size: int, sets: int, common: float = 0.05, check_cost: float = 100.0) -> Scheme:
    """The cheapest scheme for a band of sets of at most `size` members that differ by at most `limit`.

    Costs are in keys: one for each key of each set, and `check_cost` for each false candidate, when a
    member of one set is found in an unrelated one with probability `common`.
    """
    best, least = Scheme(limit + 1, 0, 0), math.inf
    for loose in sorted({0, (limit + 1) // 4, (limit + 1) // 2, (limit + 2) // 2}):
        need = max(0, limit - 2 * loose + 1)
        extra = -(-need // EXTRA)
        for spare in sorted({0, *(math.ceil(limit * x) for x in (0.1, 0.2, 0.35, 0.5, 1.0))}) if need else [0]:
            exact = need + extra + spare if need else 0
            mean = 0.8 * size / (exact + loose)
            keys = need + extra + loose * (1 + mean)
            false, chance, skipped = 0.0, math.exp(-mean), spare / exact if exact else 0.0
            for s in range(int(mean + 6 * math.sqrt(mean)) + 2):
                kept = max(0.0, chance - skipped)
                skipped = max(0.0, skipped - chance)
                false += exact * kept * common**s + loose * chance * (1 + 2 * s) * common ** max(0, s - 1)
                chance *= mean / (s + 1)
            cost = sets * keys + check_cost * sets * sets / 2 * min(1.0, false)
            if cost < least:
                best, least = Scheme(exact, loose, spare, extra), cost
    return best


class Hashes:
    """Stable 64-bit hashes of words through a bounded memo."""

    def __init__(self, limit: int = 200_000):
        self.known: dict[bytes, int] = {}
        self.limit = limit

    def of(self, words: list[bytes]) -> np.ndarray:
        try:
            return np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            if len(self.known) > self.limit:
                self.known = {}
            known, new = self.known, xxhash.xxh3_64_intdigest
            for w in words:
                if w not in known:
                    known[w] = new(w)
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()  # bytes.lower() changes A-Z only


def gram_hashes(text: str, n: int) -> np.ndarray:
    """Sorted distinct hashes of the text's n-grams."""
    return hashed_grams(words_of(text), n, Hashes(0))


def hashed_grams(words: list[bytes], n: int, memo: Hashes) -> np.ndarray:
    h = memo.of(words)
    if not len(h):
        return h
    width = min(n, len(h))
    out = np.full(len(h) - width + 1, np.uint64(width))
    for k in range(width):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k: len(h) - width + 1 + k])
    return np.unique(out)


def sketch(members: np.ndarray) -> bytes:
    """Members in each of a power of two of parts of the hash range, at most 255 (which says: unknown).

    There are about eight members to a part. Sets that differ by d have sketches within d.
    """
    bits = max(6, (len(members) // 8).bit_length())
    return np.minimum(np.bincount((members >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def apart(x: bytes, y: bytes) -> int:
    """A lower bound of the symmetric difference of two sets, from their sketches."""
    width, folded = min(len(x), len(y)), []
    for z in (x, y):
        parts = np.frombuffer(z, np.uint8).reshape(width, -1)
        folded.append((parts.sum(axis=1, dtype=np.int64), (parts == 255).any(axis=1)))
    (a, hidden), (b, also) = folded
    return int(np.abs(a - b)[~(hidden | also)].sum())


def grams(text: str, n: int) -> set[bytes]:
    """The n-grams themselves; words hold no blanks, so joining them is unambiguous."""
    words = words_of(text)
    if len(words) < n:
        return {b" ".join(words)} if words else set()
    return set(map(b" ".join, zip(*(words[k:] for k in range(n)))))


def keys_of(members: np.ndarray, band: int, scheme: Scheme, limit: int | None = None) -> np.ndarray:
    """Index keys of a set under the scheme of a band.

    limit: greatest difference to the set's partners in the band, if less than the band's. The lowest bit
    of a key tells odd from even bands, the second one loose from exact segments.
    """
    total = scheme.exact + scheme.loose
    own = mix(members + np.uint64((band + 1) * 0x632BE59BD9B4E019 & (2**64 - 1)))
    segment = (own >> np.uint64(32)) * np.uint64(total) >> np.uint64(32)
    order = np.argsort(segment, kind="stable")
    segment, own = segment[order].astype(np.int64), own[order]
    first = np.searchsorted(segment, np.arange(total + 1))
    size = np.diff(first)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(own)])
    sums = sums[first[1:]] - sums[first[:-1]]
    place = np.arange(total).astype(np.uint64) + np.uint64(1) + np.uint64(band) * np.uint64(1 << 40)
    keys = mix(sums + mix(place)) & ~np.uint64(3) | np.uint64(band & 1)
    exact, kept = keys[: scheme.exact], scheme.exact - scheme.spare
    if limit is not None:
        need = max(0, limit - 2 * scheme.loose + 1)
        kept = min(kept, need + scheme.extra) if need else 0
    if kept < scheme.exact:
        rank = np.lexsort((exact, size[: scheme.exact]))
        exact = exact[rank[scheme.exact - kept:]]
    if not scheme.loose:
        return exact
    a = first[scheme.exact]
    shorter = mix(sums[segment[a:]] - own[a:] + mix(place[segment[a:]])) & ~np.uint64(3) | np.uint64(band & 1)
    return np.concatenate([exact, keys[scheme.exact:] | np.uint64(2), shorter | np.uint64(2)])


class Index:
    """All schemes of a likeness over a collection with the given number of texts by length."""

    def __init__(self, like: Likeness, lengths: dict[int, int]):
        """lengths: texts by binary logarithm of their length; only costs depend on it, never results."""
        self.like, self.lengths, self.schemes, self.starts = like, lengths, {}, [1]

    def scheme(self, band: int, start: int, end: int) -> Scheme:
        if band not in self.schemes:
            about = sum(n for k, n in self.lengths.items() if abs(k - math.log2(6 * end)) <= 1) / 3
            self.schemes[band] = allocate(difference_limit(self.like, end), end, int(about) + 1)
        return self.schemes[band]

    def bands(self, n: int) -> list[tuple[int, Scheme, int]]:
        """(band, scheme, greatest difference to a partner) where a set of n members has keys."""
        widest, out = n * self.like.den // self.like.num, []  # the largest set it can link with
        if self.starts[-1] <= n:
            self.starts = band_starts(self.like, 2 * n)
        band = int(np.searchsorted(self.starts, n, side="right")) - 1
        while len(self.starts) < band + 3:
            self.starts = band_starts(self.like, self.starts[-1])
        for b in (band, band + 1):
            start, end = self.starts[b], self.starts[b + 1] - 1
            if widest >= start:
                out.append((b, self.scheme(b, start, end), difference_limit(self.like, n, min(widest, end))))
        return out

    def keys(self, members: np.ndarray) -> np.ndarray:
        return np.concatenate([keys_of(members, *band) for band in self.bands(len(members))])

    def extra(self, n: int) -> tuple[int, int]:
        """How many exact keys a set of n members may leave out in even and in odd bands."""
        found = [0, 0]
        for band, scheme, _ in self.bands(n) if n else ():
            found[band & 1] = min(scheme.extra, 32767)
        return found[0], found[1]


LISTS = ("keys", "star_keys", "star_pivots")
SETS_SQL = "doc_id long, n_shingles long, digest binary, words binary, sketch binary, even short, odd short, " + ", ".join(f"{c} array<long>" for c in LISTS)
SETS = pa.schema([
    ("doc_id", pa.int64()), ("n_shingles", pa.int64()), *((c, pa.binary()) for c in ("digest", "words", "sketch")),
    ("even", pa.int16()), ("odd", pa.int16()), *((c, pa.list_(pa.int64())) for c in LISTS),
])
WINDOW = 700_000  # keys (11 MB) among which a task finds its common ones


def _lists(values: np.ndarray, row: np.ndarray, n: int) -> pa.ListArray:
    """Values grouped by row number (ascending) as n lists."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32)), pa.array(values.astype(np.int64)))


class _Window:
    """Rows of a task until their keys are enough to be compared."""

    def __init__(self):
        self.ids, self.columns, self.keys, self.rows, self.n_keys = [], {c: [] for c in ("n_shingles", "digest", "words", "sketch", "even", "odd")}, [], [], 0

    def add(self, doc_id, keys: np.ndarray | None, **values) -> None:
        if keys is not None:
            self.keys.append(keys)
            self.rows.append(np.full(len(keys), len(self.ids)))
            self.n_keys += len(keys)
        self.ids.append(doc_id)
        for c, v in values.items():
            self.columns[c].append(v)

    def batch(self) -> pa.RecordBatch:
        """A key has one row that leads it, that of the smallest doc_id; the others name this one as their pivot."""
        n, empty = len(self.ids), np.zeros(0, np.int64)
        key, row = np.concatenate([np.zeros(0, np.uint64), *self.keys]).view(np.int64), np.concatenate([empty, *self.rows])
        doc = np.array([x if x is not None else 0 for x in self.ids], np.int64)
        order = np.lexsort((doc[row], key))
        key, row = key[order], row[order]
        leads = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool)
        pivot = doc[row[np.maximum.accumulate(np.where(leads, np.arange(len(key)), 0))]] if len(key) else empty
        lead, star = (x[np.argsort(row[x], kind="stable")] for x in (np.nonzero(leads)[0], np.nonzero(~leads)[0]))
        lists = [_lists(key[lead], row[lead], n), _lists(key[star], row[star], n), _lists(pivot[star], row[star], n)]
        plain = [pa.array(v, type=SETS.field(c).type) for c, v in self.columns.items()]
        return pa.RecordBatch.from_arrays([pa.array(self.ids, pa.int64()), *plain, *lists], schema=SETS)


def indexed(documents: DataFrame, like: Likeness) -> DataFrame:
    """Per row: size, digests and sketch of its set, its keys, and (key, pivot) where its task has a pivot for a key.

    Only the first row of a digest in a task has keys. A key has one row that leads it in each window of
    a task, so even a key of all documents has no more rows to shuffle than there are windows.
    """
    prepare(documents.sparkSession)
    sizes = documents.where(F.length("text") > 0).groupBy(F.floor(F.log2(F.length("text"))).alias("k")).agg(F.count("*").alias("n"))
    lengths = {int(r.k): r.n for r in sizes.collect()}

    def run(it):
        index, memo, seen, window = Index(like, lengths), Hashes(), set(), _Window()
        for part, texts in batches(it, 1, 4_000_000):
            for doc_id, text in zip(part.column(0).to_pylist(), texts):
                words = words_of(text)
                members = hashed_grams(words, like.words, memo)
                digest = xxhash.xxh3_128_digest(members.tobytes()) if len(members) else None
                keys, (even, odd) = None, index.extra(len(members))
                if digest and doc_id is not None and digest not in seen:
                    seen.add(digest)
                    keys = index.keys(members)
                window.add(
                    doc_id, keys, n_shingles=len(members), digest=digest, words=hashlib.blake2b(b" ".join(words), digest_size=16).digest() if digest else None,
                    sketch=sketch(members), even=even, odd=odd,
                )
                if window.n_keys > WINDOW:
                    yield window.batch()
                    window = _Window()
        if window.ids:
            yield window.batch()

    return materialise(documents.select("doc_id", "text").mapInArrow(run, SETS_SQL), "gram-sets")


def plausible(pairs: DataFrame, sets: DataFrame, like: Likeness) -> DataFrame:
    """The pairs (a, b) without those whose sizes or sketches prove that they don't link; spares reading their texts."""
    prepare(pairs.sparkSession)
    known = sets.where("digest is not null").select("doc_id", "n_shingles", "sketch", "digest").dropDuplicates(["doc_id", "digest"])
    for end in ("a", "b"):
        pairs = pairs.join(known.select(F.col("doc_id").alias(end), F.col("n_shingles").alias(f"n_{end}"), F.col("sketch").alias(f"sketch_{end}")), end)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(it):
        for batch in it:
            total, x, y = (batch.column(k).to_pylist() for k in (2, 3, 4))
            good = pa.array([apart(x[i], y[i]) * (like.den + like.num) <= n * (like.den - like.num) for i, n in enumerate(total)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(good) for k in (0, 1)], schema=schema)

    near = F.abs(F.col("n_a") - F.col("n_b")) * (like.den + like.num) <= (F.col("n_a") + F.col("n_b")) * (like.den - like.num)
    left = pairs.where(near).select("a", "b", F.col("n_a") + F.col("n_b"), "sketch_a", "sketch_b").mapInArrow(run, "a long, b long")
    return materialise(left.distinct(), "plausible")


def verified(pairs: DataFrame, documents: DataFrame, like: Likeness) -> DataFrame:
    """The pairs (a, b) of ids whose texts' n-gram sets link (any text of an id that has several)."""
    prepare(pairs.sparkSession)
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    texts = materialise(join_ids(documents.select("doc_id", "text"), materialise(ids, "pair-ids"), "left_semi").distinct(), "pair-texts")
    both = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    both = both.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(it):
        held: tuple[str | None, set] = (None, set())
        for batch in it:
            a, b, ta, tb = (batch.column(k) for k in range(4))
            out: tuple[list, list] = ([], [])
            for i, (x, y) in enumerate(zip(a.to_pylist(), b.to_pylist())):
                text = tb[i].as_py() or ""
                if text != held[0]:
                    held = (text, grams(text, like.words))
                left, right = grams(ta[i].as_py() or "", like.words), held[1]
                common = len(left & right)
                if common and like.den * common >= like.num * (len(left) + len(right) - common):
                    out[0].append(x)
                    out[1].append(y)
            yield record_batch({"a": out[0], "b": out[1]}, schema)

    return materialise(both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long").distinct(), "links")


def _ordered(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def _classes(sets: DataFrame, documents: DataFrame, like: Likeness) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, rep) for every row, and (doc_id, rep) where they differ; rep has an equal set."""
    classes = sets.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min(F.struct("doc_id", "words")).alias("first"))
    classes = classes.select("digest", F.col("first.doc_id").alias("rep"), F.col("first.words").alias("rep_words"))
    classes = materialise(classes, "digests")  # a join of its own exchanges, so a hot digest can be split
    named = sets.select("doc_id", "n_shingles", "digest", "words").join(classes, "digest", "left")
    named = materialise(named.select("doc_id", "n_shingles", "rep", (F.col("words") != F.col("rep_words")).alias("reordered")), "classes")
    doubtful = named.where("reordered and doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).distinct()
    if doubtful.limit(1).count():  # same digest of the set, other words: hold the texts against each other
        doubtful = materialise(doubtful, "same-digests")
        if verified(doubtful, documents, like).count() < doubtful.count():
            raise RuntimeError("two different sets of n-grams have one 128-bit digest")
    return named.drop("reordered"), named.where("rep <> doc_id").select("doc_id", "rep").distinct()


def _stars(sets: DataFrame, stands: DataFrame) -> DataFrame:
    """Distinct (key, node, pivot): under each key, its members' classes, tied together through pivots."""
    keyed = sets.select(F.explode("keys").alias("key"), F.col("doc_id").alias("node"))
    pivots = keyed.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("last")).where("pivot <> last")
    pivots = materialise(pivots.select("key", "pivot"), "pivots")  # a join of its own exchanges, so a hot key can be split
    over_all = keyed.join(pivots, "key").where("node <> pivot")
    in_task = sets.select(F.explode(F.arrays_zip("star_keys", "star_pivots")).alias("s"), F.col("doc_id").alias("node"))
    in_task = in_task.select(F.col("s.star_keys").alias("key"), "node", F.col("s.star_pivots").alias("pivot"))
    stars = materialise(over_all.unionByName(in_task), "stars")
    for end in ("node", "pivot"):  # equal sets are one node
        stars = stars.join(stands.select(F.col("doc_id").alias(end), F.col("rep").alias(f"{end}_rep")), end, "left")
    stars = stars.select("key", F.coalesce("node_rep", "node").alias("node"), F.coalesce("pivot_rep", "pivot").alias("pivot"))
    return materialise(stars.where("node <> pivot").distinct(), "class-stars")


def _labelled(df: DataFrame, labels: DataFrame, node: str, name: str) -> DataFrame:
    got = labels.select(F.col("node").alias(node), F.col("component").alias(name))
    return df.join(got, node, "left").withColumn(name, F.coalesce(name, node))


def _thinned(members: DataFrame, sets: DataFrame) -> DataFrame:
    """members (key, node, part, size) of hot keys without the hottest exact keys that each node may leave out."""
    extra = sets.where("digest is not null").groupBy(F.col("doc_id").alias("node")).agg(F.min("even").alias("even"), F.min("odd").alias("odd"))
    odd, loose = F.col("key").bitwiseAND(F.lit(1)), F.col("key").bitwiseAND(F.lit(2))
    hottest = Window.partitionBy("node", odd, loose).orderBy(F.desc("size"), "key")
    ranked = members.join(extra, "node", "left").withColumn("at", F.row_number().over(hottest))
    return ranked.where((loose != 0) | (F.col("at") > F.coalesce(F.when(odd == 1, F.col("odd")).otherwise(F.col("even")), F.lit(0)))).select("key", "node", "part")


def _groups(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Distinct (grp, node, part) from members (key, node, part): keys that share their first nodes' groups are one group.

    A key starts with the component of its smallest node as its group. A group is then merged, twice, into
    the smallest group in which its smallest node is, so that near copies, which share most of their keys,
    meet in few groups. Merging never parts two members of a key.
    """
    firsts = _labelled(members.groupBy("key").agg(F.min("node").alias("least")), labels, "least", "grp").select("key", "grp")
    now = materialise(members.join(firsts, "key").select("grp", "node", "part").distinct(), "open-nodes")
    for _ in range(2):
        into = now.groupBy("node").agg(F.min("grp").alias("into"))
        moved = now.groupBy("grp").agg(F.min("node").alias("node")).join(into, "node").select("grp", "into")
        now = materialise(now.join(moved, "grp").select(F.col("into").alias("grp"), "node", "part").distinct(), "open-nodes")
    return now


def _rest(stars: DataFrame, labels: DataFrame, sets: DataFrame, documents: DataFrame, like: Likeness) -> DataFrame:
    """Pairs (a, b) under keys that still join different components: with the stars' pairs, all that can matter."""
    open_keys = _labelled(_labelled(stars, labels, "node", "x"), labels, "pivot", "y").where("x <> y").select("key").distinct()
    members = stars.join(open_keys, "key", "left_semi")
    members = members.select("key", "node").unionByName(members.select("key", F.col("pivot").alias("node"))).distinct()
    members = materialise(_labelled(members, labels, "node", "part"), "open-members")
    sizes = members.groupBy("key").agg(F.count("*").alias("size")).where("size > 2")
    sized = materialise(members.join(sizes, "key"), "open-sized")
    few = pairs_of_few(sized.where(F.col("size") <= FEW), "key")
    left = materialise(_thinned(sized.where(F.col("size") > FEW), sets), "open-thinned")
    groups = _groups(left, labels)
    return few.unionByName(candidates(groups, documents, partial(gram_hashes, n=like.words), like.num, like.den)).distinct()


def linked(documents: DataFrame, like: Likeness) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) for every row."""
    sets = indexed(documents, like)
    named, stands = _classes(sets, documents, like)
    stars = _stars(sets, stands)
    pairs = materialise(_ordered(stars, "node", "pivot"), "pairs")
    links = verified(plausible(pairs, sets, like), documents, like)
    labels = components(links)
    rest = _rest(stars, labels, sets, documents, like).join(pairs, ["a", "b"], "left_anti")
    more = verified(plausible(rest, sets, like), documents, like)
    labels = components(links.unionByName(more))
    return _labelled(named.withColumn("rep", F.coalesce("rep", "doc_id")), labels, "rep", "component_id").select("doc_id", "n_shingles", "component_id")


def keep_one(documents: DataFrame, like: Likeness = Likeness()) -> DataFrame:  # noqa: B008
    """The rows of `documents` without those that link, directly or not, with one of a smaller id.

    Of rows with equal id and text one stays; rows of one id with different texts stay or go together.
    """
    found = materialise(linked(documents, like), "linked")
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    kept = join_ids(documents, materialise(gone, "linked-away"), "left_anti")
    repeated = materialise(found.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id"), "repeated")
    if not repeated.limit(1).count():
        return kept.select(*quoted(documents.columns))
    once = join_ids(kept, repeated, "left_anti")
    again = join_ids(kept, repeated, "left_semi").dropDuplicates(["doc_id", "text"])
    return once.select(*quoted(documents.columns)).union(again.select(*quoted(documents.columns)))
