"""Operator 4: quality rules, with distribution divergence as the verdict.

The words of all documents are counted by language; the `TOP` most frequent ones of each language are its
common words. One pass over each whole text then gives the base counts, a histogram of character classes
and a histogram of common words. The histograms are summed over all documents of a language, and every
document is held against its language's sums, less its own share, by the Jensen-Shannon distance; texts
below the minimum lengths are not judged by it.

A language is a reference if it has `min_documents` documents or more, so a few documents with a label of
their own are no reference for themselves. More than `max_languages` references (the only thing that
is gathered, `TOP` words and some numbers for each) are an error.

Defined cases: null and empty texts have counts 0 and fail the base rule; texts of any length are measured
whole; documents whose language is null or no reference are held against the nearest reference (the first
by name of equally near ones); without any reference nothing diverges; of equally frequent words the
lesser in byte order comes first; rows are judged one by one, so repeated rows give repeated results (and
count repeatedly in the references); further columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, materialise, prepare, record_batch

TOP = 25  # common words of a language
MIN_SHARE = 0.01  # of all different texts that a reference language has
CLASSES = ("lower", "upper", "digit", "space", "stop", "mark", "sign", "beyond ASCII")
SIGNS = b"#*$%&|<>"


def _class_table() -> np.ndarray:
    """Class number of each byte; continuation bytes of UTF-8 have none, so code points are counted."""
    kind = np.full(256, 5)
    kind[[*range(97, 123)]], kind[[*range(65, 91)]], kind[[*range(48, 58)]] = 0, 1, 2
    kind[[32, *range(9, 14)]], kind[[*b".,;:!?'\"()-"]] = 3, 4
    kind[[*SIGNS, *b"@^_=~{}[]\\/+`"]] = 6
    kind[192:], kind[128:192] = 7, len(CLASSES)
    return kind


CLASS_OF = _class_table()


def repeated_words(words: list[bytes], width: int = 8) -> int:
    """Words that lie in a window of `width` words found twice or more (any of its places counts)."""
    n = len(words)
    if n <= width:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    h, size = mixed, 1
    while size < width:  # equal windows have equal sums; most texts end here, without a repeated one
        h = h[:-size] * np.uint64(0xBF58476D1CE4E5B9) + (h[size:] ^ (h[size:] >> np.uint64(31)))
        size *= 2
    order = np.sort(h)
    if not (order[1:] == order[:-1]).any():
        return 0
    rank, size = ids, 1
    while size < width:  # exact: a window's number is the number of its pair of halves
        _, rank = np.unique(rank[:-size] * (n + 1) + rank[size:], return_inverse=True)
        size *= 2
    twice = np.bincount(rank)[rank] > 1
    change = np.zeros(n + 1, np.int64)
    change[: n - width + 1] += twice
    change[width: n + 1] -= twice
    return int((np.cumsum(change[:n]) > 0).sum())


def measure(text: str, bins: dict[bytes, int] | None = None) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, class counts, common words' places, their counts)."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    by_byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    classes = np.bincount(CLASS_OF, by_byte, len(CLASSES) + 1)[: len(CLASSES)].astype(np.int64)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    common = {}
    if bins:
        counts = Counter(raw.lower().split())
        common = {bins[w]: counts[w] for w in bins.keys() & counts.keys()}
    return (
        len(words), int(classes.sum() - classes[3]), int(by_byte[[*SIGNS]].sum()), len(lines) - len(set(lines)), repeated_words(words), classes, [*common], [*common.values()],
    )


def jensen_shannon(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distance (0 to 1) between each histogram of p and q along the last axis."""
    p = p / np.maximum(1e-300, p.sum(axis=-1, keepdims=True))
    q = q / np.maximum(1e-300, q.sum(axis=-1, keepdims=True))
    m = (p + q) / 2
    part = lambda a: np.sum(np.where(a > 0, a * np.log2(np.where(a > 0, a, 1) / np.where(m > 0, m, 1)), 0), axis=-1)
    return np.sqrt(np.clip((part(p) + part(q)) / 2, 0, 1))


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
LISTS = ("classes", "places", "counts")
FEATURES_SQL = "doc_id long, lang string, " + ", ".join(f"{c} long" for c in BASE) + ", " + ", ".join(f"{c} array<long>" for c in LISTS)
FEATURES = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), *((c, pa.int64()) for c in BASE), *((c, pa.list_(pa.int64())) for c in LISTS)])


def reference_languages(documents: DataFrame, min_documents: int, max_languages: int, min_share: float = MIN_SHARE) -> list[str]:
    """Languages by name that have enough different texts: at least min_documents, and min_share of all different texts.

    Copies count once, so a text that is repeated doesn't vouch for itself. Of more than max_languages those with most
    different texts are taken.
    """
    texts = documents.groupBy("lang", F.xxhash64("text").alias("text")).agg(F.lit(1).alias("one"))
    sizes = texts.groupBy("lang").agg(F.count("*").alias("n"))
    least = F.greatest(F.lit(float(min_documents)), min_share * F.col("whole"))
    enough = sizes.crossJoin(F.broadcast(sizes.agg(F.sum("n").alias("whole")))).where(F.col("lang").isNotNull() & (F.col("n") >= least))  # one row
    return sorted(r.lang for r in enough.orderBy(F.desc("n"), "lang").limit(max_languages).collect())


def common_words(documents: DataFrame, langs: list[str]) -> list[bytes]:
    """The TOP most frequent words (A-Z lower-cased) of each of the languages, without repeats, in byte order."""
    prepare(documents.sparkSession)
    schema = pa.schema([("lang", pa.string()), ("word", pa.binary()), ("n", pa.int64())])

    def run(it):
        for part, texts in batches(it, 1):
            counts: dict[str, Counter] = {}
            for lang, text in zip(part.column(0).to_pylist(), texts):
                counts.setdefault(lang, Counter()).update(text.encode("utf-8", "surrogatepass").lower().split())
            for lang, own in counts.items():
                yield record_batch({"lang": [lang] * len(own), "word": [*own], "n": [*own.values()]}, schema)

    each = documents.where(F.col("lang").isin(langs)).select("lang", "text").mapInArrow(run, "lang string, word binary, n long")
    sums = each.groupBy("lang", "word").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    return sorted({bytes(r.word) for r in sums.withColumn("place", place).where(F.col("place") <= TOP).select("word").collect()}) if langs else []


def features(documents: DataFrame, words: list[bytes]) -> DataFrame:
    """Counts and histograms of each whole text; of the common words only those that occur."""
    prepare(documents.sparkSession)
    bins = {w: k for k, w in enumerate(words)}

    def run(it):
        for part, texts in batches(it, 2):
            got = [measure(t, bins) for t in texts]
            yield record_batch({"doc_id": part.column(0), "lang": part.column(1), **{n: [x[k] for x in got] for k, n in enumerate((*BASE, *LISTS))}}, FEATURES)

    return documents.select("doc_id", "lang", "text").mapInArrow(run, FEATURES_SQL)


def references(measured: DataFrame, langs: list[str], n_words: int) -> np.ndarray:
    """Sums of both histograms over all documents of each language: classes, common words, other words."""
    k = len(CLASSES)
    own = measured.where(F.col("lang").isin(langs))
    shifted = F.transform("places", lambda x: x + k)
    classes = own.select("lang", F.posexplode("classes").alias("place", "n"))
    common = own.select("lang", F.explode(F.arrays_zip(shifted.alias("place"), F.col("counts").alias("n"))).alias("x")).select("lang", "x.place", "x.n")
    every = own.select("lang", F.lit(k + n_words).alias("place"), F.col("n_words").alias("n"))
    out = np.zeros((len(langs), k + n_words + 1))
    at = {x: i for i, x in enumerate(langs)}
    for r in classes.unionByName(common).unionByName(every).groupBy("lang", "place").agg(F.sum("n").alias("total")).collect():
        out[at[r.lang], r.place] = r.total
    out[:, -1] -= out[:, k:-1].sum(axis=1)
    return out


def distances(classes: np.ndarray, common: np.ndarray, own: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances of rows of both histograms to their language's sums less their own, or to the nearest language's (own < 0)."""
    k, c, w = len(CLASSES), np.zeros(len(own)), np.zeros(len(own))
    known = own >= 0
    if known.any():
        rest = table[own[known]] - np.hstack([classes[known], common[known]])
        c[known], w[known] = jensen_shannon(classes[known], rest[:, :k]), jensen_shannon(common[known], rest[:, k:])
    if len(table) and not known.all():
        far = np.stack([[jensen_shannon(classes[~known], ref[:k]), jensen_shannon(common[~known], ref[k:])] for ref in table])
        nearest = far.sum(axis=1).argmin(axis=0)
        c[~known], w[~known] = far[nearest, 0, np.arange(len(nearest))], far[nearest, 1, np.arange(len(nearest))]
    return c, w


def judge(
    documents: DataFrame, class_limit: float = 0.32, word_limit: float = 0.36, min_chars: int = 300, min_words: int = 120, min_documents: int = 20, max_languages: int = 200,
) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and both distances, for every document."""
    langs = reference_languages(documents, min_documents, max_languages)
    words = common_words(documents, langs)
    measured = materialise(features(documents, words), "rule-features")
    table, at = references(measured, langs, len(words)), {x: k for k, x in enumerate(langs)}
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in BASE), ("class_distance", pa.float64()), ("word_distance", pa.float64())])

    def run(it):
        step = max(1, 2_000_000 // table.shape[1])  # rows whose dense histograms are held at once
        for whole in it:
            for batch in (whole.slice(a, step) for a in range(0, whole.num_rows, step)):
                n, n_words = batch.num_rows, batch.column(2).to_numpy()
                classes = np.array(batch.column(7).flatten()).reshape(n, -1).astype(float)
                common = np.zeros((n, len(words) + 1))
                row = np.repeat(np.arange(n), pc.list_value_length(batch.column(8)).to_numpy())
                common[row, batch.column(8).flatten().to_numpy()] = batch.column(9).flatten().to_numpy()
                common[:, -1] = n_words - common.sum(axis=1)
                c, w = distances(classes, common, np.array([at.get(x, -1) for x in batch.column(1).to_pylist()]), table)
                c, w = np.where(classes.sum(axis=1) < min_chars, 0.0, c), np.where(n_words < min_words, 0.0, w)
                yield record_batch({"doc_id": batch.column(0), **{x: batch.column(2 + i) for i, x in enumerate(BASE)}, "class_distance": c, "word_distance": w}, schema)

    got = measured.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in BASE) + ", class_distance double, word_distance double")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    kept = ~failed & (F.col("class_distance") <= class_limit) & (F.col("word_distance") <= word_limit)
    return got.select("doc_id", *BASE, failed.alias("base_failed"), kept.alias("kept"), "class_distance", "word_distance")
