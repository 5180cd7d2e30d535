"""Operator 1: language labels for the spans of mixed-language texts.

1. Learning. Character n-grams of words are counted per language over a sample of labelled documents
   (at most `per_language` documents of each language, chosen by a hash of the id; the counting runs
   in Spark tasks, only one count vector per language reaches the driver). The scripts in which a
   language writes at least one word in twenty are kept with it.
2. Scoring. A word's script, read from code-point ranges, narrows the candidate languages; each
   candidate gets the log-likelihood of the word's n-grams.
3. Labelling. Viterbi over the words with a constant penalty for each change of language gives the
   spans; the document's language is the one whose spans hold most letters.

Defined cases: null texts and texts without letters are `und` with score 0 and no spans; words in a
script that no learned language uses leave all languages open; with no usable training row every
document is `und`; ties go to the first language in alphabetical order; rows are labelled one by one,
so repeated rows give repeated results; further columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, hash_sample, join_ids, prepare, record_batch, split_residue

WORD = re.compile(r"[^\W\d_]+")
BUCKETS = 1 << 16
ORDERS = (1, 2, 3, 4)
# First code points of script ranges (Unicode blocks) and the script that starts there.
SCRIPT_STARTS = [(0x0, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"), (0x780, "other"),
                 (0x900, "devanagari"), (0x980, "bengali"), (0xA00, "indic"), (0xE00, "thai"), (0xE80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"),
                 (0x1200, "ethiopic"), (0x13A0, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"),
                 (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"),
                 (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"), (0xFF21, "latin"),
                 (0xFF66, "kana"), (0xFFA0, "hangul"), (0x10000, "other"), (0x20000, "han")]
SCRIPTS = sorted({s for _, s in SCRIPT_STARTS})
_STARTS = np.array([a for a, _ in SCRIPT_STARTS])
_SCRIPT_OF = np.array([SCRIPTS.index(s) for _, s in SCRIPT_STARTS])


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word number, n-gram bucket) of every n-gram of the words, and each word's script number."""
    codes = np.frombuffer(("\0" + "\0".join(w.lower() for w in words) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    gap = codes == 0
    word = np.cumsum(gap) - 1
    owner, bucket = [], []
    h = np.zeros(len(codes), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        size = len(codes) - n + 1
        if size <= 0:
            break
        h = h[:size] * np.uint64(1_000_003) + (codes[n - 1:].astype(np.uint64) + np.uint64(1))
        inner = np.zeros(size, bool)  # a gap may stand at either end of an n-gram, never within
        for k in range(1, n - 1):
            inner |= gap[k: k + size]
        at = np.nonzero(~inner & ~(gap[:size] & (gap[n - 1: n - 1 + size] if n > 1 else True)))[0]
        mixed = h[at] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)
        owner.append(word[at])
        bucket.append((mixed >> np.uint64(48)).astype(np.int64))
    starts = np.nonzero(gap)[0][: len(words)] + 1
    script = _SCRIPT_OF[np.searchsorted(_STARTS, codes[starts], side="right") - 1]
    return np.concatenate(owner), np.concatenate(bucket), script


class LanguageModel:
    """Log-likelihoods of n-gram buckets per language, and the scripts each language uses."""

    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray, penalty: float = 12.0, floor: float = 10.0):
        self.langs, self.penalty, self.floor = langs, penalty, floor
        smooth = counts.astype(np.float64) + 0.5
        self.log_p = np.log(smooth / smooth.sum(axis=1, keepdims=True)) / len(ORDERS)
        share = scripts / np.maximum(1, scripts.sum(axis=1, keepdims=True))
        self.allowed = (share >= 0.05).T  # script x language
        self.allowed[~self.allowed.any(axis=1)] = True
        self.known: dict[str, int] = {}
        self.rows = np.zeros((0, len(langs)))

    def _learn_words(self, words: list[str]) -> None:
        owner, bucket, script = word_features(words)
        got = np.stack([np.bincount(owner, p[bucket], len(words)) for p in self.log_p], axis=1)
        got[~self.allowed[script]] = -np.inf
        got = np.maximum(got - got.max(axis=1, keepdims=True), -self.floor)
        self.known.update(zip(words, range(len(self.rows), len(self.rows) + len(words))))
        self.rows = np.concatenate([self.rows, got])

    def scores(self, docs: list[list[str]]) -> list[np.ndarray]:
        """Per document a words x languages array; the memo of words is bounded."""
        if len(self.known) > 400_000:
            self.known, self.rows = {}, self.rows[:0]
        new: set[str] = set()
        for d in docs:
            new.update(d)
        if new := sorted(new - self.known.keys()):
            self._learn_words(new)
        get = self.known.__getitem__
        return [self.rows[np.fromiter(map(get, d), np.int64, len(d))] for d in docs]

    def paths(self, docs: list[np.ndarray]) -> list[np.ndarray]:
        """Best language number of each word of each document.

        If no run of words gains more than half a penalty in another language than the best single
        one, a single language is the best path: k stretches in other languages gain at most k/2
        penalties and cost at least k - 1 changes (one, if k is 1 and the stretch isn't everything).
        The other documents go through Viterbi side by side, those of like length together.
        """
        out: list[np.ndarray] = []
        mixed = []
        for s in docs:
            best = int(s.sum(axis=0).argmax())
            gain = np.cumsum(s - s[:, [best]], axis=0)
            low = np.minimum(np.minimum.accumulate(gain, axis=0) - s + s[:, [best]], 0)
            low = np.minimum.accumulate(low, axis=0)
            if (gain - low).max() > self.penalty / 2:
                mixed.append(len(out))
            out.append(np.full(len(s), best))
        mixed.sort(key=lambda k: len(docs[k]))
        for a in range(0, len(mixed), 64):
            group = mixed[a: a + 64]
            for k, path in zip(group, self._viterbi([docs[k] for k in group])):
                out[k] = path
        return out

    def _viterbi(self, docs: list[np.ndarray]) -> list[np.ndarray]:
        m, lengths = len(self.langs), np.array([len(s) for s in docs])
        scores = np.zeros((lengths.max(), len(docs), m))
        for k, s in enumerate(docs):
            scores[: len(s), k] = s
        stay, row = np.arange(m), np.arange(len(docs))
        back, v = np.empty(scores.shape, np.int16), scores[0].copy()
        for t in range(1, len(scores)):
            top = v.argmax(axis=1)
            moved = (v[row, top] - self.penalty)[:, None]
            switch = (moved > v) & (t < lengths)[:, None]  # past its end a document stays as it is
            back[t] = np.where(switch, top[:, None], stay)
            v = np.where(switch, moved, v) + scores[t]
        path = np.empty((len(scores), len(docs)), np.int64)
        path[-1] = v.argmax(axis=1)
        for t in range(len(scores) - 1, 0, -1):
            path[t - 1] = back[t, row, path[t]]
        return [path[: len(s), k] for k, s in enumerate(docs)]

    def label(self, text: str, words: list[str], s: np.ndarray, path: np.ndarray) -> tuple[str, float, list[tuple[int, int, str]]]:
        """Language, score and spans (start, end, language) of a text with at least one word."""
        letters = np.fromiter(map(len, words), np.int64, len(words))
        held = np.bincount(path, letters, len(self.langs))
        best = int(held.argmax())
        total = s.sum(axis=0) / max(1.0, len(words) ** 0.5)
        posterior = np.exp(total - total.max())
        score = float(held[best] / held.sum() * posterior[best] / posterior.sum())
        if (path == path[0]).all():
            end = text.rindex(words[-1]) + len(words[-1])
            return self.langs[best], score, [(text.index(words[0]), end, self.langs[best])]
        places = [m.span() for m in WORD.finditer(text)]
        cuts = np.nonzero(np.diff(path))[0] + 1
        spans = [(places[a][0], places[b - 1][1], self.langs[path[a]]) for a, b in zip([0, *cuts], [*cuts, len(path)])]
        return self.langs[best], score, spans


def learn(training: DataFrame, per_language: int = 1000, max_languages: int = 200) -> LanguageModel | None:
    """A model from rows with text and lang; None if there is no usable row.

    The model has 65,536 numbers for each language, on the driver and in every worker, so it knows the
    `max_languages` values of lang that have most documents (of equal ones the first by name); texts of all
    others are labelled as the known language that they are nearest to.
    """
    prepare(training.sparkSession)
    rows = training.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages)
    rows = rows.where(F.col("lang").isin([r.lang for r in sizes.collect()]))
    chosen = hash_sample(rows.select("doc_id", "lang"), "lang", per_language).select("doc_id").distinct()
    sample = join_ids(rows.select("doc_id", "text", "lang"), chosen, "left_semi").select("lang", "text")
    schema = pa.schema([("lang", pa.string()), ("counts", pa.binary())])
    width = BUCKETS + len(SCRIPTS)

    def count(it):
        sums: dict[str, np.ndarray] = {}
        for part, texts in batches(it, 1):
            for lang, text in zip(part.column(0).to_pylist(), texts):
                if words := WORD.findall(text):
                    _, bucket, script = word_features(words)
                    own = sums.setdefault(lang, np.zeros(width, np.int64))
                    own[:BUCKETS] += np.bincount(bucket, minlength=BUCKETS)
                    own[BUCKETS:] += np.bincount(script, minlength=len(SCRIPTS))
        if sums:
            yield record_batch({"lang": list(sums), "counts": [x.tobytes() for x in sums.values()]}, schema)

    def add(group: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x.as_py(), np.int64) for x in group.column("counts")], axis=0)
        return pa.table({"lang": [group.column("lang")[0].as_py()], "counts": [total.tobytes()]}, schema=schema)

    kind = "lang string, counts binary"
    got = sorted(sample.mapInArrow(count, kind).groupBy("lang").applyInArrow(add, kind).collect())  # one row for each language
    if not got:
        return None
    vectors = np.stack([np.frombuffer(r.counts, np.int64) for r in got])
    return LanguageModel([r.lang for r in got], vectors[:, :BUCKETS], vectors[:, BUCKETS:])


DETECTED = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()),
                      ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])))])
DETECTED_SQL = "doc_id long, lang_pred string, score double, spans array<struct<start: long, end: long, lang: string>>"


def detect(documents: DataFrame, model: LanguageModel | None) -> DataFrame:
    """doc_id, lang_pred, score and language spans (code points, end exclusive) of each whole text."""
    spark = documents.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)  # 65,536 numbers for each of at most max_languages

    def run(it):
        own = shared.value
        for part, texts in batches(it, 1, 2_000_000):
            docs = [WORD.findall(t) if own else [] for t in texts]
            full = [i for i, d in enumerate(docs) if d]
            out: list = [("und", 0.0, [])] * len(docs)
            if full:
                scores = own.scores([docs[i] for i in full])
                for i, s, path in zip(full, scores, own.paths(scores)):
                    out[i] = own.label(texts[i], docs[i], s, path)
            spans = [[{"start": a, "end": b, "lang": c} for a, b, c in x[2]] for x in out]
            yield record_batch({"doc_id": part.column(0), "lang_pred": [x[0] for x in out], "score": [x[1] for x in out], "spans": spans}, DETECTED)

    return documents.select("doc_id", "text").mapInArrow(run, DETECTED_SQL)


def held_out_predictions(documents: DataFrame) -> DataFrame:
    """Learn from three folds of four, predict all: doc_id, held_out, lang_pred, score, n_spans."""
    model = learn(documents.where(split_residue("doc_id", 4) != 2))
    got = detect(documents, model)
    return got.select("doc_id", F.coalesce(split_residue("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))
