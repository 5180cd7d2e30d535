"""Operator 10: language-model scores from a log-frequency Bloom filter.

Chunks. Each task turns its texts into chunks of tokens and writes them, numbered by the chunk's distinct
words (the frequent ones first, so that they pack well). All later steps read these, not the texts.

Counting. A chunk sends the 64-bit hashes of its distinct words and word pairs with their training
counts to shards by hash range, packed as arrays. A shard adds up all chunks, so a frequent word is one
entry a chunk however often, and in however many documents, it occurs.

Filter. A count c is kept as level q = 1 + floor(log_b c): the n-gram is set with the levels 1 to q.
The filter is cut by a fixed number of leading hash bits, and a cut's bits follow from its own n-grams, so
neither shards nor files nor their sizes change an answer. Every shard builds the cuts of its hash range.
A count is read back by probing levels until one is missing; with 12 hashes and half of the bits set, a
missing level is found by mistake about once in 4,000 probes.

Answers. A slice is probed where it was built: a shard reads back each n-gram that any chunk sent and
returns levels (for words also exact counts) in the order in which they came. Shards multiply with the
input; no filter is gathered or broadcast, so nothing bounds its size.

Score. P(w | v) = (c(v,w) + mu * P(w)) / (c(v) + mu) with P(w) = (c(w) + 0.5) / (N + 0.5 * (V + 1)),
all counts read from the filter; the score is the sum of log10 P over a text's tokens. The base score
is the sum of log10 P(w) by exact counts. Both are made chunk by chunk from the answers.

Defined cases: null and empty texts are one end token; each row has its own result, repeated rows and rows
with a null id too (those are learnt from); without training rows all counts are 0; an empty table gives no
rows; very long texts are chunks of their own; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, materialise, prepare, record_batch, size_in_bytes, split_residue

END = 0x5EED5EED5EED5EED  # hash of the end token; START context is the end token too
GOLD = np.uint64(0x9E3779B97F4A7C15)
MASK = (1 << 64) - 1
BASE = 1.6  # of the count levels
CUT_BITS = 18  # leading bits of a hash that name its cut of the filter, at every size of the input
HASH_BITS = 1.45  # of a cut for each hash of an entry: half of the bits are set


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * GOLD + mix(second) + np.uint64(1))


class WordHashes:
    """Stable hashes of lower-cased words, through a bounded memo."""

    def __init__(self, limit: int = 300_000):
        self.known: dict[bytes, int] = {}
        self.limit = limit

    def of(self, text: str) -> np.ndarray:
        """Hashes of the text's words and the end token."""
        words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes.lower() changes A-Z only
        try:
            got = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            if len(self.known) > self.limit:
                self.known = {}
            known, new = self.known, xxhash.xxh3_64_intdigest
            for w in words:
                if w not in known:
                    known[w] = new(w)
            got = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        return np.append(got, np.uint64(END))


_hashes = WordHashes()

CHUNKS_SQL = "chunk long, ids array<long>, sizes binary, trains binary, words binary, tokens binary"
CHUNKS = pa.schema([("chunk", pa.int64()), ("ids", pa.list_(pa.int64())), *((c, pa.binary()) for c in ("sizes", "trains", "words", "tokens"))])
ENTRIES_SQL = "shard int, pairs boolean, chunk long, keys binary, counts binary"
ENTRIES = pa.schema([("shard", pa.int32()), ("pairs", pa.bool_()), ("chunk", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
ANSWERS_SQL = "chunk long, shard int, pairs boolean, levels binary, totals binary, n_words long, n_tokens long"
ANSWERS = pa.schema([("chunk", pa.int64()), ("shard", pa.int32()), ("pairs", pa.bool_()), ("levels", pa.binary()), ("totals", pa.binary()), ("n_words", pa.int64()), ("n_tokens", pa.int64())])


def _cut_of(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(64 - CUT_BITS)).astype(np.int64)


def _shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shards are runs of whole cuts."""
    return _cut_of(keys) * shards >> CUT_BITS


def squeeze(a: np.ndarray) -> bytes:
    """An array of small numbers in the narrowest width, which leads."""
    k = 1 if not len(a) or (top := int(a.max())) < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    return bytes([k]) + a.astype(f"<u{k}").tobytes()


def expand(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1)


def pack(numbers: np.ndarray) -> bytes:
    """Numbers below 2**32, compressed by byte planes after their count."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return len(numbers).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpack(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    planes = np.frombuffer(pa.decompress(raw[8:], 4 * n, "zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(n)


def _chunks(documents: DataFrame, train: F.Column, chunk_chars: int = 5_000_000) -> DataFrame:
    """One row for each chunk of documents: their ids and numbers of tokens, its distinct words, the tokens' words."""
    prepare(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("long"), F.coalesce(train, F.lit(True)).alias("train"), "text")

    def run(it):
        first = TaskContext.get().partitionId() << 32
        for n, (part, texts) in enumerate(batches(it, 2, chunk_chars)):
            hashes = [_hashes.of(t) for t in texts]
            unique, number = np.unique(np.concatenate(hashes), return_inverse=True)
            order = np.argsort(-np.bincount(number), kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            sizes, trains = np.fromiter(map(len, hashes), np.int64, len(hashes)), np.array(part.column(1).to_pylist(), bool)
            yield record_batch({"chunk": [first + n], "ids": [part.column(0).to_pylist()], "sizes": [squeeze(sizes)], "trains": [trains.tobytes()], "words": [unique[order].tobytes()], "tokens": [pack(rank[number])]}, CHUNKS)

    return materialise(rows.mapInArrow(run, CHUNKS_SQL), "lm-chunks")


class Chunk:
    """Distinct words (`words`, sorted) and word pairs (`pairs`, sorted hashes) of a row of `_chunks`."""

    def __init__(self, sizes: bytes, words: bytes, tokens: bytes):
        self.sizes = expand(sizes).astype(np.int64)
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        ranked = np.frombuffer(words, "<u8")
        order = np.argsort(ranked)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.words, self.number = ranked[order], place[unpack(tokens)]  # number: the word of each token
        end = np.searchsorted(self.words, np.uint64(END))
        before = np.concatenate([[end], self.number[:-1]])  # the word before a text's first is the end token
        keys, pair = np.unique(before * len(order) + self.number, return_inverse=True)
        first, second = keys // len(order), keys % len(order)
        hashed = pair_hash(self.words[first], self.words[second])
        by_hash = np.argsort(hashed, kind="stable")
        place = np.empty(len(keys), np.int64)
        place[by_hash] = np.arange(len(keys))
        self.pairs, self.first, self.second, self.pair = hashed[by_hash], first[by_hash], second[by_hash], place[pair]


def _entries(chunks: DataFrame, shards: int, pair_shards: int) -> DataFrame:
    """Packed words and pairs of each chunk with their training counts; pairs have the shards after the words'."""
    prepare(chunks.sparkSession)

    def run(it):
        for batch in it:
            for r in range(len(batch)):
                number, sizes, trains, words, tokens = (batch.column(k)[r].as_py() for k in range(5))
                own = Chunk(sizes, words, tokens)
                train = np.frombuffer(trains, bool)[own.doc]
                out: dict[str, list] = {c: [] for c in ENTRIES.names}
                for pairs, keys, of, n, base in ((False, own.words, own.number, shards, 0), (True, own.pairs, own.pair, pair_shards, shards)):
                    counts = np.bincount(of, train, len(keys)).astype(np.int64)
                    cut = np.searchsorted(_shard_of(keys, n), np.arange(n + 1))
                    for k in np.nonzero(np.diff(cut))[0].tolist():
                        at = slice(cut[k], cut[k + 1])
                        for c, v in zip(ENTRIES.names, (base + k, pairs, number, keys[at].tobytes(), squeeze(counts[at]))):
                            out[c].append(v)
                yield record_batch(out, ENTRIES)

    return chunks.select("chunk", "sizes", "trains", "words", "tokens").mapInArrow(run, ENTRIES_SQL)


def levels(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / np.log(BASE) + 1e-9).astype(np.int64)


def level_count(level: np.ndarray) -> np.ndarray:
    """The count a level stands for: 0, 1, or the middle of its range."""
    return np.where(level <= 1, level, (BASE ** (level - 1) + BASE ** np.maximum(level, 1)) / 2 - 0.5)


class FilterSlice:
    """The filter over some whole cuts of the hash range, read by membership probes.

    A cut is what shares its leading CUT_BITS of hash. It has bits of its own, HASH_BITS for each hash of an entry,
    whatever shard or file it is in, so a probe's answer depends on the n-grams alone. A slice above max_bytes is
    an error, never a thinner slice.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, hashes: int, max_bytes: int = 1 << 29):
        level, cut = levels(counts), _cut_of(keys)
        self.hashes, self.low = hashes, int(cut.min(initial=1 << CUT_BITS))
        entries = np.bincount(cut - self.low, level, 1)
        self.bits = (64 * np.maximum(1, np.ceil(entries * hashes * HASH_BITS / 64))).astype(np.uint64)
        ends = np.cumsum(self.bits).astype(np.int64)
        self.first = ends - self.bits.astype(np.int64)
        if ends[-1] > 8 * max_bytes:
            raise ValueError(f"a slice of the filter needs {ends[-1] // 8} bytes, more than {max_bytes}: use more shards (a smaller entries_mb)")
        data = np.zeros(ends[-1], bool)
        for q in range(1, int(level.max(initial=0)) + 1):
            some = level >= q
            for k in range(hashes):
                data[self._place(keys[some], cut[some] - self.low, q, k)] = True
        self.data = np.packbits(data, bitorder="little")

    def _place(self, keys: np.ndarray, cut: np.ndarray, level: int, k: int) -> np.ndarray:
        """Bit of (key, level) under the k-th hash."""
        h = mix(keys + np.uint64(level * int(GOLD) & MASK))
        spread = (h >> np.uint64(32)) + np.uint64(k) * ((h & np.uint64(0xFFFFFFFF)) | np.uint64(1))
        return self.first[cut] + (spread % self.bits[cut]).astype(np.int64)

    def has(self, keys: np.ndarray, level: int) -> np.ndarray:
        cut = _cut_of(keys) - self.low
        out = (cut >= 0) & (cut < len(self.bits))
        for k in range(self.hashes):
            live = np.flatnonzero(out)
            at = self._place(keys[live], cut[live], level, k)
            out[live] = (self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return out

    def levels(self, keys: np.ndarray) -> np.ndarray:
        level, live, q = np.zeros(len(keys), np.int64), np.arange(len(keys)), 1
        while len(live) and q < 64:
            live = live[self.has(keys[live], q)]
            level[live] = q
            q += 1
        return level


def _add_shard(hashes: int):
    def add(group: pa.Table) -> pa.Table:
        """The shard's sums (a row without a chunk), and for each chunk the levels, and exact counts, of what it sent."""
        pairs, shard = group.column("pairs")[0].as_py(), group.column("shard")[0].as_py()
        keys = [np.frombuffer(x.as_py(), "<u8") for x in group.column("keys")]
        unique, number = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(number, np.concatenate([expand(x.as_py()) for x in group.column("counts")]), len(unique)).astype(np.int64)
        seen = total > 0
        level = FilterSlice(unique[seen], total[seen], hashes).levels(unique)
        parts = np.split(number, np.cumsum([len(x) for x in keys])[:-1])
        none, n = [None], len(parts)
        return pa.table({
            "chunk": none + group.column("chunk").to_pylist(), "shard": [shard] * (n + 1), "pairs": [pairs] * (n + 1), "levels": none + [squeeze(level[x]) for x in parts],
            "totals": none + ([None] * n if pairs else [squeeze(total[x]) for x in parts]), "n_words": [0 if pairs else int(seen.sum())] + [None] * n, "n_tokens": [0 if pairs else int(total.sum())] + [None] * n,
        }, schema=ANSWERS)

    return add


SCORES_SQL = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
SCORES = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _score_chunk(n_words: int, n_tokens: int, mu: float):
    mass = n_tokens + 0.5 * (n_words + 1)

    def run(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        """Scores of a chunk's documents; the shards' answers, one after the other, follow its sorted hashes."""
        own = Chunk(*(chunk.column(c)[0].as_py() for c in ("sizes", "words", "tokens")))
        got = sorted(answers.select(["shard", "pairs", "levels", "totals"]).to_pylist(), key=lambda r: r["shard"])
        total = np.concatenate([expand(r["totals"]) for r in got if not r["pairs"]]).astype(np.int64)
        c = level_count(np.concatenate([expand(r["levels"]) for r in got if not r["pairs"]]).astype(np.int64)).astype(np.float64)
        both = level_count(np.concatenate([expand(r["levels"]) for r in got if r["pairs"]]).astype(np.int64)).astype(np.float64)
        if (len(total), len(c), len(both)) != (len(own.words), len(own.words), len(own.pairs)):
            raise ValueError("answers of a shard are missing")
        alone = np.minimum(1.0, (c + 0.5) / mass)
        p = np.log10((np.minimum(both, np.minimum(c[own.first], c[own.second])) + mu * alone[own.second]) / (c[own.first] + mu))
        n = len(own.sizes)
        base = np.bincount(own.doc, np.log10(total + 0.5)[own.number], n) - own.sizes * np.log10(mass)
        known = np.bincount(own.doc, (total > 0)[own.number], n).astype(np.int64)
        return pa.table({"doc_id": chunk.column("ids")[0].as_py(), "n_tokens": own.sizes, "n_known": known, "train_tokens": np.full(n, n_tokens, np.int64), "base_score": base, "score": np.bincount(own.doc, p[own.pair], n)}, schema=SCORES)

    return run


def score(documents: DataFrame, train: F.Column, mu: float = 2000.0, hashes: int = 12, entries_mb: int = 16, shards: int | None = None) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of each whole text.

    `train` marks the rows to learn from. Counting is dealt to `shards`, else to as many as make about `entries_mb` of
    input; their number changes no score. A probe for a level that isn't there succeeds once in 2 ** hashes.
    """
    shards = shards or max(16, size_in_bytes(documents) // (entries_mb << 20))
    shards = int(min(1 << CUT_BITS - 2, shards))
    chunks = _chunks(documents, train)
    answers = materialise(_entries(chunks, shards, 4 * shards).groupBy("shard").applyInArrow(_add_shard(hashes), ANSWERS_SQL), "lm-answers")
    sums = answers.where("chunk is null").agg(F.coalesce(F.sum("n_words"), F.lit(0)).alias("n_words"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens")).first()
    asked = answers.where("chunk is not null").select("chunk", "shard", "pairs", "levels", "totals")
    return chunks.groupBy("chunk").cogroup(asked.groupBy("chunk")).applyInArrow(_score_chunk(sums.n_words, sums.n_tokens, mu), SCORES_SQL)


def held_out_scores(documents: DataFrame) -> DataFrame:
    """Learn from four folds of five, score all."""
    fold = split_residue("doc_id", 5)
    got = score(documents, fold != 1)
    return got.select("doc_id", F.coalesce(split_residue("doc_id", 5) == 1, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
