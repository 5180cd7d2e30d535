"""Operator 3: a quality classifier, a small convolutional network over bytes, in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it. In each chunk learned
filters slide over byte embeddings and are max-pooled; a hidden layer turns a chunk's maxima into
features, and their mean and maximum over all chunks give one probability.

Training: at most `per_label` documents of each label, chosen by a hash of the id, each with all of its
chunks, as in scoring; they are trained on the driver with a fixed seed. Chunks are cut and pooled a few
at a time.

Defined cases: null and empty texts are one chunk of padding and get that chunk's score; texts of any
length are scored by all their chunks, a few at a time; a document with several labels counts with its
smallest; without both labels in the training rows (an empty table has none) the score is 0.5 for all and
`keep_good` keeps all; rows are scored one by one, so repeated rows give repeated results; other columns,
whatever their names, pass by untouched in `keep_good` and are ignored elsewhere.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_in_arrow, batches, by_position, hash_sample, prepare, record_batch, split_residue

CHUNK, HOP = 512, 448
WIDTH, STRIDE = 8, 4
EMBED, FILTERS, HIDDEN = 8, 24, 16
PLACES = (CHUNK - WIDTH) // STRIDE + 1


def chunks_of(data: bytes) -> np.ndarray:
    """Overlapping rows of CHUNK bytes over all of `data`; byte 0 fills the last one."""
    n = 1 + max(0, -(-(len(data) - CHUNK) // HOP))
    full = np.frombuffer(data.ljust((n - 1) * HOP + CHUNK, b"\0"), np.uint8)
    return np.lib.stride_tricks.sliding_window_view(full, CHUNK)[::HOP]


class ByteConvNet:
    def __init__(self, seed: int = 7):
        g = np.random.default_rng(seed)
        f = lambda *shape, s: (g.standard_normal(shape) * s).astype(np.float32)
        self.p = {"emb": f(256, EMBED, s=0.5), "conv": f(WIDTH * EMBED, FILTERS, s=0.15), "cb": np.zeros(FILTERS, np.float32), "w1": f(FILTERS, HIDDEN, s=0.25),
                  "b1": np.zeros(HIDDEN, np.float32), "w2": f(2 * HIDDEN, s=0.2), "b2": np.zeros(1, np.float32)}

    def pooled(self, chunks: np.ndarray, places: bool = False):
        """Each filter's maximum in each chunk, and where it is if asked for."""
        x = self.p["emb"][chunks]
        view = np.lib.stride_tricks.as_strided(x, (len(chunks), PLACES, WIDTH * EMBED), (x.strides[0], STRIDE * x.strides[1], x.strides[2]))
        z = (np.ascontiguousarray(view).reshape(-1, WIDTH * EMBED) @ self.p["conv"]).reshape(len(chunks), PLACES, FILTERS)
        return (z.max(axis=1) + self.p["cb"], z.argmax(axis=1)) if places else z.max(axis=1) + self.p["cb"]

    def logits(self, pooled: np.ndarray, starts: np.ndarray):
        h = np.maximum(np.maximum(pooled, 0) @ self.p["w1"] + self.p["b1"], 0)
        counts = np.diff(np.append(starts, len(h)))
        both = np.hstack([np.add.reduceat(h, starts) / counts[:, None], np.maximum.reduceat(h, starts)])
        return both @ self.p["w2"] + self.p["b2"][0], h, both, counts

    def score(self, texts: list[str], at_once: int = 512) -> np.ndarray:
        """Probabilities to five decimals; the order of 32-bit sums, beyond that, depends on which texts come together."""
        rows = [chunks_of(t.encode("utf-8", "surrogatepass")) for t in texts]
        starts = np.concatenate([[0], np.cumsum([len(r) for r in rows])[:-1]]).astype(np.int64)
        every = np.concatenate(rows)
        pooled = np.concatenate([self.pooled(every[a: a + at_once]) for a in range(0, len(every), at_once)])
        return np.round(1 / (1 + np.exp(-np.clip(self.logits(pooled, starts)[0].astype(np.float64), -30, 30))), 5)

    def pooled_parts(self, chunks: np.ndarray, at_once: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """pooled with places, a bounded number of chunks at a time."""
        parts = [self.pooled(chunks[a: a + at_once], True) for a in range(0, len(chunks), at_once)]
        return np.concatenate([p for p, _ in parts]), np.concatenate([w for _, w in parts])

    def train(self, docs: list[bytes], labels: np.ndarray, epochs: int = 10, batch: int = 32, rate: float = 4e-3, seed: int = 7) -> None:
        """Adam on the logistic loss; through the maxima only the winning places get gradients."""
        g = np.random.default_rng(seed)
        m1, m2, step = {k: np.zeros_like(v) for k, v in self.p.items()}, {k: np.zeros_like(v) for k, v in self.p.items()}, 0
        for epoch in range(epochs):
            order = g.permutation(len(docs))
            for a in range(0, len(order), batch):
                pick = order[a: a + batch]
                rows = [chunks_of(docs[i]) for i in pick]
                starts = np.concatenate([[0], np.cumsum([len(r) for r in rows])[:-1]]).astype(np.int64)
                chunks = np.concatenate(rows)
                pooled, where = self.pooled_parts(chunks)
                z, h, both, counts = self.logits(pooled, starts)
                dz = ((1 / (1 + np.exp(-z)) - labels[pick]) / len(pick)).astype(np.float32)
                grad = {"w2": both.T @ dz, "b2": np.array([dz.sum()], np.float32)}
                dboth = dz[:, None] * self.p["w2"]
                doc = np.repeat(np.arange(len(pick)), counts)
                dh = (dboth[:, :HIDDEN] / counts[:, None])[doc]
                top = h == both[doc, HIDDEN:]
                dh = (dh + dboth[doc, HIDDEN:] * top / np.maximum(1, np.add.reduceat(top, starts)[doc])) * (h > 0)
                grad["w1"], grad["b1"] = np.maximum(pooled, 0).T @ dh, dh.sum(axis=0)
                dp = (dh @ self.p["w1"].T) * (pooled > 0)
                grad["cb"] = dp.sum(axis=0)
                seen = np.take_along_axis(chunks[:, None, :], where[:, :, None] * STRIDE + np.arange(WIDTH), axis=2)  # chunk, filter, byte
                x = self.p["emb"][seen].reshape(len(chunks), FILTERS, -1)
                grad["conv"] = np.einsum("cf,cfk->kf", dp, x)
                dx = (dp[:, :, None] * self.p["conv"].T[None]).reshape(-1, EMBED)
                flat = seen.reshape(-1)
                grad["emb"] = np.stack([np.bincount(flat, dx[:, k], 256) for k in range(EMBED)], axis=1).astype(np.float32)
                step += 1
                pace = rate * (1 - 0.9 * epoch / epochs)
                for k, d in grad.items():
                    m1[k] = 0.9 * m1[k] + 0.1 * d
                    m2[k] = 0.999 * m2[k] + 0.001 * d * d
                    self.p[k] = (self.p[k] - pace * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)


def learn(documents: DataFrame, labels: DataFrame, per_label: int = 1500) -> ByteConvNet | None:
    """Train on a bounded sample of the labelled rows (doc_id, quality) of `labels`, on the whole texts."""
    known = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = hash_sample(known, "quality", per_label)
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("data")).join(F.broadcast(chosen), "doc_id")  # at most 2 * per_label rows
    sample = rows.dropDuplicates(["doc_id"]).select("doc_id", "quality", "data").collect()
    sample.sort(key=lambda r: r.doc_id)
    labels_of = np.array([float(r.quality) for r in sample], np.float32)
    if len(set(labels_of.tolist())) < 2:
        return None
    net = ByteConvNet()
    net.train([bytes(r.data) for r in sample], labels_of)
    return net


def _scored(df: DataFrame, net: ByteConvNet | None, name: str = "score") -> DataFrame:
    spark = df.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(net)  # a few thousand numbers
    at = df.columns.index("text")

    def run(it):
        own = shared.value
        for part, texts in batches(it, at, 2_000_000):
            yield part, [pa.array(own.score(texts) if own else np.full(len(texts), 0.5))]

    return append_in_arrow(df, [T.StructField(name, T.DoubleType())], run)


def score(documents: DataFrame, net: ByteConvNet | None) -> DataFrame:
    """doc_id and the probability that the whole text's label is 1."""
    return _scored(documents.select("doc_id", "text"), net).select("doc_id", "score")


def held_out_scores(documents: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Learn from four folds of five, score all: doc_id, held_out, score, predicted."""
    net = learn(documents, labels.where(split_residue("doc_id", 5) != 0))
    return score(documents, net).select(
        "doc_id", F.coalesce(split_residue("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted")
    )


def keep_good(documents: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of `documents` that the classifier doesn't reject, columns as they were."""
    net = learn(documents, labels.where(split_residue("doc_id", 5) != 0))
    prepare(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(net)  # a few thousand numbers
    at = documents.columns.index("text")

    def run(it):
        own = shared.value
        for part, texts in batches(it, at, 2_000_000):
            yield part.filter(pa.array(own.score(texts) >= threshold)) if own else part

    plain = by_position(documents)
    return plain.mapInArrow(run, plain.schema).toDF(*documents.columns)
