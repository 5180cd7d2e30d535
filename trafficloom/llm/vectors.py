"""Integer vectors, exact inner products, running top lists and bounded passes, for searches over `embeddings`.

A search takes its queries in passes of bounded size, each of which reads an index table written once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import scratch

PASS_BYTES = 16 << 20  # of queries that one pass sends to the workers
SEEDS = 2048  # rows whose scores give a search its first floors, and the sample that references come from
LEAST = np.iinfo(np.int64).min


def integer_vectors(rows: DataFrame, *columns: str) -> DataFrame:
    """vec_id, columns, v: floor(256 * x) of each component, x as double.

    Rows whose id or vector is null, or that have a null or non-finite component, take no part. Vectors may
    differ in length; the shorter one counts as zero beyond its end.
    """
    finite = F.forall("embedding", lambda x: F.abs(x.cast("double")) < F.lit(float("inf")))  # false for NaN, null for null
    return rows.where(F.col("vec_id").isNotNull() & finite).select("vec_id", *columns, F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("v"))


class Vectors:
    """Rows of integer vectors with their ids and whatever else belongs to them."""

    def __init__(self, ids: np.ndarray, ints: np.ndarray, **more: np.ndarray):
        self.ids, self.ints, self.more = ids, ints, more
        self.real = ints.astype(np.float64)
        self.norms = np.sqrt((self.real**2).sum(axis=1))

    def __len__(self) -> int:
        return len(self.ids)

    def take(self, order: np.ndarray) -> Vectors:
        return Vectors(self.ids[order], self.ints[order], **{k: v[order] for k, v in self.more.items()})

    def dot(self, other: Vectors, mine=slice(None), theirs=slice(None)) -> np.ndarray:
        """Exact integer inner products; an OverflowError where one may not fit 64 bits.

        Doubles are exact while no partial sum can pass 2 ** 53, which the norms prove.
        """
        d = min(self.ints.shape[1], other.ints.shape[1])
        largest = float(self.norms[mine].max(initial=0)) * float(other.norms[theirs].max(initial=0))
        if largest < 2.0**52:
            return np.rint(self.real[mine, :d] @ other.real[theirs, :d].T).astype(np.int64)
        if largest < 2.0**62:
            return self.ints[mine, :d] @ other.ints[theirs, :d].T
        raise OverflowError("inner products of these vectors may not fit 64 bits")


def from_arrow(batch, *columns: str) -> Vectors:
    """Vectors of a batch or table with vec_id, v and integer columns."""
    if isinstance(batch, pa.Table):
        batch = batch.combine_chunks()
    v = batch.column("v")
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    lengths = v.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = v.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    width = int(lengths.max(initial=0))
    ints = np.zeros((len(lengths), width), np.int64)
    ints[np.arange(width) < lengths[:, None]] = flat
    numbers = lambda c: batch.column(c).to_numpy().astype(np.int64)
    return Vectors(numbers("vec_id"), ints, **{c: numbers(c) for c in columns})


def chunks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Tables of `rows` rows, the last one fewer, whatever the batches hold."""
    held, n = [], 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, rows - n)
            batch = batch.slice(part.num_rows)
            held.append(part)
            n += part.num_rows
            if n == rows:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


class TopLists:
    """The k first (score descending, id ascending) of each of n lists."""

    def __init__(self, n: int, k: int):
        self.k, self.scores, self.ids = k, np.full((n, k), LEAST), np.zeros((n, k), np.int64)

    def floors(self) -> np.ndarray:
        """Below its floor a score can't enter a list; the least number while the list isn't full."""
        return self.scores[:, -1]

    def add(self, lists: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        if not len(lists):
            return
        touched = np.unique(lists)
        lists = np.concatenate([np.repeat(touched, self.k), lists])
        scores, ids = np.concatenate([self.scores[touched].ravel(), scores]), np.concatenate([self.ids[touched].ravel(), ids])
        order = np.lexsort((ids, ~scores, lists))  # ~x falls as x rises, and knows no overflow
        lists, scores, ids = lists[order], scores[order], ids[order]
        first = np.searchsorted(lists, touched)
        at = first[:, None] + np.arange(self.k)
        self.scores[touched], self.ids[touched] = scores[at], ids[at]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, score, id) of all entries."""
        lists, places = np.nonzero(self.scores != LEAST)
        return lists, self.scores[lists, places], self.ids[lists, places]


def seeds(vectors: DataFrame, *columns: str, n: int = SEEDS) -> Vectors:
    """The n rows with the least hashes of their ids: a bounded sample for floors and references; no result depends on it."""
    return from_arrow(vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(n).toArrow(), *columns)


def in_passes(queries: DataFrame, vectors_column: str, schema: str, name: str, search: Callable[[pa.Table], DataFrame]) -> DataFrame:
    """Rows of search(pass) over passes of the queries, dealt by a hash of vec_id; ids don't repeat.

    A pass is counted before it is sent: it has at most PASS_BYTES of vectors, or one query.
    """
    spark, path = queries.sparkSession, scratch(queries.sparkSession, name)
    size = queries.agg(F.count("*").alias("n"), F.max(F.size(vectors_column)).alias("width")).first()
    most = max(1, PASS_BYTES // (8 * ((size.width or 0) + 16)))
    passes = -(-size.n // most) or 1
    deal = lambda: F.pmod(F.xxhash64("vec_id"), F.lit(passes))
    while passes > 1 and max(r["count"] for r in queries.groupBy(deal()).count().collect()) > most:
        passes += -(-passes // 8)
    for k in range(passes):
        search(queries.where(deal() == k).toArrow()).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def ranked_first(rows: DataFrame, keys: list[str], score: str, tie: str, k: int) -> DataFrame:
    """The k first rows of each key with their rank; Spark keeps k rows of a key and task before it shuffles."""
    order = Window.partitionBy(*keys).orderBy(F.desc(score), tie)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
