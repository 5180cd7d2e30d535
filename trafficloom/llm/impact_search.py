"""Exact top-k inner products from an impact-ordered index, score at a time.

Blocks of rows are indexed by signed dimension: the rows whose component has that sign, in segments of
equal quantised impact. A query takes the segments of all its dimensions in descending order of impact, the
largest amount that a posting can add to or take from a score, and keeps an upper bound of each row's score.
What it hasn't taken can add no more than the next segment's impact for each dimension that a row hasn't
been met in. It stops only when that proves that few rows can reach the k-th score known so far, and scores
those exactly. Without such a proof it takes all segments, and whatever may still be a member is scored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, prepare, record_batch
from .vectors import TopLists, Vectors, chunks, from_arrow, in_passes, integer_vectors, ranked_first, seeds

ROWS = 8192  # of a block
LEVELS = 32  # quantised impacts of a block
STEPS = 8  # in which a query takes its segments, with a test of the bounds after each
FEW = 16  # survivors below one row in FEW are scored instead of taking further segments

INDEX = pa.schema([("n", pa.int32()), ("width", pa.int64()), ("ids", pa.binary()), ("ints", pa.binary()), ("rows", pa.binary()), ("terms", pa.binary()), ("levels", pa.binary()), ("starts", pa.binary())])
INDEX_SCHEMA = "n int, width long, ids binary, ints binary, rows binary, terms binary, levels binary, starts binary"


def posting_segments(ints: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(width, rows, terms, levels, starts) of a block.

    Term 2 * d is dimension d with positive components, 2 * d + 1 with negative ones. A segment holds the rows
    whose component's size is above (level - 1) * width and at most level * width; zeros have no posting.
    """
    width = max(1, -(-int(np.abs(ints).max(initial=0)) // LEVELS))
    rows, dims = np.nonzero(ints)
    values = ints[rows, dims]
    key = (2 * dims + (values < 0)) * (LEVELS + 1) + LEVELS - -(-np.abs(values) // width)
    order = np.argsort(key, kind="stable")
    found, starts = np.unique(key[order], return_index=True)
    return width, rows[order].astype("<u2"), found // (LEVELS + 1), LEVELS - found % (LEVELS + 1), np.append(starts, len(rows))


class Block:
    """A block of the index, as a worker searches it."""

    def __init__(self, row: dict):
        numbers = lambda c, kind="<i8": np.frombuffer(row[c], kind).astype(np.int64)
        self.vectors = Vectors(numbers("ids"), numbers("ints").reshape(row["n"], -1 if row["ints"] else 0))
        self.width, self.rows, self.starts = row["width"], numbers("rows", "<u2"), numbers("starts")
        terms = numbers("terms")
        self.dims, self.signs, self.levels = terms // 2, 1 - 2 * (terms % 2), numbers("levels")
        self.sizes = np.diff(self.starts)
        self.segments = np.array([self.rows[a:b] for a, b in zip(self.starts, self.starts[1:])] + [None], object)[:-1]

    def search(self, query: np.ndarray, floor: float, own: int) -> np.ndarray:
        """Rows that may reach the floor, proved from impacts; rows with the id `own` are left out."""
        n = len(self.vectors)
        weights = np.zeros(self.vectors.ints.shape[1])
        d = min(len(weights), len(query))
        weights[:d] = query[:d]
        signed = weights[self.dims] * self.signs
        impacts = np.abs(signed) * self.levels * float(self.width)  # no posting of the segment adds or takes more
        order = np.argsort(-impacts, kind="stable")[: np.count_nonzero(impacts)]
        impacts, sizes = impacts[order], self.sizes[order]
        # the most that a posting adds: a negative product takes at least what the segment's lower edge takes
        gains = np.where(signed[order] > 0, impacts, signed[order] * ((self.levels[order] - 1) * float(self.width) + 1))
        slack = 1e-9 * float(np.abs(gains).sum()) + 0.5  # sums of doubles are rounded
        bound, unmet = np.zeros(n), np.full(n, np.count_nonzero(weights))
        done = np.cumsum(sizes)
        cuts = np.searchsorted(done, np.arange(1, STEPS + 1) * (n * d / STEPS)) + 1
        alive, a = np.arange(n), 0
        for b in map(int, cuts):
            b = min(b, len(order))
            if b > a:
                taken = np.concatenate(self.segments[order[a:b]])
                bound += np.bincount(taken, np.repeat(gains[a:b], sizes[a:b]), n)
                unmet -= np.bincount(taken, minlength=n)
            rest = impacts[b] if b < len(order) else 0.0
            alive = np.flatnonzero(bound + unmet * rest + slack >= floor)
            if len(alive) * FEW < n or b == len(order):
                break
            a = b
        return alive[self.vectors.ids[alive] != own]


def build(vectors: DataFrame) -> DataFrame:
    """The index of all rows (vec_id, v), written once: one row per block of at most ROWS rows."""
    prepare(vectors.sparkSession)

    def run(batches):
        for table in chunks(batches, ROWS):
            block = from_arrow(table)
            width, rows, terms, levels, starts = posting_segments(block.ints)
            made = {"ids": block.ids, "ints": block.ints, "terms": terms, "levels": levels, "starts": starts}
            yield record_batch({"n": [len(block)], "width": [width], "rows": [rows.tobytes()]} | {k: [x.astype("<i8").tobytes()] for k, x in made.items()}, INDEX)

    return materialise(vectors.select("vec_id", "v").mapInArrow(run, INDEX_SCHEMA), "impact-index")


FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
FOUND_SCHEMA = "query_id long, vec_id long, score long"


def top_k(index: DataFrame, queries: DataFrame, sample: Vectors, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of the index with the highest inner products with each query.

    Queries (vec_id, v) have distinct ids; rows of the query's own id are left out, ties go to the smaller id.
    sample holds rows of the index, whose scores give the first floors.
    """

    def search(table: pa.Table) -> DataFrame:
        asked = from_arrow(table)

        def run(batches):
            known = TopLists(len(asked), k)
            for a in range(0, len(asked), 1024):  # floors from the sample; its rows are found again with their blocks
                scores = asked.dot(sample, slice(a, a + 1024))
                q, r = np.nonzero(asked.ids[a : a + 1024, None] != sample.ids)
                known.add(q + a, scores[q, r], sample.ids[r])
            least, best = known.floors().copy(), TopLists(len(asked), k)
            for batch in batches:
                for row in batch.to_pylist():
                    block = Block(row)
                    for q in range(len(asked)):
                        floor = max(least[q], best.scores[q, -1])
                        alive = block.search(asked.ints[q], float(floor), asked.ids[q])
                        scores = block.vectors.dot(asked, alive, slice(q, q + 1))[:, 0]
                        some = scores >= floor
                        best.add(np.full(some.sum(), q), scores[some], block.vectors.ids[alive[some]])
            lists, scores, ids = best.found()
            yield record_batch({"query_id": asked.ids[lists], "vec_id": ids, "score": scores}, FOUND)

        return index.mapInArrow(run, FOUND_SCHEMA)

    found = in_passes(queries, "v", FOUND_SCHEMA, "impact-hits", search)
    return ranked_first(found, ["query_id"], "score", "vec_id", k).select("query_id", "rank", "vec_id", "score")


def nearest_report(embeddings: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose vec_id is divisible by `every`, against every other row.

    Rows with a null id or vector or a null or non-finite component take no part. Rows that repeat an id are
    each found; as a query such an id is asked once, with the greatest of its vectors, and finds none of its
    own. Empty vectors score 0. Empty tables give no rows; other columns are ignored.
    """
    vectors = integer_vectors(embeddings)
    asked = vectors.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.max("v").alias("v"))
    return top_k(build(vectors), asked, seeds(vectors), k)
