"""Hard negatives under angular triangle filtering.

Every row is indexed with its angles to reference directions. Rows are put in the order of their nearest
reference and the angle to it, and cut into windows that keep the range of their norms and of the angles to
every reference. The angle between an anchor and any row of a window is at least the largest gap and at most
the smallest sum of their angles to a reference, so cosine and norms bound the window's scores. Bounds are
widened by more than rounding can move them. Only windows whose bounds overlap the scores that an anchor
still seeks are scored, in integers; the others are proved to hold nothing for it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, partitions_for, prepare, record_batch
from .vectors import LEAST, TopLists, Vectors, chunks, from_arrow, in_passes, integer_vectors, ranked_first, seeds

REFERENCES = 32  # directions, chosen from the sample
ROWS = 256  # of a window
ANCHORS = 1024  # whose bounds are held at a time
SLACK = 4e-6  # radians: angles are stored in single precision


def directions(sample: Vectors, n: int = REFERENCES) -> np.ndarray:
    """Unit vectors of up to n rows of the sample, each the one with the greatest angle to those before it."""
    units = sample.real[sample.norms > 0] / sample.norms[sample.norms > 0, None]
    if not len(units):
        return np.zeros((0, sample.ints.shape[1]))
    chosen = [0]
    nearest = units @ units[0]
    while len(chosen) < min(n, len(units)):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, units @ units[chosen[-1]])
    return units[chosen]


def angles(rows: Vectors, references: np.ndarray) -> np.ndarray:
    """Angle of each row to each reference; a right angle where a row has no direction."""
    d = min(rows.ints.shape[1], references.shape[1])
    cosines = (rows.real[:, :d] @ references[:, :d].T) / np.where(rows.norms > 0, rows.norms, 1)[:, None]
    return np.arccos(np.clip(cosines, -1, 1)).astype(np.float32)


INDEX = pa.schema([("n", pa.int32()), ("ids", pa.binary()), ("labels", pa.binary()), ("ints", pa.binary()), ("low", pa.binary()), ("high", pa.binary())])
INDEX_SCHEMA = "n int, ids binary, labels binary, ints binary, low binary, high binary"


def build(vectors: DataFrame, references: np.ndarray) -> DataFrame:
    """Windows of all rows (vec_id, label, v), written once: rows, and the ranges of their angles."""
    prepare(vectors.sparkSession)

    def measure(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            found = angles(from_arrow(batch), references)
            near = found.argmin(axis=1) if found.size else np.zeros(len(found), np.int64)
            least = found.min(axis=1) if found.size else np.zeros(len(found), np.float32)
            stored = pa.array([x.tobytes() for x in found], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, stored, pa.array(near, pa.int32()), pa.array(least, pa.float32())], names=[*batch.schema.names, "angles", "near", "angle"])

    def cut(batches):
        for table in chunks(batches, ROWS):
            rows = from_arrow(table, "label")
            found = np.frombuffer(b"".join(table.column("angles").to_pylist()), np.float32).reshape(len(rows), -1 if len(references) else 0)
            made = {"ids": rows.ids, "labels": rows.more["label"], "ints": rows.ints, "low": found.min(axis=0), "high": found.max(axis=0)}
            yield record_batch({"n": [len(rows)]} | {k: [v.tobytes()] for k, v in made.items()}, INDEX)

    measured = vectors.select("vec_id", "label", "v").mapInArrow(measure, "vec_id long, label int, v array<long>, angles binary, near int, angle float")
    measured = materialise(measured, "angles")
    # the id splits what many equal vectors share
    ordered = measured.repartitionByRange(partitions_for(measured), "near", "angle", "vec_id").sortWithinPartitions("near", "angle", "vec_id")
    return materialise(ordered.mapInArrow(cut, INDEX_SCHEMA), "angle-index")


class Window:
    """A window of the index, as a worker reads it."""

    def __init__(self, row: dict):
        self.rows = Vectors(np.frombuffer(row["ids"], np.int64), np.frombuffer(row["ints"], np.int64).reshape(row["n"], -1 if row["ints"] else 0), label=np.frombuffer(row["labels"], np.int64))
        self.low, self.high = (np.frombuffer(row[c], np.float32).astype(np.float64) for c in ("low", "high"))
        self.norms = self.rows.norms.min(), self.rows.norms.max()

    def bounds(self, norms: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score of any row with anchors of these norms and angles, widened for rounding."""
        least = np.maximum(np.maximum(self.low - found, found - self.high), 0).max(axis=1, initial=0) - SLACK
        most = np.minimum(self.high + found, 2 * np.pi - self.low - found).min(axis=1, initial=np.pi) + SLACK
        near, far = np.cos(np.clip(least, 0, np.pi)), np.cos(np.clip(most, 0, np.pi))
        upper = norms * np.where(near > 0, near * self.norms[1], near * self.norms[0])
        lower = norms * np.where(far > 0, far * self.norms[0], far * self.norms[1])
        room = 1 + 1e-9 * norms * self.norms[1]
        return np.floor(lower - room), np.ceil(upper + room)


def scored(batches, anchors: Vectors, found: np.ndarray, sought):
    """(anchors, window, their integer scores) wherever a window's bounds overlap what sought(slice) gives: (lowest, highest) by anchor."""
    for batch in batches:
        for row in batch.to_pylist():
            window = Window(row)
            for a in range(0, len(anchors), ANCHORS):
                part = slice(a, a + ANCHORS)
                lower, upper = window.bounds(anchors.norms[part], found[part])
                lowest, highest = sought(part)
                some = np.flatnonzero((upper >= lowest) & (lower <= highest)) + a
                if len(some):
                    yield some, window.rows, anchors.dot(window.rows, some)


FOUND = pa.schema([("anchor_id", pa.int64()), ("place", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])
FOUND_SCHEMA = "anchor_id long, place int, vec_id long, score long"


def positives(index: DataFrame, anchors: DataFrame, sample: Vectors, references: np.ndarray, k: int) -> DataFrame:
    """anchor_id, place (from 1), vec_id, score: each anchor's k first other rows of its label."""

    def search(table: pa.Table) -> DataFrame:
        asked = from_arrow(table, "label")
        found = angles(asked, references).astype(np.float64)

        def run(batches):
            known = TopLists(len(asked), k)  # the sample's scores: a floor, its rows are found again with their windows
            for a in range(0, len(asked), ANCHORS):
                part = slice(a, a + ANCHORS)
                scores = asked.dot(sample, part)
                q, r = np.nonzero((asked.more["label"][part, None] == sample.more["label"]) & (asked.ids[part, None] != sample.ids))
                known.add(q + a, scores[q, r], sample.ids[r])
            least, best = known.floors().copy(), TopLists(len(asked), k)
            floors = lambda part: np.maximum(least[part], best.floors()[part])
            for some, rows, scores in scored(batches, asked, found, lambda part: (floors(part), np.inf)):
                fits = (scores >= floors(some)[:, None]) & (asked.more["label"][some, None] == rows.more["label"]) & (asked.ids[some, None] != rows.ids)
                q, r = np.nonzero(fits)
                best.add(some[q], scores[q, r], rows.ids[r])
            lists, scores, ids = best.found()
            yield record_batch({"anchor_id": asked.ids[lists], "place": np.zeros(len(lists), np.int32), "vec_id": ids, "score": scores}, FOUND)

        return index.mapInArrow(run, FOUND_SCHEMA)

    hits = in_passes(anchors, "v", FOUND_SCHEMA, "positive-hits", search)
    return ranked_first(hits, ["anchor_id"], "score", "vec_id", k).select("anchor_id", F.col("rank").alias("place"), "vec_id", "score")


def negatives(index: DataFrame, anchors: DataFrame, references: np.ndarray, width: int, k: int, num: int, den: int) -> DataFrame:
    """anchor_id, place, vec_id, score: for each positive (in `found`, at most `width`) of an anchor the k first rows of other
    labels that score at most as the positive and at least num / den of it."""

    def search(table: pa.Table) -> DataFrame:
        asked = from_arrow(table.drop_columns(["found"]), "label")
        found = angles(asked, references).astype(np.float64)
        high, low = np.full((len(asked), width), LEAST), np.full((len(asked), width), LEAST)
        for i, own in enumerate(table.column("found").to_pylist()):
            for x in own:
                if x["score"] >= 0:  # a negative score's num / den is above itself: nothing lies between
                    high[i, x["place"] - 1], low[i, x["place"] - 1] = x["score"], -(-num * x["score"] // den)

        def run(batches):
            best = TopLists(len(asked) * width, k)
            floors = lambda: np.where(high == LEAST, np.iinfo(np.int64).max, np.maximum(low, best.floors().reshape(-1, width)))
            for some, rows, scores in scored(batches, asked, found, lambda part: (floors()[part].min(axis=1), high[part].max(axis=1))):
                other = (asked.more["label"][some, None] != rows.more["label"]) & (asked.ids[some, None] != rows.ids)
                least = floors()[some]
                for place in range(width):
                    q, r = np.nonzero(other & (scores >= least[:, place, None]) & (scores <= high[some, place, None]))
                    best.add(some[q] * width + place, scores[q, r], rows.ids[r])
            lists, scores, ids = best.found()
            yield record_batch({"anchor_id": asked.ids[lists // width], "place": (lists % width + 1).astype(np.int32), "vec_id": ids, "score": scores}, FOUND)

        return index.mapInArrow(run, FOUND_SCHEMA)

    hits = in_passes(anchors, "v", FOUND_SCHEMA, "negative-hits", search)
    return ranked_first(hits, ["anchor_id", "place"], "score", "vec_id", k).withColumnRenamed("rank", "order")


def mined(labelled: DataFrame, chosen: F.Column, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows (vec_id, label, v) that `chosen` names.

    Ids that repeat: every row may be found; an anchor is asked once, with the greatest of its labels and vectors,
    and rows of its own id are neither its positives nor its negatives.
    """
    anchors = labelled.where(chosen).groupBy("vec_id").agg(F.max(F.struct("label", "v")).alias("x")).select("vec_id", "x.label", "x.v")
    sample = seeds(labelled, "label")
    references = directions(sample)
    index = build(labelled, references)
    first = materialise(positives(index, anchors, sample, references, k), "positives")
    lists = first.groupBy("anchor_id").agg(F.collect_list(F.struct("place", "score")).alias("found"))  # at most k each
    asked = anchors.join(lists, F.col("vec_id") == F.col("anchor_id")).select("vec_id", "label", "v", "found")
    after = negatives(index, materialise(asked, "anchors"), references, k, k, num, den)
    named = first.select("anchor_id", "place", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    joined = after.select("anchor_id", "place", F.col("order").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(named, ["anchor_id", "place"])
    return joined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def noisy_report(embeddings: DataFrame) -> DataFrame:
    """Hard negatives of the rows whose vec_id is divisible by 100, after the label of every seventh id has moved on by one.

    Rows with a null id, label or vector or a null or non-finite component take no part; anchors without a positive, and
    positives without a row in their range, have no row. Ties go to the smaller id; see `mined` for repeated ids. Empty
    vectors score 0. Empty tables give no rows; other columns are ignored.
    """
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("int")
    rows = integer_vectors(embeddings.where("label is not null"), moved.alias("label"))
    return mined(rows, F.col("vec_id") % 100 == 0)
