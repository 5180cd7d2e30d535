"""Text segments that are still being written, as a stream: each line once, from where the last batch stopped (A2).

Spark's file source takes a file once, when it appears. This one keeps a byte offset for each segment, takes
what was appended up to the last whole line, and reads long stretches as several ranges.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from ..schema import EVENT_SCHEMA
from ..workers import prepare

TAIL = 1 << 16  # bytes that are looked at together in the search for a line's end
PIECE = 1 << 20  # bytes that are read together
RANGES = 8  # of a batch for each core, before they become longer


def _open_store(path: str):
    """(file system, path in it) for a path or URI; works on the driver and in workers."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path.replace("file:///", "file:/", 1).replace("file:/", "file:///", 1))


def last_line_end(file, low: int, high: int) -> int:
    """Position after the last line break in [low, high); low if there is none."""
    while high > low:
        start = max(low, high - TAIL)
        file.seek(start)
        found = file.read(high - start).rfind(b"\n")
        if found >= 0:
            return start + found + 1
        high = start
    return low


@dataclass
class Stretch(InputPartition):
    """Lines of a segment that begin in [start, stop); whole says that start is a line's beginning."""

    segment: str
    start: int
    stop: int
    whole: bool


class SegmentReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.suffix, self.range_bytes = options["path"], options.get("suffix", ".jsonl"), int(options.get("rangeBytes", 32 << 20))
        self.ranges = int(options.get("ranges", 0))

    def initialOffset(self) -> dict:  # noqa: N802  (names that Spark calls)
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        """The end of the last whole line of every segment."""
        from pyarrow import fs

        store, base = _open_store(self.path)
        found = {}
        for info in store.get_file_info(fs.FileSelector(base, allow_not_found=True)):
            if info.is_file and info.base_name.endswith(self.suffix) and not info.base_name.startswith((".", "_")):
                with store.open_input_file(info.path) as file:
                    found[info.base_name] = last_line_end(file, 0, info.size)
        return found

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        """Ranges of rangeBytes; of more where a batch would have more than `ranges` of them, as each costs a task."""
        made, new = [], sum(stop - start.get(name, 0) for name, stop in end.items())
        size = max(self.range_bytes, -(-new // self.ranges)) if self.ranges else self.range_bytes
        for name, stop in sorted(end.items()):
            begun = start.get(name, 0)
            if begun > stop:
                raise ValueError(f"segment {name} has become shorter than what was read of it: {stop} < {begun}")
            for a in range(begun, stop, size):
                made.append(Stretch(name, a, min(stop, a + size), a == begun))
        return made

    def read(self, partition: Stretch) -> Iterator[tuple]:
        """(segment, position, line) of the stretch."""
        for batch in self.batches(partition):
            yield from zip(*(c.to_pylist() for c in batch.columns))

    def batches(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        """(segment, position, line) of the stretch, a batch a piece; the line that begins before its end is read to its own end."""
        store, base = _open_store(self.path)
        with store.open_input_file(f"{base.rstrip('/')}/{partition.segment}") as file:
            at = partition.start if partition.whole else partition.start - 1
            file.seek(at)
            held, skip = [], not partition.whole
            while at < partition.stop or skip:
                piece = file.read(PIECE)
                if not piece:
                    return
                cut = piece.rfind(b"\n") + 1
                if not cut:  # a long line: its pieces are put together once
                    held.append(piece)
                    continue
                text, held = b"".join([*held, piece[:cut]]), [piece[cut:]]
                lines = text[:-1].split(b"\n")
                positions = at + np.concatenate([[0], np.cumsum(np.fromiter(map(len, lines), np.int64, len(lines)) + 1)])
                at = int(positions[-1])
                first, skip = int(skip), False
                n = int(np.searchsorted(positions[:-1], partition.stop))
                if n > first:
                    try:
                        texts = pa.array(lines[first:n], pa.binary()).cast(pa.string())
                    except pa.ArrowInvalid:  # not UTF-8 somewhere
                        texts = pa.array([x.decode("utf-8", "replace") for x in lines[first:n]], pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array([partition.segment] * (n - first), pa.string()), pa.array(positions[first:n], pa.int64()), texts], names=["segment", "position", "line"])

    def commit(self, end: dict) -> None:
        pass


class BatchReader(SegmentReader):
    """The same for Spark, which takes whole record batches."""

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        return self.batches(partition)


class GrowingSegments(DataSource):
    """Format `growing_segments`. Options: path (a folder), suffix (.jsonl), rangeBytes (32 MB), ranges (beyond so many they become longer; 0: any number)."""

    @classmethod
    def name(cls) -> str:
        return "growing_segments"

    def schema(self) -> str:
        return "segment string, position bigint, line string"

    def streamReader(self, schema: StructType) -> SegmentReader:  # noqa: N802
        return BatchReader(self.options)


def tail_lines(spark: SparkSession, path: str, suffix: str = ".jsonl", range_bytes: int | None = None) -> DataFrame:
    """Stream of (segment, position, line): every whole line of the folder's segments once, as they grow.

    Offsets are bytes for each segment, kept in the query's checkpoint. A line without its line break yet waits.
    Segments may be removed when they were read; one that becomes shorter is an error.
    """
    prepare(spark)
    spark.dataSource.register(GrowingSegments)
    options = {"path": path, "suffix": suffix, "ranges": str(RANGES * spark.sparkContext.defaultParallelism)} | ({"rangeBytes": str(range_bytes)} if range_bytes else {})
    return spark.readStream.format("growing_segments").options(**options).load()


def _events(lines: DataFrame) -> DataFrame:
    parsed = F.from_json("line", f"{EVENT_SCHEMA}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    # a generator, since a condition on what it makes isn't moved before it: each line is parsed once
    return lines.select(F.inline(F.array(parsed)), "segment", "position")


def tail_growing_events(spark: SparkSession, path: str, **how) -> DataFrame:
    """Stream of journal events from JSON lines that are still being written; `_bad` has the text of what is none."""
    return _events(tail_lines(spark, path, **how))
