"""Operator 9: token ids in files of patched frame-of-reference blocks.

Documents are dealt by ranges of doc_id, encoded by the tokenizers library (distinct units once,
see `units`), and written as segments. A segment is a self-describing byte string:

    magic "PFR1", n_docs, n_ids, block size, n_blocks, n_exceptions     (little-endian uint32 each)
    ids per document                                                    uint32 x n_docs
    block index: minimum, first data word, first exception              uint32 x n_blocks each
    block widths                                                        uint8 x n_blocks
    exception places (uint8 x n_exceptions), exception values (uint32 x n_exceptions)
    packed words                                                        uint32

Each block of 256 ids keeps ids minus the block's minimum at the width that holds the chosen
percentile of them; larger ones leave their low bits in place and their full value in the exception
list. A block is packed as 8 lanes of 32 values, so width w takes 8 * w words. The table of segments
is committed by Spark's own writer, so a lost executor leaves neither gaps nor doubles.

Defined cases: null and empty texts are documents of the end id alone; null ids come first; rows of
equal doc_id are kept, ordered by their text's hash, each with its own start; an empty table gives
an empty result; further columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, partitions_for, prepare, record_batch, scratch, vocabulary_file
from .units import UnitMemo

BLOCK, LANES, STEPS = 256, 8, 32
SEGMENT_SCHEMA = "part int, seq int, ids_before long, n_ids long, doc_ids array<long>, payload binary"
SEGMENT = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("ids_before", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("payload", pa.binary())])


def pack(ids: np.ndarray, lengths: np.ndarray, percentile: float = 0.9) -> bytes:
    """One segment of len(lengths) documents whose ids follow each other in `ids`."""
    n_blocks = -(-len(ids) // BLOCK)
    if n_blocks:
        full = np.concatenate([ids, np.full(n_blocks * BLOCK - len(ids), ids[-1], np.uint32)]).astype(np.uint32).reshape(n_blocks, BLOCK)
    else:
        full = np.zeros((0, BLOCK), np.uint32)
    low = full.min(axis=1) if n_blocks else np.zeros(0, np.uint32)
    delta = full - low[:, None]
    at = min(BLOCK - 1, int(percentile * BLOCK))
    chosen = np.partition(delta, at, axis=1)[:, at] if n_blocks else low
    width = np.ceil(np.log2(chosen.astype(np.float64) + 1)).astype(np.uint8)
    over = delta >= (np.uint64(1) << width.astype(np.uint64))[:, None]
    block_of, place = np.nonzero(over)
    first_exception = np.searchsorted(block_of, np.arange(n_blocks)).astype(np.uint32)
    first_word = np.concatenate([[0], np.cumsum(LANES * width.astype(np.int64))])
    words = np.zeros(first_word[-1], np.uint32)
    for w in np.unique(width):
        if not w:
            continue
        w, rows = int(w), np.nonzero(width == w)[0]
        values = (delta[rows] & np.uint32((1 << w) - 1)).reshape(len(rows), STEPS, LANES)
        out = np.zeros((len(rows), w, LANES), np.uint32)
        for step in range(STEPS):
            word, shift = divmod(step * w, 32)
            out[:, word] |= values[:, step] << np.uint32(shift)
            if shift + w > 32:
                out[:, word + 1] |= values[:, step] >> np.uint32(32 - shift)
        words[first_word[rows][:, None] + np.arange(LANES * w)] = out.reshape(len(rows), -1)
    head = np.array([len(lengths), len(ids), BLOCK, n_blocks, len(place)], "<u4")
    return b"".join((b"PFR1", head.tobytes(), lengths.astype("<u4").tobytes(), low.astype("<u4").tobytes(), first_word[:-1].astype("<u4").tobytes(),
                     first_exception.astype("<u4").tobytes(), width.tobytes(), place.astype(np.uint8).tobytes(), delta[over].astype("<u4").tobytes(), words.astype("<u4").tobytes()))


def unpack(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ids per document) of a segment."""
    if payload[:4] != b"PFR1":
        raise ValueError("not a segment of token ids")
    n_docs, n_ids, block, n_blocks, n_over = np.frombuffer(payload, "<u4", 5, 4).tolist()
    at = 24

    def take(kind, n):
        nonlocal at
        got = np.frombuffer(payload, kind, n, at)
        at += got.nbytes
        return got

    lengths, low, first_word, first_over, width = take("<u4", n_docs), take("<u4", n_blocks), take("<u4", n_blocks), take("<u4", n_blocks), take("u1", n_blocks)
    place, value = take("u1", n_over), take("<u4", n_over)
    words = take("<u4", int((LANES * width.astype(np.int64)).sum()))
    delta = np.zeros((n_blocks, STEPS, LANES), np.uint32)
    for w in np.unique(width):
        if not w:
            continue
        w, rows = int(w), np.nonzero(width == w)[0]
        packed = words[first_word[rows].astype(np.int64)[:, None] + np.arange(LANES * w)].reshape(len(rows), w, LANES)
        mask = np.uint32((1 << w) - 1)
        got = np.empty((len(rows), STEPS, LANES), np.uint32)
        for step in range(STEPS):
            word, shift = divmod(step * w, 32)
            x = packed[:, word] >> np.uint32(shift)
            if shift + w > 32:
                x = x | packed[:, word + 1] << np.uint32(32 - shift)
            got[:, step] = x & mask
        delta[rows] = got
    delta = delta.reshape(n_blocks, BLOCK)
    if n_over:
        block_of = np.repeat(np.arange(n_blocks), np.diff(np.append(first_over, n_over).astype(np.int64)))
        delta[block_of, place] = value
    return (delta + low[:, None]).reshape(-1)[:n_ids], lengths


@lru_cache(maxsize=2)
def library_memo(path: str | None = None) -> UnitMemo:
    """A memo that the tokenizers library fills.

    Units that start with a blank and a non-blank are encoded many to a text, since no pre-token
    crosses such a border, and cut apart by the byte lengths of their tokens.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(vocabulary_file(path))
    own.no_truncation()
    own.no_padding()
    encode = getattr(own, "encode_batch_fast", own.encode_batch)
    vocabulary = own.get_vocab(with_added_tokens=True)
    n_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
    for token, i in vocabulary.items():
        n_bytes[i] = len(token)  # one letter stands for each byte

    def one_by_one(strings: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in encode(strings, add_special_tokens=False)] if strings else []

    def together(strings: list[str]) -> list[bytes]:
        groups = [strings[a: a + 200] for a in range(0, len(strings), 200)]
        out: list[bytes] = []
        joined = ["".join(g) for g in groups]
        for group, text, e in zip(groups, joined, encode(joined, add_special_tokens=False)):
            ids = np.array(e.ids, dtype="<u4")
            sizes = map(len, group) if text.isascii() else (len(x.encode("utf-8")) for x in group)
            ends, borders = np.cumsum(n_bytes[ids]), np.cumsum(np.fromiter(sizes, np.int64, len(group)))
            cut = np.searchsorted(ends, borders)
            if len(ids) and cut[-1] < len(ends) and (ends[cut] == borders).all():
                data, b = ids.tobytes(), ((cut + 1) * 4).tolist()
                out += [data[x:y] for x, y in zip([0, *b], b)]
            else:
                out += one_by_one(group)
        return out

    def resolve(strings: list[str]) -> list[bytes]:
        joins = [x[:1] == " " and x[1:2].strip() != "" for x in strings]
        many, few = iter(together([x for x, j in zip(strings, joins) if j])), iter(one_by_one([x for x, j in zip(strings, joins) if not j]))
        return [next(many) if j else next(few) for j in joins]

    return UnitMemo(resolve, limit=600_000)


def write_token_files(documents: DataFrame, path: str, end_id: int = 0, tokenizer_file: str | None = None, percentile: float = 0.9) -> None:
    """Encode doc_id, text in ascending doc_id order into segments under `path` (a Spark path)."""
    prepare(documents.sparkSession)

    def run(it):
        own, part, seq, before = library_memo(tokenizer_file), TaskContext.get().partitionId(), 0, 0
        end = np.array([end_id], "<u4").tobytes()
        for rows, texts in batches(it, 1):
            got = [x + end for x in own.encode(texts)]
            ids, lengths = np.frombuffer(b"".join(got), "<u4"), np.array([len(x) // 4 for x in got])
            yield record_batch({"part": [part], "seq": [seq], "ids_before": [before], "n_ids": [len(ids)], "doc_ids": [rows.column(0).to_pylist()], "payload": [pack(ids, lengths, percentile)]}, SEGMENT)
            seq, before = seq + 1, before + len(ids)

    rows = documents.select("doc_id", "text")
    ordered = rows.repartitionByRange(partitions_for(rows), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    ordered.mapInArrow(run, SEGMENT_SCHEMA).write.option("compression", "none").parquet(path)


READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])


def _segments(spark, path: str) -> DataFrame:
    """Segments with the number of ids before them; one row per written part is summed and broadcast."""
    table = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    parts = table.groupBy("part").agg(F.sum("n_ids").alias("n"))  # as many rows as the writer had tasks
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base"))
    return table.join(F.broadcast(parts), "part").select("doc_ids", (F.col("base") + F.col("ids_before")).alias("first"), "payload")


def read_token_files(spark, path: str) -> DataFrame:
    """doc_id, start, ids (little-endian uint32 bytes) of every document in the files under `path`."""
    prepare(spark)

    def run(it):
        for batch in it:
            for doc_ids, first, payload in zip(*(batch.column(k) for k in range(3))):
                ids, lengths = unpack(payload.as_py())
                ends = np.cumsum(lengths.astype(np.int64))
                data, b = ids.astype("<u4").tobytes(), (ends * 4).tolist()
                yield record_batch({"doc_id": doc_ids.as_py(), "start": ends - lengths + first.as_py(), "ids": [data[x:y] for x, y in zip([0, *b], b)]}, READ)

    return _segments(spark, path).mapInArrow(run, "doc_id long, start long, ids binary")


def file_digests(documents: DataFrame, path: str | None = None, end_id: int = 0, tokenizer_file: str | None = None) -> DataFrame:
    """Write documents to token files, read them back, and describe each document's ids."""
    path = path or scratch(documents.sparkSession, "token-files")
    write_token_files(documents, path, end_id, tokenizer_file)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def digest(it):
        for batch in it:
            for doc_ids, first, payload in zip(*(batch.column(k) for k in range(3))):
                ids, lengths = unpack(payload.as_py())
                ends = np.cumsum(lengths.astype(np.int64))
                data, b = memoryview(ids.astype("<u4").tobytes()), (ends * 4).tolist()
                yield record_batch({"doc_id": doc_ids.as_py(), "start": ends - lengths + first.as_py(), "n_tokens": lengths.astype(np.int64), "ids_crc32": [zlib.crc32(data[x:y]) for x, y in zip([0, *b], b)]}, schema)

    return _segments(documents.sparkSession, path).mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
