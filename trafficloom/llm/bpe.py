"""Operator 8: byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks.

Each pre-token's symbols stand at the leaves of a segment tree; leaf i holds the rank of the pair
(i, next symbol) joined with i, so the root is the leftmost pair of the lowest rank. A merge changes
three leaves, each renewed on its path to the root, until no pair can be merged. Many distinct short
pre-tokens are processed side by side as the rows of numpy arrays; longer ones one at a time.

Defined cases: null and empty texts have no ids; texts of any length are encoded whole; equal rows
give equal results, row for row; an empty table gives an empty table; further columns pass through
`encode` and `decode` untouched (a column that has the name of the output is replaced).
"""

from __future__ import annotations

import hashlib
import json
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import append_in_arrow, batches, prepare, record_batch, vocabulary_file
from .units import PRE_TOKEN, SPECIAL, UnitMemo

NONE = np.int32(2**31 - 1)  # rank of what can't be merged
WIDEST = 64  # bytes of a pre-token that still joins a numpy batch


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in the vocabulary file: itself, or the next free code from 256."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class MergeTable:
    """Vocabulary and merges of a byte-level BPE file as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        vocab: dict[str, int] = model["model"]["vocab"]
        letters = byte_letters()
        self.byte_id = np.array([vocab[c] for c in letters], dtype=np.int32)
        as_byte = {c: b for b, c in enumerate(letters)}
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.token_bytes = [b""] * size
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(as_byte[c] for c in token) if all(c in as_byte for c in token) else token.encode()
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)
        self.size = size
        keys = left * size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = np.append(keys[order], np.int64(2**62)), np.append(order.astype(np.int32), NONE)
        self.rank_of = dict(zip(keys.tolist(), range(len(keys))))

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * self.size + b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)


class RankTree:
    """Segment tree over one symbol sequence of any length; a node is rank * width + place, in flat arrays."""

    def __init__(self, table: MergeTable, data: bytes):
        self.table, n = table, len(data)
        ids = table.byte_id[np.frombuffer(data, np.uint8)]
        self.ids, self.next, self.prev = array("i", ids.tobytes()), array("i", range(1, n + 1)), array("i", range(-1, n - 1))
        self.width = 1 << max(0, (n - 1)).bit_length()
        tree = np.full(2 * self.width, int(NONE) * self.width, np.int64)
        rank = table.pair_ranks(ids[:-1], ids[1:]).astype(np.int64)
        tree[self.width: self.width + max(0, n - 1)] = rank * self.width + np.where(rank == NONE, 0, np.arange(max(0, n - 1)))
        level = self.width
        while level > 1:
            tree[level // 2: level] = np.minimum(tree[level: 2 * level: 2], tree[level + 1: 2 * level: 2])
            level //= 2
        self.tree, self.none = array("q", tree.tobytes()), int(NONE) * self.width

    def put(self, i: int, value: int) -> None:
        tree, at = self.tree, self.width + i
        tree[at] = value
        while at > 1:
            at >>= 1
            least = min(tree[2 * at], tree[2 * at + 1])
            if tree[at] == least:
                break  # nothing changes above
            tree[at] = least

    def node(self, i: int) -> int:
        j = self.next[i]
        rank = self.table.rank_of.get(self.ids[i] * self.table.size + self.ids[j]) if j < len(self.ids) else None
        return self.none if rank is None else rank * self.width + i

    def run(self) -> np.ndarray:
        n = len(self.ids)
        while self.tree[1] < self.none:
            rank, i = divmod(self.tree[1], self.width)
            j = self.next[i]
            self.ids[i], self.next[i] = int(self.table.merged[rank]), self.next[j]
            if self.next[j] < n:
                self.prev[self.next[j]] = i
            self.put(j, self.none)
            self.put(i, self.node(i))
            if self.prev[i] >= 0:
                self.put(self.prev[i], self.node(self.prev[i]))
        out, i = array("i"), 0
        while i < n:
            out.append(self.ids[i])
            i = self.next[i]
        return np.array(out, dtype="<u4")


def merge_rows(table: MergeTable, data: list[bytes]) -> list[bytes]:
    """The same trees for many short sequences at once: row r of each array is one sequence."""
    n, width = len(data), 1 << max(1, (max(map(len, data)) - 1).bit_length())
    lengths = np.fromiter(map(len, data), np.int64, n)
    raw = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in data), np.uint8).reshape(n, width)
    ids = np.zeros((n, width + 1), np.int32)
    ids[:, :width] = table.byte_id[raw]
    cols = np.arange(width)
    live = np.zeros((n, width + 1), bool)
    live[:, :width] = cols < lengths[:, None]
    nxt = np.broadcast_to(np.arange(1, width + 2, dtype=np.int32), (n, width + 1)).copy()
    prv = np.broadcast_to(np.arange(-1, width, dtype=np.int32), (n, width + 1)).copy()
    tree = np.full((n, 2 * width), NONE, np.int32)
    rows, at = np.nonzero(cols[None, : width - 1] < (lengths - 1)[:, None])
    rank = table.pair_ranks(ids[rows, at], ids[rows, at + 1])
    ok = rank != NONE
    tree[rows[ok], width + at[ok]] = rank[ok] * width + at[ok]
    level = width
    while level > 1:
        tree[:, level // 2: level] = np.minimum(tree[:, level: 2 * level: 2], tree[:, level + 1: 2 * level: 2])
        level //= 2
    flat, stride = tree.reshape(-1), 2 * width

    def put(r, i, value):
        base = r * stride
        node = width + i
        flat[base + node] = value
        while width > 1 and node[0] > 1:
            node = node >> 1
            flat[base + node] = np.minimum(flat[base + 2 * node], flat[base + 2 * node + 1])

    def ranks(r, i, j):
        ends = j >= lengths[r]
        got = table.pair_ranks(ids[r, i], ids[r, np.minimum(j, width)])
        return np.where(ends | (got == NONE), NONE, got * width + i).astype(np.int32)

    active = np.nonzero(tree[:, 1] != NONE)[0]
    while len(active):
        root = tree[active, 1]
        i = root % width
        j = nxt[active, i]
        k = nxt[active, j]
        ids[active, i] = table.merged[root // width]
        nxt[active, i] = k
        prv[active, np.minimum(k, width)] = i
        live[active, j] = False
        put(active, j, NONE)
        put(active, i, ranks(active, i, k))
        h = prv[active, i]
        has = h >= 0
        if has.any():
            r, hh = active[has], h[has]
            put(r, hh, ranks(r, hh, i[has]))
        active = active[tree[active, 1] != NONE]
    out = ids[live].astype("<u4").tobytes()
    ends = np.cumsum(live.sum(axis=1)) * 4
    starts = ends - live.sum(axis=1) * 4
    return [out[a:b] for a, b in zip(starts.tolist(), ends.tolist())]


def encode_pieces(table: MergeTable, pieces: list[bytes]) -> list[bytes]:
    """Ids (little-endian uint32) of distinct pre-tokens, each by its own rank tree."""
    out: list[bytes] = [b""] * len(pieces)
    by_width: dict[int, list[int]] = {}
    for i, p in enumerate(pieces):
        if len(p) > WIDEST:
            out[i] = RankTree(table, p).run().tobytes()
        elif p:
            by_width.setdefault((len(p) - 1).bit_length(), []).append(i)
    for rows in by_width.values():
        for a in range(0, len(rows), 20_000):
            part = rows[a: a + 20_000]
            for i, got in zip(part, merge_rows(table, [pieces[i] for i in part])):
                out[i] = got
    return out


class SegmentTreeTokenizer:
    """Whole texts to ids and back, over a vocabulary file at `path`."""

    def __init__(self, path: str | None = None):
        self.table = MergeTable(vocabulary_file(path))
        self.memo = UnitMemo(self._resolve)

    def _resolve(self, strings: list[str]) -> list[bytes]:
        split = [[s] if s == SPECIAL else PRE_TOKEN.findall(s) for s in strings]
        pieces = list({p for row in split for p in row})
        ids = dict(zip(pieces, encode_pieces(self.table, [p.encode("utf-8") for p in pieces])))
        for token, i in self.table.special.items():
            if token in ids:
                ids[token] = np.array([i], dtype="<u4").tobytes()
        return [b"".join(map(ids.__getitem__, row)) for row in split]

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.memo.encode(texts)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.table.token_bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def tokenizer(path: str | None = None) -> SegmentTreeTokenizer:
    return SegmentTreeTokenizer(path)


def encode(df: DataFrame, text: str = "text", ids: str = "ids", path: str | None = None) -> DataFrame:
    """df with a column of token ids (array<int>); null and empty texts get an empty array."""
    prepare(df.sparkSession)
    at = df.columns.index(text)

    def run(it):
        own = tokenizer(path)
        for part, texts in batches(it, at):
            got = own.encode(texts)
            offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in got])]).astype(np.int32)
            yield part, [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(got), "<u4").astype(np.int32)))]

    return append_in_arrow(df, [T.StructField(ids, T.ArrayType(T.IntegerType()))], run)


def decode(df: DataFrame, ids: str = "ids", text: str = "text", path: str | None = None) -> DataFrame:
    """df with the text that its ids spell; a null list gives an empty text."""
    prepare(df.sparkSession)
    at = df.columns.index(ids)

    def run(it):
        own = tokenizer(path)
        for batch in it:
            yield batch, [pa.array([own.decode(np.array(x or [], dtype="<u4").tobytes()) for x in batch.column(at).to_pylist()], pa.string())]

    return append_in_arrow(df, [T.StructField(text, T.StringType())], run)


def encode_checked(df: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """df with n_tokens, lossless (the ids spell the text again) and ids (array<int>), in one pass over the texts.

    Columns of these names are replaced; null texts count as empty.
    """
    prepare(df.sparkSession)
    at = df.columns.index(text)

    def run(it):
        own = tokenizer(path)
        for part, texts in batches(it, at, 1_000_000):
            got = own.encode(texts)
            sizes = np.fromiter((len(x) // 4 for x in got), np.int64, len(got))
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            ids = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(got), "<u4").astype(np.int32)))
            yield part, [pa.array(sizes), pa.array([own.decode(x) == t for x, t in zip(got, texts)], pa.bool_()), ids]

    made = [T.StructField("n_tokens", T.LongType()), T.StructField("lossless", T.BooleanType()), T.StructField("ids", T.ArrayType(T.IntegerType()))]
    return append_in_arrow(df, made, run)


ROUND_TRIP = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def round_trip(documents: DataFrame, path: str | None = None) -> DataFrame:
    """Per document: number of ids, digest of the ids, digest of the text decoded from these ids."""
    prepare(documents.sparkSession)

    def run(it):
        own = tokenizer(path)
        for part, texts in batches(it, 1):
            got = own.encode(texts)
            yield record_batch({
                "doc_id": part.column(0),
                "n_tokens": [len(x) // 4 for x in got],
                "ids_sha256": [hashlib.sha256(x).hexdigest() for x in got],
                "decoded_sha256": [hashlib.sha256(own.decode(x).encode("utf-8")).hexdigest() for x in got],
            }, ROUND_TRIP)

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
