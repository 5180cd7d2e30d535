"""CRC-32C of binary values and of concatenations, vectorised over rows.

A checksum is linear over GF(2): that of a concatenation follows from the parts' sums and lengths, as
adding n bytes behind a part multiplies its sum by x ** (8 * n). So values are cut into blocks of one
length, all blocks of a batch advance together by four bytes at a time, and blocks and parts are put
together in pairs. Nothing is copied to be joined.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

CASTAGNOLI = 0x82F63B78  # fixed value: the polynomial, reflected
ONES = 0xFFFFFFFF
BLOCKS = 16_384  # advanced together


@cache
def byte_tables() -> np.ndarray:
    """For k from 0 to 3 the remainder of each byte that k more bytes follow."""
    first = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        first = np.where(first & 1, first >> 1 ^ np.uint32(CASTAGNOLI), first >> 1)
    tables = [first]
    for _ in range(3):
        tables.append(first[tables[-1] & 255] ^ tables[-1] >> 8)
    return np.stack(tables)


def mapped(tables: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """A linear map, given as the images of each byte at each of the four places, of many sums."""
    return tables[0][sums & 255] ^ tables[1][sums >> 8 & 255] ^ tables[2][sums >> 16 & 255] ^ tables[3][sums >> 24]


@cache
def doubling(k: int) -> np.ndarray:
    """The map that appends 2 ** k zero bytes to a sum."""
    values = np.arange(256, dtype=np.uint32)
    if k == 0:
        first = byte_tables()[0]
        return np.stack([first[values], *[values << np.uint32(8 * place) >> np.uint32(8) for place in (1, 2, 3)]])
    before = doubling(k - 1)
    return np.stack([mapped(before, before[place]) for place in range(4)])


def appended(sums: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each sum with so many zero bytes behind it."""
    sums, k = sums.copy(), 0
    while (rest := lengths >> k).any():
        some = np.flatnonzero(rest & 1)
        sums[some] = mapped(doubling(k), sums[some])
        k += 1
    return sums


def folded(sums: np.ndarray, lengths: np.ndarray, groups: np.ndarray, n: int) -> np.ndarray:
    """For each of n groups the sum of its members' concatenation; members of a group stand together, in order.

    A member is moved by what follows it in its group; the group's sum is then theirs, bit by bit.
    """
    ends = np.cumsum(lengths)
    last = np.zeros(n, np.int64)
    np.maximum.at(last, groups, ends)
    moved = appended(sums, last[groups] - ends)
    out = np.zeros(n, np.uint32)
    np.bitwise_xor.at(out, groups, moved)
    return out


@cache
def pair_tables() -> tuple[np.ndarray, np.ndarray]:
    """What the low and the high half of a state become by the time four bytes have passed."""
    t, low, high = byte_tables(), np.arange(1 << 16) & 255, np.arange(1 << 16) >> 8
    return t[3][low] ^ t[2][high], t[1][low] ^ t[0][high]


def right_aligned(data: np.ndarray, lengths: np.ndarray, counts: np.ndarray, block: int) -> np.ndarray:
    """The values, which stand one behind the other in data, each with zeros before it up to whole blocks."""
    ends = np.cumsum(counts) * block
    edges = np.zeros(int(ends[-1]) + 1, np.int8)
    np.add.at(edges, ends - lengths, 1)
    np.add.at(edges, ends, -1)
    out = np.zeros(len(edges) - 1, np.uint8)
    out[np.cumsum(edges[:-1], dtype=np.int8).view(bool)] = data
    return out


def raw_sums(data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums, from zero, of values that stand one behind the other in data: zeros before a value change nothing."""
    if not len(data):
        return np.zeros(len(lengths), np.uint32)
    block = 1 << int(np.clip(np.log2(len(data) / np.count_nonzero(lengths)), 4, 9))  # few zeros to add, many blocks to advance at once
    counts = -(-lengths // block)
    words = np.ascontiguousarray(right_aligned(data, lengths, counts, block).view("<u4").reshape(-1, block // 4).T)
    out, (low, high) = np.zeros(words.shape[1], np.uint32), pair_tables()
    for a in range(0, len(out), BLOCKS):
        state = out[a : a + BLOCKS]
        for word in words[:, a : a + BLOCKS]:
            state ^= word
            state[:] = low.take(state & 0xFFFF) ^ high.take(state >> 16)
    return folded(out, np.full(len(out), block), np.repeat(np.arange(len(lengths)), counts), len(lengths))


def finished(sums: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Checksums as they are written, from sums that began with zero."""
    return (sums ^ appended(np.full(len(sums), ONES, np.uint32), lengths) ^ np.uint32(ONES)).astype(np.int64)


def _values(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, lengths) of a binary array, its values one behind the other; a null is an empty value."""
    kind = np.int64 if pa.types.is_large_binary(array.type) else np.int32
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64)
    offsets = np.frombuffer(array.buffers()[1], kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    data = array.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], np.diff(offsets)


@F.arrow_udf(T.LongType())
def crc32c(data: pa.Array) -> pa.Array:
    """CRC-32C of binary values; null of null. Spark itself has CRC-32 only."""
    raw, lengths = _values(data)
    return pa.array(finished(raw_sums(raw, lengths), lengths), pa.int64(), mask=data.is_null().to_numpy(zero_copy_only=False))


@F.arrow_udf(T.LongType())
def crc32c_of_parts(parts: pa.Array) -> pa.Array:
    """CRC-32C of the concatenation of an array of binary values, from the parts' own sums; null of null."""
    counts = parts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    owner, whole = np.repeat(np.arange(len(parts)), counts), np.zeros(len(parts), np.int64)
    raw, lengths = _values(parts.flatten())
    np.add.at(whole, owner, lengths)
    sums = folded(raw_sums(raw, lengths), lengths, owner, len(parts))
    return pa.array(finished(sums, whole), pa.int64(), mask=parts.is_null().to_numpy(zero_copy_only=False))
