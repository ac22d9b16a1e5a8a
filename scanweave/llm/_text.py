"""Whole-batch text kernels: texts stay one UTF-8 buffer, words are (start, end) pairs and 64-bit hashes.

All functions take the concatenated bytes of several documents and their offsets, so that one NumPy call
serves thousands of documents. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that one pass over a batch looks at; bounds a Python worker's temporary arrays.
CHUNK_BYTES = 1 << 19

_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

#: [^\x20\x09-\x0D]+
BLANK_WORDS = np.ones(256, dtype=bool)
BLANK_WORDS[[0x20, 9, 10, 11, 12, 13]] = False

#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (after lower-casing A-Z)
ALNUM_WORDS = np.ones(256, dtype=bool)
ALNUM_WORDS[0x00:0x30] = ALNUM_WORDS[0x3A:0x61] = ALNUM_WORDS[0x7B:0x80] = False


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: a bijection on 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def lower(buf: np.ndarray) -> np.ndarray:
    """A-Z in lower case; other bytes stay."""
    return np.frombuffer(buf.tobytes().translate(_LOWER), dtype=np.uint8)


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the offsets of its rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary()
    column = column.cast(pa.large_string()).cast(kind) if pa.types.is_string(column.type) else column.cast(kind)
    if column.null_count:
        column = pc.fill_null(column, b"")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64, count=len(column) + 1, offset=column.offset * 8) if offsets else np.zeros(1, np.int64)
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    whole = np.frombuffer(data, dtype=np.uint8)
    return whole[offs[0] : offs[-1]], offs - offs[0]


def slices(offsets: np.ndarray, limit: int = CHUNK_BYTES, rows: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of at most `rows` rows and `limit` bytes; a longer row is alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        j = min(j, i + rows)
        yield i, j
        i = j


def chunks(column, limit: int = CHUNK_BYTES, rows: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, past row, bytes, offsets from 0) of runs of rows."""
    buf, offsets = utf8(column)
    for i, j in slices(offsets, limit, rows):
        yield i, j, buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def words(buf: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): maximal runs of `member` bytes within rows; words of row i are first[i]:first[i+1]."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    inside = np.frombuffer(buf.tobytes().translate(member.tobytes()), dtype=bool)
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    edge = offsets[:-1][offsets[:-1] < len(buf)]
    before[edge] = False
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after[edge[edge > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span's bytes, eight bytes a step."""
    length = ends - starts
    out = mix(length.astype(np.uint64) + np.uint64(seed) * _GOLD + _GOLD)
    if not len(starts):
        return out
    padded = np.zeros(len(buf) + 8, dtype=np.uint8)
    padded[: len(buf)] = buf
    eights = np.ndarray((len(buf) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    live, at, k = None, starts, 0
    while True:
        left = (length if live is None else length[live]) - 8 * k
        part = eights[at + 8 * k] & _MASK[np.minimum(left, 8)]
        if live is None:
            out = mix(out ^ part)
            live = np.flatnonzero(length > 8)
        else:
            out[live] = mix(out[live] * _GOLD ^ part)
            live = live[left > 8]
        k += 1
        if not len(live):
            return out
        at = starts[live]


def row_of(first: np.ndarray, n: int) -> np.ndarray:
    """The row of each of n items when row i has items first[i]:first[i+1]."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """A hash of every `width` consecutive items (n - width + 1 of them), by doubling."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    have, cur, out, done = 1, h, None, 0
    while True:
        if width & have:
            part = cur[done : done + n]
            out = part.copy() if out is None else mix(out * _GOLD ^ part)
            done += have
        if done == width:
            return out
        cur = mix(cur[:-have] * _GOLD ^ cur[have:])
        have *= 2


def sort_order(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, sorted): a stable sort of 64-bit hashes, several times faster than argsort.

    The index rides in the low bits of the sort key; the few runs whose high bits agree by chance are put right.
    """
    n = len(h)
    if n < 2:
        return np.arange(n), h
    bits = np.uint64((n - 1).bit_length())
    low = (np.uint64(1) << bits) - np.uint64(1)
    key = (h & ~low) | np.arange(n, dtype=np.uint64)
    key.sort()
    order = (key & low).astype(np.int64)
    x = h[order]
    same = (x[1:] ^ x[:-1]) >> bits == 0
    if np.any(same & (x[1:] != x[:-1])):
        run = np.concatenate([[0], np.cumsum(~same)])
        for r in np.unique(run[1:][same & (x[1:] != x[:-1])]):
            i, j = np.searchsorted(run, [r, r + 1])
            part = order[i:j][np.argsort(x[i:j], kind="stable")]
            order[i:j] = part
            x[i:j] = h[part]
    return order, x


def multikey_order(columns: list[np.ndarray]) -> np.ndarray:
    """The order of rows of 64-bit words: parted by one word at a time, and only rows still tied look at the next."""
    order, x = sort_order(columns[0])
    n = len(order)
    start = np.ones(n, bool)
    start[1:] = x[1:] != x[:-1]
    for column in columns[1:]:
        run = np.cumsum(start) - 1
        tied = np.flatnonzero(np.bincount(run)[run] > 1) if n else run
        if not len(tied):
            break
        group, value = run[tied], column[order[tied]]
        by = np.lexsort((value, group))
        order[tied] = order[tied][by]
        value = value[by]
        start[tied[1:]] |= (group[1:] == group[:-1]) & (value[1:] != value[:-1])
    return order


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(values ascending, index of a first occurrence, inverse, counts)."""
    order, x = sort_order(h)
    new = np.concatenate([[True], x[1:] != x[:-1]]) if len(x) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    inverse = np.empty(len(h), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return x[at], order[at], inverse, np.diff(np.append(at, len(x)))


def member_index(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in ascending keys, whether it is there) of each value."""
    if not len(keys):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    return at, keys[at] == values


def row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The sum of values[first[i]:first[i+1]] for each row i."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... counts[0] of them, then those of starts[1], ..."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)
