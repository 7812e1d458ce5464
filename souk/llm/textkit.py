"""Vectorised text primitives over Arrow string buffers (no per-character Python)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply / xor-shift), so that low and high bits are both usable."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def byte_table(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U) * U(_BASE) + U(seed))


def strings(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return off - off[0], raw[off[0] : off[-1]]


def portions(offsets: np.ndarray, most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of about ``most`` bytes each, so that temporaries stay small."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


@lru_cache(maxsize=4)
def _powers(inverse: bool, size: int) -> np.ndarray:
    p = np.full(size, _INVERSE if inverse else _BASE, U)
    p[0] = 1
    return np.multiply.accumulate(p)


def _ladder(inverse: bool, n: int) -> np.ndarray:
    return _powers(inverse, 1 << max(12, int(n).bit_length()))[:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """64-bit polynomial hashes of the spans, from one prefix sum; equal bytes hash alike anywhere."""
    if not len(starts):
        return np.zeros(0, U)
    c = np.zeros(len(data) + 1, U)
    np.cumsum(byte_table(seed)[data] * _ladder(True, len(data)), out=c[1:])
    h = (c[ends] - c[starts]) * _ladder(False, len(data) + 1)[starts]
    return mix(h + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


_WORD = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])


def words(offsets: np.ndarray, data: np.ndarray, member: np.ndarray = _WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each row) of maximal runs of member bytes; rows don't merge."""
    inside = member[data]
    n = len(data)
    begin, end = inside.copy(), inside.copy()
    if n:
        begin[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        cuts = offsets[(offsets > 0) & (offsets < n)]
        begin[cuts] = inside[cuts]
        end[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Per row: the sorted distinct hashes of its runs of ``width`` words, lower-cased, punctuation apart.

    A row of fewer words than ``width`` has one shingle of them all; one without words has none.
    """
    offsets, data = strings(pc.utf8_lower(column))
    for i, j in portions(offsets):
        off = offsets[i : j + 1] - offsets[i]
        part = data[offsets[i] : offsets[j]]
        starts, ends, first = words(off, part)
        h = span_hashes(part, starts, ends, 11)
        n = max(0, len(h) - width + 1)
        runs = np.zeros(n, U)
        for k in range(width):
            runs = runs * U(_BASE) + h[k : k + n]
        runs = mix(runs)
        for r in range(j - i):
            a, b = int(first[r]), int(first[r + 1])
            if b - a >= width:
                yield np.unique(runs[a : b - width + 1])
            elif b > a:
                short = U(b - a)
                with np.errstate(over="ignore"):
                    for x in h[a:b]:
                        short = short * U(_BASE) + x
                yield mix(np.array([short], U))
            else:
                yield np.zeros(0, U)


def lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    lengths = np.fromiter((len(p) for p in parts), np.int64, len(parts))
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(flat, kind))
