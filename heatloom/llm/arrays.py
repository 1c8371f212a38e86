"""Vectorised text work on the buffers of Arrow string columns.

Texts of a batch lie end to end in one byte array, so words, windows and their hashes come from whole-array NumPy
operations. Batches are taken apart into chunks of bounded bytes (one longer text makes a chunk of its own).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2_000_000

U64 = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
SOLID = ~_SPACE
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32  # A-Z only

_POWERS: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def seeded(n: int, seed: int) -> np.ndarray:
    """``n`` fixed odd 64-bit constants."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * U64(0x9E3779B97F4A7C15) + U64(seed)) | U64(1)


BYTE_VALUES = seeded(256, 11)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; the longest table so far is kept."""
    table = _POWERS.get(base)
    if table is None or len(table) < n:
        size = max(n, 1024)
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        table = np.multiply.accumulate(steps)
        if size <= 4 * CHUNK_BYTES:
            _POWERS[base] = table
    return table[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets.astype(np.int64)


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) for runs of rows of about ``limit`` bytes."""
    if not len(column):
        return
    raw, offsets = buffers(column)
    lo, rows = 0, len(offsets) - 1
    while lo < rows:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(rows, max(hi, lo + 1))
        yield lo, hi, raw[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each text the number of the first word at or after its start."""
    solid = SOLID[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    first[heads] = solid[heads]
    tails = offsets[1:][offsets[1:] > 0] - 1
    last[tails] = solid[tails]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def slice_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """A 64-bit hash of each slice; slices are in order, do not overlap and are not empty."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    cuts = np.zeros(len(starts), np.int64)
    np.cumsum(lengths[:-1], out=cuts[1:])
    inside = np.arange(int(lengths.sum())) - np.repeat(cuts, lengths)
    values = BYTE_VALUES[data[inside + np.repeat(starts, lengths)]] * powers(base, int(lengths.max()))[inside]
    return mix(np.add.reduceat(values, cuts) + lengths.astype(np.uint64) * U64(0xD6E8FEB86659FD93))


def window_hashes(h: np.ndarray, n: int, base: int = 0xD1342543DE82EF95) -> np.ndarray:
    """Hash of each run of ``n`` consecutive values (``len(h) - n + 1`` of them)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    count = len(h) - n + 1
    if n <= 8:
        p = powers(base, n)
        total = h[:count].copy()
        for j in range(1, n):
            total += h[j:j + count] * p[j]
        return mix(total)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers(base, len(h)), out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * powers(inverse(base), count))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
