"""Vectorised word and shingle hashing over Arrow string columns.

Words are ``[^\\x20\\x09-\\x0D]+`` over the UTF-8 bytes, A-Z lower-cased where asked. A batch is
walked in runs of rows of about a quarter of a megabyte, so memory follows the run or the longest text and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

RUN_BYTES = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
_FACTORS = tuple(np.uint64(x | 1) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3))

WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@cache
def _letters(fold: bool) -> np.ndarray:
    byte = np.arange(256, dtype=np.uint64)
    if fold:
        byte[65:91] += np.uint64(32)
    return mix(byte + np.uint64(0x1234567))


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, for exponents below ``n``."""
    if len(_POWERS[0]) < n:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        size = 1 << (n - 1).bit_length()
        for k, factor in enumerate((_BASE, inverse)):
            out, step = np.ones(size, np.uint64), 1
            unit = int(factor)
            while step < size:
                out[step : 2 * step] = out[:step] * np.uint64(unit)
                unit = unit * unit & 0xFFFFFFFFFFFFFFFF
                step *= 2
            _POWERS[k] = out
    return _POWERS[0], _POWERS[1]


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes and the row offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def runs(offsets: np.ndarray, limit: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes, one row at least."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


class Words(NamedTuple):
    """Words of a run of rows: hash, row within the run, first byte and end within the run's bytes; bounds: a row's first word."""

    hash: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray


def words(data: np.ndarray, offsets: np.ndarray, first: int, last: int, fold: bool = True, hashed: bool = True, breaks: np.ndarray = WHITE) -> Words:
    """Words of rows ``first`` to ``last``; ``breaks``: the bytes that part them."""
    lo = int(offsets[first])
    b = data[lo : int(offsets[last])]
    at = offsets[first : last + 1] - lo
    n, rows = len(b), last - first
    if not n:
        empty = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), empty, empty, empty, np.zeros(rows + 1, np.int64))
    white = breaks[b]
    edge = np.ones(n + 1, bool)
    edge[1:n] = white[:-1]
    edge[at[:-1]] = True
    start = np.flatnonzero(~white & edge[:n])
    edge[:n] = True
    edge[: n - 1] = white[1:]
    edge[at[1:][at[1:] > 0] - 1] = True
    end = np.flatnonzero(~white & edge[:n]) + 1
    bounds = np.searchsorted(start, at)
    row = np.repeat(np.arange(rows), np.diff(bounds))
    if not hashed:
        return Words(np.zeros(0, np.uint64), row, start, end, bounds)
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_letters(fold)[b] * up[:n], out=sums[1:])
    value = (sums[end] - sums[start]) * down[start]
    return Words(mix(value + (end - start).astype(np.uint64)), row, start, end, bounds)


def shingles(found: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words within a row, and each row's first (bounds). A shorter row is one shingle as a whole."""
    h, bounds = found.hash, found.bounds
    counts = np.diff(bounds)
    out_counts = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    out = np.zeros(len(out_counts) + 1, np.int64)
    np.cumsum(out_counts, out=out[1:])
    if not len(h):
        return np.zeros(0, np.uint64), out
    rolling = np.full(max(len(h) - size + 1, 0), np.uint64(size), np.uint64)
    for k in range(size):
        rolling += h[k : len(h) - size + 1 + k] * _FACTORS[k % 5] * np.uint64(2 * (k // 5) + 1) if len(rolling) else np.zeros(0, np.uint64)
    long = counts >= size
    keep = np.zeros(len(h) + 1, np.int64)
    np.add.at(keep, bounds[:-1][long], 1)
    np.add.at(keep, bounds[1:][long] - size + 1, -1)
    inside = np.cumsum(keep[:-1]).astype(bool)
    value = np.zeros(out[-1], np.uint64)
    place = np.repeat(long, out_counts)
    value[place] = rolling[inside[: len(rolling)]] if len(rolling) else value[place]
    for r in np.flatnonzero((counts > 0) & ~long):
        part = h[bounds[r] : bounds[r + 1]]
        total = np.uint64(len(part))
        with np.errstate(over="ignore"):
            for k, x in enumerate(part):
                total = total + x * _FACTORS[k % 5]
        value[out[r]] = total
    return mix(value), out
