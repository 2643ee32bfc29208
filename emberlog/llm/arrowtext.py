"""Vectorised words, spans and hashes over Arrow string columns.

A span's hash is a polynomial over its bytes, taken from prefix sums, so a whole block of texts is hashed
without a Python loop over words. Texts are never cut: a block is a run of whole rows, and one row larger
than the block size is a block of its own.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 19

_rng = np.random.default_rng(0x5EED)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VALUES_2 = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32

#: ASCII letters and digits, and every byte of a non-ASCII character.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: All bytes but ASCII white space.
NONSPACE = np.ones(256, bool)
NONSPACE[[0x20, *range(0x09, 0x0E)]] = False

_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(which: str, n: int) -> np.ndarray:
    if len(_powers[which]) < n:
        size = 1 << max(10, (n - 1).bit_length())
        factors = np.full(size, _BASE if which == "up" else _INVERSE, np.uint64)
        factors[0] = 1
        _powers[which] = np.cumprod(factors, dtype=np.uint64)
    return _powers[which][:n]


def give_back() -> None:
    """Return freed memory to the system: workers live long, and the allocator would keep the largest batch's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def blocks(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of runs of rows of about ``most`` bytes."""
    data, offsets = strings(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = min(n, max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end
    give_back()


def spans(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the maximal runs of member bytes; no run crosses a row's edge."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    inside = member[data]
    edge = np.empty(len(data) + 1, bool)
    edge[0], edge[-1] = inside[0], inside[-1]
    np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    joined = cuts[inside[cuts] & inside[cuts - 1]]
    at = np.flatnonzero(edge)
    if len(joined):
        joined = np.unique(joined)
        at = np.sort(np.concatenate([at, joined, joined]))
    starts, ends = at[0::2], at[1::2]
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False, second: bool = False) -> np.ndarray:
    """64-bit hashes of the spans' bytes; fold takes A-Z as a-z; second gives an independent hash."""
    values = _VALUES_2 if second else _VALUES
    if fold:
        values = values[_FOLD]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * _power("up", len(data)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power("down", len(data) + 1)[starts] + (ends - starts).astype(np.uint64))


def row_bounds(rows: np.ndarray, n: int) -> np.ndarray:
    """Where each of n rows starts among the sorted row numbers, n + 1 places."""
    return np.searchsorted(rows, np.arange(n + 1))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Order-sensitive hashes of every k consecutive words (len - k + 1; empty where there are fewer)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * _BASE + words[i : i + n]
    return mix(out)
