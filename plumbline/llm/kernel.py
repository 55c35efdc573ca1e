"""Vectorised text primitives that the Arrow UDFs of this package share.

Texts arrive as Arrow string arrays. They are handled in sub-batches of bounded
bytes (a longer text is a sub-batch of its own), each turned into one array of
code points with the start of every row, so that no Python loop runs per
character. A null text counts as an empty one.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

SUB_BATCH_BYTES = 1 << 19
N_CODES = 0x110000
_ODD = np.uint64(0x9E3779B97F4A7C15)


@cache
def _trim():
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Gives memory that is free within this process back to the system."""
    pa.default_memory_pool().release_unused()
    if _trim() is not None:
        _trim()(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def char_hashes() -> np.ndarray:
    """A 64-bit random value for each code point."""
    with np.errstate(over="ignore"):
        return mix64((np.arange(N_CODES, dtype=np.uint64) + np.uint64(1)) * _ODD)


def _table(of) -> np.ndarray:
    return np.fromiter((of(chr(c)) for c in range(N_CODES)), bool, N_CODES)


@cache
def is_space() -> np.ndarray:
    return _table(str.isspace)


@cache
def is_alpha() -> np.ndarray:
    return _table(str.isalpha)


@cache
def is_alnum() -> np.ndarray:
    return _table(str.isalnum)


@cache
def lower_codes() -> np.ndarray:
    """Lower case, for those code points where it is one code point."""
    out = np.arange(N_CODES, dtype=np.uint32)
    for c in range(0x1F000):
        low = chr(c).lower()
        if len(low) == 1:
            out[c] = ord(low)
    return out


def as_strings(arr) -> pa.Array:
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if not pa.types.is_large_string(arr.type):
        arr = arr.cast(pa.large_string())
    return arr.fill_null("") if arr.null_count else arr


def raw(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes and the n + 1 byte offsets of a large-string array."""
    n = len(arr)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = arr.buffers()
    off = np.frombuffer(offsets, np.int64)[arr.offset : arr.offset + n + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def sub_batches(arr, limit: int = SUB_BATCH_BYTES) -> Iterator[tuple[int, int, pa.Array]]:
    """Row ranges of at most `limit` bytes, or of one row, that cover the array."""
    arr = as_strings(arr)
    _, off = raw(arr)
    i, n = 0, len(arr)
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        yield i, j, arr.slice(i, j - i)
        i = j


def codepoints(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the rows in one array, and the n + 1 row starts in it."""
    data, off = raw(arr)
    lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    try:
        cp = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        return cp, lead[off]
    except UnicodeError:
        parts = [np.frombuffer(data[a:b].tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32) for a, b in zip(off[:-1], off[1:], strict=True)]
        return np.concatenate([*parts, np.zeros(0, np.uint32)]), np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)


_BASE = 0x2545F4914F6CDD1D
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers, modulo 2 ** 64, of an odd base and of its inverse."""
    if not _powers or len(_powers[0]) < n:
        size = (n + 0xFFFF) & ~0xFFFF
        _powers[:] = [_power_table(_BASE, size), _power_table(pow(_BASE, -1, 1 << 64), size)]
    return _powers[0][:n], _powers[1][:n]


def _power_table(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def slice_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hash of values[start:end] for every slice, from one prefix sum; values: uint64 hashes of the elements."""
    if not len(values):
        return np.zeros(len(starts), np.uint64)
    up, down = powers(len(values) + 1)
    with np.errstate(over="ignore"):
        prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * up[:-1], dtype=np.uint64)))
        return mix64((prefix[ends] - prefix[starts]) * down[starts])


def words(cp: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every run without white space; a run ends with its row."""
    inside = ~is_space()[cp]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = starts[:-1][starts[:-1] < len(cp)]
    first[edge] = inside[edge]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    return a, b, np.searchsorted(starts, a, side="right") - 1


def row_sums(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sum of values by row number; exact while sums stay below 2 ** 53."""
    return np.bincount(rows, weights=values, minlength=n) if len(rows) else np.zeros(n)
