"""Vectorised helpers that run inside Spark tasks on Arrow batches of text.

A word is a maximal run of bytes other than space and 0x09-0x0D; in UTF-8 no other character holds such a byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of an unsigned 64-bit array."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTES = mix(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(1 << 16, 1 << int(n).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        up, down = np.full(size, _BASE, U64), np.full(size, _INVERSE, U64)
        up[0] = down[0] = 1
        _POWERS[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS[size]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(offsets: np.ndarray, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about `size` bytes each (one row at least), so that working arrays stay small."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


@dataclass
class Words:
    """The words of a block of rows: byte start and end, row, and a 64-bit hash of each; `first[r]` is row r's first word."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)


def prefix_hash(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running polynomial sums of hashed items, and the powers that bring a difference of them to a common place."""
    up, down = _powers(len(values) + 1)
    total = np.zeros(len(values) + 1, U64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return total, down


def span_hash(total: np.ndarray, down: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(U64) * U64(0xA0761D6478BD642F))


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    white = _WHITE[data]
    black = ~white
    n = len(data)
    opens = black.copy()
    opens[1:] &= white[:-1]
    edge = offsets[1:-1]
    edge = edge[edge < n]
    opens[edge] = black[edge]
    closes = black.copy()
    closes[:-1] &= white[1:]
    last = edge[edge > 0] - 1
    closes[last] = black[last]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    first = np.searchsorted(start, offsets)
    total, down = prefix_hash(_BYTES[data])
    return Words(start, end, np.repeat(np.arange(len(offsets) - 1), np.diff(first)), span_hash(total, down, start, end), first)


def windows(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts (word numbers) of all k-word windows inside rows, and their hashes."""
    n = len(w.hash) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    at = np.flatnonzero(w.row[:n] == w.row[k - 1 :])
    h = w.hash[:n].copy()
    for j in range(1, k):
        h *= U64(_BASE)
        h += w.hash[j : n + j]
    return at, mix(h[at] + U64(k))


def covered(starts: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of n words lie in a window of k words that begins at one of `starts`."""
    edge = np.zeros(n + k + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + k, -1)
    return np.cumsum(edge)[:n] > 0


def lower_ascii(data: np.ndarray) -> np.ndarray:
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    return out
