"""Vectorised words and hashes over batches of texts, for use inside tasks.

A batch of texts is one byte buffer with row bounds, so that a million words cost a few
numpy passes instead of a Python loop. All results depend on the texts alone, never on
how rows are batched. Nulls are empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer single text is handled alone and whole.
CHUNK_BYTES = 1 << 18

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every bit depends on every bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit multipliers that depend on the seed alone."""
    return mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + mix(np.array([seed], _U))) | _U(1)


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0xD6E8FEB86659FD93))
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, _U)
    have, factor = 1, base
    while have < n:  # doubling: powers[have:2*have] = powers[:have] * base**have
        take = min(have, n - have)
        out[have:have + take] = out[:take] * _U(factor)
        factor = factor * factor % (1 << 64)
        have += take
    return out


_POWER = _powers(_BASE, CHUNK_BYTES + 1)
_POWER_INVERSE = _powers(_INVERSE, CHUNK_BYTES + 1)


def byte_class(*members: int | range) -> np.ndarray:
    """A table of 256 truth values, true at the given bytes."""
    out = np.zeros(256, bool)
    for m in members:
        out[list(m) if isinstance(m, range) else m] = True
    return out


#: ASCII white space separates words.
SPACE = byte_class(0x20, range(0x09, 0x0E))
#: All but ASCII letters, digits and bytes of other characters separates words.
NOT_ALNUM = ~byte_class(range(0x30, 0x3A), range(0x41, 0x5B), range(0x61, 0x7B), range(0x80, 0x100))


class Texts(NamedTuple):
    """Whole texts of some rows: their bytes, and where each row begins (n + 1 bounds)."""

    data: np.ndarray
    bounds: np.ndarray
    first: int  # the first row's place in its batch

    @property
    def n(self) -> int:
        return len(self.bounds) - 1


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Texts]:
    """The column's texts in slices of at most ``limit`` bytes, or of one longer text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset:column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    low = 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(bounds, bounds[low] + limit, "right")) - 1)
        yield Texts(data[bounds[low]:bounds[high]], bounds[low:high + 1] - bounds[low], low)
        low = high


class Words(NamedTuple):
    start: np.ndarray  # byte offsets in the slice
    end: np.ndarray
    row: np.ndarray  # row in the slice
    hash: np.ndarray  # 64 bits of the word's bytes

    def counts(self, n: int) -> np.ndarray:
        return np.bincount(self.row, minlength=n)


def words(texts: Texts, separators: np.ndarray) -> Words:
    """Maximal runs of bytes that don't separate words, in order; runs end with their row."""
    data, bounds = texts.data, texts.bounds
    size = len(data)
    if not size:
        none = np.zeros(0, np.int64)
        return Words(none, none, none, np.zeros(0, _U))
    inside = ~separators[data]
    edge = np.empty(size + 1, bool)
    edge[0], edge[size] = inside[0], inside[size - 1]
    np.not_equal(inside[1:], inside[:-1], out=edge[1:size])
    heads = bounds[1:-1]
    heads = np.unique(heads[(heads > 0) & (heads < size)])
    joined = heads[inside[heads] & inside[heads - 1]]  # a word that meets the next row's first
    at = np.flatnonzero(edge)
    if len(joined):
        at = np.sort(np.concatenate([at, joined, joined]), kind="stable")
    start, end = at[0::2], at[1::2]
    power, inverse = _POWER, _POWER_INVERSE
    if size >= len(power):
        power, inverse = _powers(_BASE, size + 1), _powers(_INVERSE, size + 1)
    total = np.zeros(size + 1, _U)
    np.cumsum(_BYTE[data] * power[:size], out=total[1:])
    hashed = mix((total[end] - total[start]) * inverse[start] + (end - start).astype(_U))
    row = np.repeat(np.arange(texts.n), np.diff(np.searchsorted(start, bounds)))
    return Words(start, end, row, hashed)


def windows(values: np.ndarray, row: np.ndarray, width: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``width`` values within a row, and the index of its first value."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    factors = constants(width, seed)
    total = values[:n] * factors[0]
    for k in range(1, width):
        total += values[k:k + n] * factors[k]
    at = np.flatnonzero(row[:n] == row[width - 1:])
    return mix(total[at]), at


def shingles(w: Words, n_rows: int, width: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word n-grams with repeats, by row, and n + 1 bounds.

    A text of fewer than ``width`` words, but one at least, has one n-gram: all its words.
    """
    hashed, at = windows(w.hash, w.row, width, seed)
    row = w.row[at]
    count = w.counts(n_rows)
    first = np.concatenate([[0], np.cumsum(count)])
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        factors = constants(width, seed)
        total = np.zeros(len(short), _U)
        for k in range(width):
            has = count[short] > k
            total[has] += w.hash[first[short[has]] + k] * factors[k]
        hashed = np.concatenate([hashed, mix(total + count[short].astype(_U))])
        row = np.concatenate([row, short])
        order = np.argsort(row, kind="stable")
        hashed, row = hashed[order], row[order]
    return hashed, np.searchsorted(row, np.arange(n_rows + 1))
