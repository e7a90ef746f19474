"""Vectorised word and shingle hashing over Arrow string batches.

Words are runs of bytes other than ASCII white space.  All functions work on the
UTF-8 bytes of many texts at once and keep to slices of a bounded size, a single
longer text apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SHINGLE = 5
SLICE_BYTES = 1 << 21

_space = np.zeros(256, bool)
_space[[0x20, *range(0x09, 0x0E)]] = True
_value = np.random.default_rng(20240101).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_U = np.uint64


def fmix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; every input bit reaches every output bit."""
    x = x ^ (x >> _U(33))
    x *= _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes each."""
    lengths = np.asarray(pc.binary_length(column).fill_null(0))
    ends = np.cumsum(lengths)
    low, n = 0, len(column)
    while low < n:
        start = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, start + size, "right")))
        yield low, min(high, n)
        low = min(high, n)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; null texts have no bytes."""
    column = column.fill_null("").cast(pa.large_string())
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """Start, end, hash and row of every word of a slice of texts."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        solid = ~_space[raw]
        first = solid.copy()
        first[1:] &= ~solid[:-1]
        starts_of_rows = offsets[:-1][np.diff(offsets) > 0]
        first[starts_of_rows] = solid[starts_of_rows]
        last = solid.copy()
        last[:-1] &= ~solid[1:]
        ends_of_rows = offsets[1:][np.diff(offsets) > 0] - 1
        last[ends_of_rows] = solid[ends_of_rows]
        self.start, self.end = np.nonzero(first)[0], np.nonzero(last)[0] + 1
        #: words before each row's first and after its last
        self.bounds = np.searchsorted(self.start, offsets)
        self.raw = raw

    def hashes(self) -> np.ndarray:
        n = len(self.raw)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_value[self.raw] * _powers(_BASE, n), out=sums[1:])
        return fmix((sums[self.end] - sums[self.start]) * _powers(_INVERSE, n)[self.start] if n else sums[:0])


def shingle_hashes(hashes: np.ndarray, bounds: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words, row after row, and each row's bounds in them.

    A text of fewer words, but at least one, has one shingle of all its words.
    """
    counts = np.diff(bounds)
    n = len(hashes)
    padded = np.concatenate([hashes, np.zeros(k, np.uint64)])
    rolled = np.zeros(n, np.uint64)
    left = np.repeat(bounds[1:], counts) - np.arange(n)  # words from here to the row's end
    for j in range(k):
        rolled = rolled * _U(0x9DDFEA08EB382D69) + np.where(left > j, padded[j : j + n], _U(0))
        rolled ^= rolled >> _U(31)
    keep = left >= k
    short = bounds[:-1][(counts > 0) & (counts < k)]
    keep[short] = True
    return fmix(rolled[keep]), np.concatenate([[0], np.cumsum(keep)])[bounds]


def texts_shingles(column: pa.Array, k: int = SHINGLE) -> Iterator[np.ndarray]:
    """Distinct shingle hashes of each text, sorted."""
    for low, high in slices(column):
        words = Words(*buffers(column.slice(low, high - low)))
        found, bounds = shingle_hashes(words.hashes(), words.bounds, k)
        for i in range(high - low):
            yield np.unique(found[bounds[i] : bounds[i + 1]])
