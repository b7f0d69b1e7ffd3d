"""Vectorised text primitives for Arrow batches: words, word hashes, ragged arrays.

A batch is worked through in chunks of about CHUNK bytes of text, so memory does not depend on the
batch size; a single longer text makes one chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
_IS_WORD = np.ones(256, bool)
_IS_WORD[list(SPACES)] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash's base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(max(n, CHUNK + 4096), base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Chunk:
    """Consecutive texts of a batch: their bytes, and the offsets at which each begins."""

    def __init__(self, lo: int, hi: int, data: np.ndarray, at: np.ndarray):
        self.lo, self.hi, self.data, self.at = lo, hi, data, at

    def __len__(self) -> int:
        return self.hi - self.lo

    def text(self, i: int) -> bytes:
        return self.data[self.at[i] : self.at[i + 1]].tobytes()

    def words(self, lower: bool = False) -> Words:
        return Words(LOWER[self.data] if lower else self.data, self.at)


class Words:
    """Maximal runs of bytes outside SPACES; a word never crosses from one text to the next.

    start, end: byte offsets; first: for each text the index of its first word, then the number of
    words.
    """

    def __init__(self, data: np.ndarray, at: np.ndarray, kind: np.ndarray = _IS_WORD):
        self.data = data
        word = kind[data]
        before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
        before[1:], after[:-1] = word[:-1], word[1:]
        edge = at[(at > 0) & (at < len(data))]
        before[edge] = False
        after[edge - 1] = False
        self.start = np.flatnonzero(word & ~before)
        self.end = np.flatnonzero(word & ~after) + 1
        self.first = np.searchsorted(self.start, at)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.start, self.end)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of the bytes of each span."""
    up, down = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null counts as empty."""
    column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[Chunk]:
    """The texts of a column in chunks of about size bytes."""
    if not len(column):
        return
    data, at = strings(column)
    lo = 0
    while lo < len(at) - 1:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + size, "right")) - 1)
        yield Chunk(lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
        lo = hi


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices start[0] .. start[0]+length[0]-1, start[1] .. and so on."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(length)
    return np.arange(total) + np.repeat(start - (ends - length), length)


def windows(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words at each word, and whether the window lies within its text."""
    n = len(h)
    out = np.zeros(n, np.uint64)
    if n >= k:
        for j in range(k):
            out[: n - k + 1] = (out[: n - k + 1] * np.uint64(0xD6E8FEB86659FD93)) + h[j : n - k + 1 + j]
    ok = np.arange(n) + k <= np.repeat(first[1:], np.diff(first))
    return mix(out), ok
