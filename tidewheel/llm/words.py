"""Words and shingles of many texts at once, as 64-bit hashes in arrays.

A word is a longest run of bytes other than space and \\t \\n \\v \\f \\r. Its
hash is a polynomial over all its bytes, read off prefix sums, so no text is
split into objects; a shingle's hash combines those of its words in order.
Texts are worked on in groups of about GROUP bytes, small enough for a core's
cache; a longer text is a group by itself. Hashes are read block by block of
BLOCK bytes, so that what a long text needs beside its words is bounded.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

GROUP, BLOCK = 1 << 17, 1 << 20
#: Texts a group holds at most.
MOST_TEXTS = 1 << 15

_U = np.uint64
# The multipliers of a public 64-bit mixing function, and an odd base with its inverse.
_MIX1, _MIX2, _STEP = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), _U(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = (x ^ (x >> _U(30))) * _MIX1
    x = (x ^ (x >> _U(27))) * _MIX2
    return x ^ (x >> _U(31))


_SIGN = mix(np.arange(1, 257, dtype=_U) * _STEP)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = np.ones((2, 1), _U)


def powers(n: int) -> np.ndarray:
    """The first n powers of the base and of its inverse, n at most BLOCK + 1."""
    global _powers
    if _powers.shape[1] < n:
        size = min(1 << (n - 1).bit_length(), BLOCK + 1)
        with np.errstate(over="ignore"):
            _powers = np.stack([np.cumprod(np.concatenate([[_U(1)], np.full(size - 1, _U(b), _U)])) for b in (_BASE, _INVERSE)])
    return _powers


class Texts:
    """A group of texts: raw bytes, where each begins (offsets, one more than texts)."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.raw, self.offsets, self.n = raw, offsets, len(offsets) - 1
        self.blank = _SPACE[raw]
        filled = ~self.blank
        starts, ends = filled.copy(), filled.copy()
        starts[1:] &= self.blank[:-1]
        ends[:-1] &= self.blank[1:]
        inner = offsets[1:-1]
        inner = inner[(inner > 0) & (inner < len(raw))]
        starts[inner] = filled[inner]
        ends[inner - 1] = filled[inner - 1]
        self.word_starts, self.word_ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        self.doc = np.searchsorted(offsets, self.word_starts, "right") - 1

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A hash of the bytes of each span. Spans are sorted, disjoint and not empty."""
        out = np.zeros(len(starts), _U)
        for a in range(0, len(self.raw), BLOCK):
            part = self.raw[a : a + BLOCK]
            first, stop = np.searchsorted(ends, a, "right"), np.searchsorted(starts, a + len(part))
            if first == stop:
                continue
            up, down = powers(len(part) + 1)
            sums = np.empty(len(part) + 1, _U)
            sums[0] = 0
            np.cumsum(_SIGN[part] * up[: len(part)], out=sums[1:])
            s, e = np.maximum(starts[first:stop] - a, 0), np.minimum(ends[first:stop] - a, len(part))
            found = (sums[e] - sums[s]) * down[s]
            if starts[first] < a:  # what a span has before this block shifts the rest of it
                found[:1] *= _U(pow(_BASE, int(a - starts[first]), 1 << 64))
            out[first:stop] += found
        return mix(out)

    def words(self) -> np.ndarray:
        return self.hashes(self.word_starts, self.word_ends)

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """The sum of a flag of each byte over each text."""
        if self.n == 1:
            return np.array([np.count_nonzero(flags)])
        sums = np.concatenate([[0], np.cumsum(flags, dtype="i8")])
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]]


def shingles(words: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words inside a text, and the texts' numbers."""
    n = len(words) - k + 1
    if n <= 0:
        return words[:0], doc[:0]
    out = np.zeros(n, _U)
    for i in range(k):
        out = (out ^ words[i : i + n]) * _MIX1 + _STEP
        out ^= out >> _U(29)
    inside = doc[:n] == doc[k - 1 :]
    return mix(out[inside]), doc[:n][inside]


def hand_back() -> None:
    """Give memory that this worker has freed back to the system: a worker outlives its tasks, and libraries keep what they freed."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # there is no such call outside of glibc
        ctypes.CDLL(None).malloc_trim(0)


def in_groups(column: pa.Array) -> Iterator[tuple[int, Texts]]:
    """The texts of an Arrow column, nulls as empty ones, in groups; with the row each group begins at."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], "i8")[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, "u1") if data is not None else np.zeros(0, "u1")
    row = 0
    while row < len(column):
        stop = min(max(row + 1, int(np.searchsorted(offsets, offsets[row] + GROUP, "right")) - 1), row + MOST_TEXTS)
        yield row, Texts(raw[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row])
        row = stop
