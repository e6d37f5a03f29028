"""Whole texts as ragged numpy arrays: words, lines and hashes without a Python loop per word.

All functions work on the UTF-8 bytes of a slice of an Arrow column. The six word separators
(0x20, 0x09-0x0D) are single bytes in UTF-8, so splitting bytes equals splitting characters.
Hashes are polynomials modulo 2**64 over random byte values, then mixed; they are the same on
every machine.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_RANDOM = np.random.Generator(np.random.PCG64(20240607))
BYTE = _RANDOM.integers(1, 2**64, 256, dtype=U64)
BASE = U64(0x9E3779B97F4A7C15)
STEP = U64(0xD1342543DE82EF95)
CHUNK = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (a bijection)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls and grown by doubling."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        have = np.ones(size, U64)
        have[1:] = U64(base)
        np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[:n]


_INVERSE = pow(int(BASE), -1, 1 << 64)


def slices(batch: pa.RecordBatch, column: str, limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about ``limit`` bytes of text (one row at least)."""
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64)
    cut = np.flatnonzero(np.diff(np.cumsum(size) // limit)) + 1
    at = 0
    for end in [*cut.tolist(), batch.num_rows]:
        if end > at:
            yield batch.slice(at, end - at)
        at = end


def give_back() -> None:
    """Return what is freed to the system: a worker process stays after its task, with all it once touched."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the C library at hand need not have it
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, giving back its memory when it has read its last batch."""

    @functools.wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows end to end and where each row starts; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, np.int64, len(col) + 1, col.offset * 8) if offs else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


class Words:
    """The words of each text: ``start``/``end`` in ``buf``, and ``first[i]:first[i+1]`` of text i."""

    def __init__(self, data: np.ndarray, offs: np.ndarray) -> None:
        n = len(offs) - 1
        self.buf = np.insert(data, offs[1:], 32) if n else data
        self.text_start = offs[:-1] + np.arange(n)
        gap = np.ones(len(self.buf) + 1, bool)
        gap[1:] = SPACE[self.buf]
        edge = np.flatnonzero(gap[1:] != gap[:-1])
        self.start, self.end = edge[0::2], edge[1::2]
        self.first = np.append(np.searchsorted(self.start, self.text_start), len(self.start))

    def hashes(self, lower: bool = True) -> np.ndarray:
        """A 64-bit hash of each word; A-Z lower-cased first if asked."""
        return span_hashes(LOWER[self.buf] if lower else self.buf, self.start, self.end)


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span."""
    total = np.zeros(len(buf) + 1, U64)
    np.cumsum(BYTE[buf] * powers(int(BASE), len(buf)), out=total[1:])
    return mix((total[end] - total[start]) * powers(_INVERSE, len(buf) + 1)[start])


def shingle_hashes(words: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles in order, and where each text's begin.

    A text of fewer than k words (one at least) has one shingle, its whole sequence.
    """
    h, first = words.hashes(), words.first
    count = np.diff(first)
    n = len(h)
    full = np.zeros(n, U64)
    m = n - k + 1
    if m > 0:
        for j in range(k):
            full[:m] = full[:m] * STEP + h[j : j + m]
    many = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    begin = np.concatenate([[0], np.cumsum(many)])
    at = np.arange(begin[-1]) - np.repeat(begin[:-1] - first[:-1], many)
    out = full[at] + U64(k)
    for i in np.flatnonzero((count > 0) & (count < k)):
        value = 0
        for x in h[first[i] : first[i + 1]].tolist():
            value = (value * int(STEP) + x) & 0xFFFFFFFFFFFFFFFF
        out[begin[i]] = U64((value + int(count[i])) & 0xFFFFFFFFFFFFFFFF)
    return mix(out), begin


def shingle_sets(col: pa.Array, k: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; empty without words."""
    h, begin = shingle_hashes(Words(*utf8(col)), k)
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist()):
        part = np.sort(h[a:b])
        yield part[np.append(True, part[1:] != part[:-1])] if b > a else part


def planes(x: np.ndarray) -> bytes:
    """The bytes of an integer array, plane by plane, so that equal high bytes compress."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes()


def unplanes(raw: bytes, dtype: type) -> np.ndarray:
    """The inverse of :func:`planes`."""
    wide = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(wide, -1).T).view(dtype).ravel()
