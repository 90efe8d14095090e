"""Words of Arrow text columns as numpy arrays of byte positions and 64-bit hashes.

All word patterns here are classes of ASCII bytes, and every byte of a longer UTF-8 character belongs to words, so
words are found on the bytes without decoding.  Work goes in pieces of bounded size; a very long text is cut between
words, so that memory follows the number of its words, not the number of bytes times eight.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_R = int(_rng.integers(0, 1 << 63, dtype=np.uint64)) * 2 + 1
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_STEP = np.uint64(0x9E3779B97F4A7C15)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after lower-casing A-Z: digits, ASCII letters and all else beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True

#: ``[^\x20\x09-\x0D]``: everything but ASCII white space.
NONBLANK = np.ones(256, bool)
NONBLANK[[32, *range(9, 14)]] = False


class Words(NamedTuple):
    first: int  # index of the first text in the column
    counts: np.ndarray  # words of each text
    doc: np.ndarray  # text of each word, counted from ``first``
    start: np.ndarray  # byte positions in ``data``
    end: np.ndarray
    hash: np.ndarray
    data: np.ndarray
    bounds: np.ndarray  # byte positions of the texts in ``data``


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * _M1
    h = h ^ (h >> np.uint64(33))
    h = h * _M2
    return h ^ (h >> np.uint64(33))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data, offsets


class _Powers:
    """Powers of the hash's base and of its inverse, grown on demand."""

    up = down = np.zeros(0, np.uint64)

    @classmethod
    def get(cls, n: int):
        if n > len(cls.up):
            size = max(n, PIECE + (PIECE >> 2))
            with np.errstate(over="ignore"):
                cls.up = np.multiply.accumulate(np.full(size, _R, np.uint64))
                cls.down = np.multiply.accumulate(np.full(size, pow(_R, -1, 1 << 64), np.uint64))
        return cls.up, cls.down


def _scan(data: np.ndarray, bounds: np.ndarray, table: np.ndarray, values: np.ndarray):
    """Starts, ends and hashes of the words of one piece; ``bounds`` are text limits inside it."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    word = table[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = word[:-1]
    before[bounds[bounds < n]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = word[1:]
    after[bounds[bounds > 0] - 1] = False
    start, end = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    up, down = _Powers.get(n)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    v = values[data]
    v *= up[:n]
    np.cumsum(v, out=sums[1:])
    return start, end, mix((sums[end] - sums[start]) * down[start])


def words(column: pa.Array, table: np.ndarray = ALNUM, lower: bool = True) -> Iterator[Words]:
    """The words of every text, in groups of consecutive texts of about ``PIECE`` bytes."""
    data, offsets = text_bytes(column)
    values = _BYTE[LOWER] if lower else _BYTE
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + PIECE, "right")) - 1)
        lo, hi = int(offsets[i]), int(offsets[j])
        part, bounds = data[lo:hi], offsets[i : j + 1] - lo
        if hi - lo <= PIECE:
            start, end, hashed = _scan(part, bounds, table, values)
        else:  # one very long text
            found, a = [], 0
            while a < hi - lo:
                b = min(a + PIECE, hi - lo)
                while b < hi - lo and table[part[b - 1]] and table[part[b]]:
                    stops = np.flatnonzero(~table[part[b : b + PIECE]])
                    b = b + int(stops[0]) if len(stops) else min(b + PIECE, hi - lo)
                s, e, h = _scan(part[a:b], np.zeros(0, np.int64), table, values)
                found.append((s + a, e + a, h))
                a = b
            start, end, hashed = (np.concatenate(x) for x in zip(*found))
        upto = np.searchsorted(start, bounds)
        counts = np.diff(upto)
        yield Words(i, counts, np.repeat(np.arange(j - i, dtype=np.int32), counts), start, end, hashed, part, bounds)
        i = j


def grams(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of the k words from each word on, and whether they lie in one text."""
    n = len(w.hash)
    if n < k:
        return np.zeros(n, np.uint64), np.zeros(n, bool)
    size = n - k + 1
    h = np.full(size, k, np.uint64)
    for j in range(k):
        h = h * _STEP + w.hash[j : j + size]
    out, ok = np.zeros(n, np.uint64), np.zeros(n, bool)
    out[:size], ok[:size] = mix(h), w.doc[:size] == w.doc[k - 1 :]
    return out, ok


def spread(h: np.ndarray, seed: int) -> np.ndarray:
    """Another hash of the same values."""
    return mix(h ^ np.uint64((seed * 0xD1B54A32D192ED03 + 0x8CB92BA72F3D8DD7) & 0xFFFFFFFFFFFFFFFF))
