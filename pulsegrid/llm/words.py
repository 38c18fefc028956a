"""Words of a whole Arrow column at once, as numpy arrays.

The bytes of a column lie in one buffer, so word boundaries, word hashes and
hashes of word shingles are array operations over all rows of a batch; there is
no Python object per word. A word's hash is a polynomial of its bytes modulo
2^64 with random coefficients per byte value, mixed with its length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes that are hashed at a time; a longer word is one piece.
PIECE = 1 << 19
_MIX, _STEP = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x9E6C63D0676A9A99
_BYTES = np.arange(256, dtype=np.uint8)
#: A-Z as a-z, all other bytes as they are.
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
#: Bytes of words of the contracts that split at space and U+0009 to U+000D.
UNSPACED = ~((_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D)))
#: Bytes of words of ASCII letters and digits and of all beyond ASCII.
LETTERS = (_BYTES >= 0x80) | ((LOWER >= 0x30) & (LOWER <= 0x39)) | ((LOWER >= 0x61) & (LOWER <= 0x7A))
_VALUES = np.random.default_rng(42).integers(0, 1 << 64, 256, np.uint64)[LOWER]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _MIX
    return h ^ (h >> np.uint64(29))


def ramp(counts: np.ndarray) -> np.ndarray:
    """0, 1, .. of every count in turn."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the len + 1 bounds of its rows;
    nulls are empty."""
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    _, at, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(at, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return held[bounds[0] : bounds[-1]], bounds - bounds[0]


def located(data: np.ndarray, bounds: np.ndarray, inside: np.ndarray = UNSPACED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, first): where the words of all rows lie in the buffer, and
    the number of the first word of each row, with the total at the end."""
    held = inside[data]
    before, after = np.zeros(len(held), bool), np.zeros(len(held), bool)
    before[1:], after[:-1] = held[:-1], held[1:]
    filled = bounds[1:] > bounds[:-1]
    before[bounds[:-1][filled]] = False
    after[bounds[1:][filled] - 1] = False
    start = np.flatnonzero(held & ~before)
    return start, np.flatnonzero(held & ~after) + 1 - start, np.searchsorted(start, bounds)


def pieces(length: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of words of about PIECE bytes."""
    ends = np.cumsum(length)
    cuts = np.unique(np.searchsorted(ends, np.arange(PIECE, ends[-1] if len(ends) else 0, PIECE)) + 1).tolist()
    cuts = [0, *[c for c in cuts if 0 < c < len(length)], len(length)]
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if b > a]


def word_hashes(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words, A-Z taken as a-z."""
    out = np.empty(len(start), np.uint64)
    with np.errstate(over="ignore"):
        powers = np.full(int(length.max(initial=1)) + 1, _BASE, np.uint64)
        powers[0] = 1
        powers = np.cumprod(powers)
        for i, j in pieces(length):
            n = length[i:j]
            pos = ramp(n)
            value = _VALUES[data[np.repeat(start[i:j], n) + pos]] * powers[pos]
            out[i:j] = np.add.reduceat(value, np.cumsum(n) - n)
        return mixed(out + length.astype(np.uint64) * _STEP)


def shingles(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(h, bounds): hashes of the word ``k``-shingles of every row, in order, and
    the rows' bounds in them. A row of fewer words is one shingle, a row of none
    has none."""
    n = np.diff(first)
    full = np.maximum(n - k + 1, 0)
    bounds = np.concatenate([[0], np.cumsum(np.where(n < k, np.minimum(n, 1), full))])
    out = np.empty(bounds[-1], np.uint64)
    with np.errstate(over="ignore"):

        def hashed(at: np.ndarray, size: int) -> np.ndarray:
            h = np.full(len(at), size, np.uint64)
            for d in range(size):
                h = mixed((h + words[at + d]) * _STEP)
            return h

        step = ramp(full)
        out[np.repeat(bounds[:-1], full) + step] = hashed(np.repeat(first[:-1], full) + step, k)
        for size in range(1, k):
            rows = np.flatnonzero(n == size)
            out[bounds[:-1][rows]] = hashed(first[:-1][rows], size)
    return out, bounds


def distinct(h: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    h = np.sort(h)
    return h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) else h


def shingled(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """:func:`shingles` of a string column."""
    data, bounds = buffer_of(column)
    start, length, first = located(data, bounds)
    return shingles(word_hashes(data, start, length), first, k)
