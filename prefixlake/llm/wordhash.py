"""Hashes of words and word shingles of Arrow string arrays, in numpy.

Words are runs of bytes other than space and U+0009 to U+000D. Texts are taken in slices of a few megabytes, so memory
is bounded by the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE = 2 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_TABLE = np.random.Generator(np.random.PCG64(20)).integers(0, 1 << 64, 256, dtype=_U)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_WORD = np.ones(256, bool)
_WORD[[32, 9, 10, 11, 12, 13]] = False


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits with good avalanche."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


@lru_cache(maxsize=8)
def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, _U(base), _U)
    out[0] = 1
    return np.cumprod(out, dtype=_U)


def powers(n: int, base: int) -> np.ndarray:
    return _powers(64 if n <= 64 else max(SLICE + 2, 1 << (n - 1).bit_length()), base)[:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of the bytes of each span."""
    n = len(data)
    sums = np.zeros(n + 1, _U)
    np.cumsum(_TABLE[data] * powers(n, _BASE), out=sums[1:])
    inverse = powers(n + 1, pow(_BASE, -1, 1 << 64))
    return mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93))


def slices(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The first row, the bytes and the rows' offsets into them, of slices of ``texts`` of about SLICE bytes. Nulls are empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE, "right")) - 1)
        yield row, data[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row]
        row = last


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each row the number of the first of its words (one more entry at the end)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = _WORD[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    before[offsets] = False  # no word crosses from text to text
    edge = np.zeros(len(data) + 1, bool)
    edge[:-1] = inside
    starts = np.flatnonzero(edge[:-1] & ~before[:-1])
    after = edge.copy()
    after[offsets] = False
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def lower(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def shingle_sets(texts: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of ``texts``: its number and the sorted distinct hashes of its shingles of k words, A-Z lower-cased.

    Fewer words, but some, are one shingle; none, an empty set.
    """
    c = powers(k, 0xA24BAED4963EE407)
    for first, data, offsets in slices(texts):
        data = lower(data)
        starts, ends, begin = word_spans(data, offsets)
        w = span_hashes(data, starts, ends) if len(starts) else np.zeros(0, _U)
        n = len(w) - k + 1
        if n > 0:
            total = np.zeros(n, _U)
            for j in range(k):
                total += w[j : j + n] * c[j]
            whole = mixed(total)
        for r in range(len(offsets) - 1):
            a, b = begin[r], begin[r + 1]
            if b - a >= k:
                yield first + r, np.unique(whole[a : b - k + 1])
            elif b > a:
                yield first + r, mixed((w[a:b] * c[: b - a]).sum(keepdims=True, dtype=_U) + _U(b - a))
            else:
                yield first + r, np.zeros(0, _U)


_LETTER = np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = True
_LETTER[ord("A") : ord("Z") + 1] = True
_LETTER[0x80:] = True


def letters(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to letters: ASCII letters and all of UTF-8's longer forms but general punctuation (E2 80 xx)."""
    out = _LETTER[data]
    if len(data) > 2:
        at = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x80))
        for k in range(3):
            out[at + k] = False
    return out


def letter_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As word_spans, for runs of letters."""
    inside = letters(data)
    before, after = np.zeros(len(data) + 1, bool), np.zeros(len(data) + 1, bool)
    before[1:], after[:-1] = inside, inside
    before[offsets], after[offsets] = False, False
    starts, ends = np.flatnonzero(inside & ~before[:-1]), np.flatnonzero(inside & ~after[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)
