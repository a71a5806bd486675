"""Hashes of words, computed for all words of a batch of texts at once."""

from __future__ import annotations

import numpy as np

from .common import text_buffer, word_spans

#: Bytes of text that are worked on at once.
CHUNK = 1 << 20
#: An odd base and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: ASCII punctuation, taken off the ends of words.
MARK = np.zeros(256, bool)
MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True

_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**k and INVERSE**k for k up to n."""
    if len(_POWERS[0]) <= n:
        size = max(n + 1, 1 << 16)
        for k, base in enumerate((BASE, INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0], _POWERS[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums from which the hash of any slice follows."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def slice_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes from start to end; equal bytes have equal hashes in every batch."""
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def pieces(column, limit: int = CHUNK):
    """(first row, last row + 1, bytes, offsets) of an Arrow text column, at most about `limit` bytes at once."""
    data, offsets = text_buffer(column)
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def trimmed(data: np.ndarray, start: np.ndarray, end: np.ndarray, most: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Word spans without up to `most` marks at either end; words of marks alone stay as they are."""
    s, e = start.copy(), end.copy()
    for _ in range(most):
        s += MARK[data[s]] & (e - s > 1)
        e -= MARK[data[e - 1]] & (e - s > 1)
    bare = MARK[data[s]]
    return np.where(bare, start, s), np.where(bare, end, e)


def words_of(data: np.ndarray, offsets: np.ndarray):
    """Start, end and row of the words of a piece."""
    return word_spans(data, offsets)
