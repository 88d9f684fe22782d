"""Word hashing and packed shuffles of hashes.

A packed shuffle moves the hashes of many documents as a few sorted byte arrays per batch and bucket instead of one
row per hash. Inside a batch, a hash that many documents share is combined first, so what a bucket receives of one hash is
bounded by the number of batches, not by the number of documents that share it.
"""

from __future__ import annotations

import numpy as np
from xxhash import xxh64_intdigest

_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xC2B2AE3D27D4EB4F)
_ODD = (0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x2545F4914F6CDD1D, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def space_words(text: str | None, lower: bool = False) -> list[bytes]:
    """Words between ASCII white space, as UTF-8; with ``lower``, A-Z become a-z and nothing else changes."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def shingles(words: list[bytes], size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``size`` words; of fewer words, of the whole sequence."""
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = hashes(words)
    k = min(size, len(h))
    n = len(h) - k + 1
    s = np.full(n, k, dtype=np.uint64) * _B
    for i in range(k):
        s += h[i : n + i] * np.uint64(_ODD[i % 8] + 2 * (i // 8))
    return np.unique(mix(s))


def double(names: np.ndarray, length: int) -> np.ndarray:
    """Names of windows of twice ``length`` from the names of the windows of ``length`` at each start."""
    n = len(names) - length
    return mix(names[:n] * _A + mix(names[length : length + n] + _B)) if n > 0 else names[:0]


def window_names(h: np.ndarray, length: int) -> np.ndarray:
    """Names (64-bit hashes) of all windows of ``length`` words, from word hashes."""
    n = len(h) - length + 1
    if n <= 0:
        return h[:0]
    s = np.zeros(n, dtype=np.uint64)
    for i in range(length):
        s += h[i : n + i] * np.uint64(_ODD[i % 8] + 2 * (i // 8))
    return mix(s)


def bucket_of(names: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket from bits independent of the order of the names."""
    return (mix(names + _A) % np.uint64(buckets)).astype(np.int64)


def slices(values: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, start, end) of the runs of a sorted array."""
    if not len(values):
        return []
    cut = np.flatnonzero(values[1:] != values[:-1]) + 1
    starts = np.concatenate([[0], cut])
    ends = np.concatenate([cut, [len(values)]])
    return list(zip(values[starts].tolist(), starts.tolist(), ends.tolist(), strict=True))


class SpanHasher:
    """64-bit hashes of spans of byte arrays, from running sums; powers are kept for the longest array seen."""

    _BASE = 0xD6E8FEB86659FD93

    def __init__(self):
        self._pow = self._inv = np.empty(0, dtype=np.uint64)

    def of(self, b: np.ndarray):
        """A function of (starts, ends, kind): hashes of the spans of ``b``, different for each kind."""
        if len(b) >= len(self._pow):
            powers = lambda x: np.multiply.accumulate(np.array([1] + [x] * (2 * len(b)), dtype=np.uint64))
            self._pow, self._inv = powers(self._BASE), powers(pow(self._BASE, -1, 1 << 64))
        total = np.zeros(len(b) + 1, dtype=np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * self._pow[: len(b)], out=total[1:])
        return lambda start, end, kind: mix((total[end] - total[start]) * self._inv[start] + np.uint64(kind * int(_B) & (1 << 64) - 1))


def as_array(blob, kind) -> np.ndarray:
    return np.frombuffer(blob, dtype=kind)
