"""Vectorised hashes of words and word shingles of UTF-8 text."""

from __future__ import annotations

import numpy as np

SHINGLE = 5
_BASE = 0x9E3779B97F4A7C15 | 1
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SPACE = bytes(32 if i in (32, 9, 10, 11, 12, 13) else i for i in range(256))
_LOWER = bytes(32 if i in (32, 9, 10, 11, 12, 13) else i + 32 if 65 <= i <= 90 else i for i in range(256))
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse, modulo 2^64."""
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[i] = np.multiply.accumulate(p)
    return _POWERS[0], _POWERS[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits of each 64-bit number spread over all of it."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def word_hashes(text: bytes, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word, in order."""
    b = np.frombuffer(text.translate(_LOWER if lower else _SPACE), np.uint8)
    if not len(b):
        return np.zeros(0, np.uint64)
    inside = np.empty(len(b) + 2, bool)
    inside[0] = inside[-1] = False
    np.not_equal(b, 32, out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    up, down = _powers(len(b))
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], out=sums[1:])
    return mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def shingle_set(text: bytes, lower: bool = True, n: int = SHINGLE) -> np.ndarray:
    """Distinct hashes (63 bits, ascending) of all runs of n words; of the whole sequence where it is shorter; none without words."""
    w = word_hashes(text, lower)
    if not len(w):
        return w
    size = min(n, len(w))
    count = len(w) - size + 1
    up, _ = _powers(n + 2)
    sums = np.full(count, np.uint64(size), np.uint64)
    for k in range(size):
        sums += w[k : k + count] * up[k + 1]
    return np.unique(mixed(sums) >> np.uint64(1))
