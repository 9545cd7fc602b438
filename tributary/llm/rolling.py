"""Rolling fingerprints of fixed-length byte strings and content-chosen anchors, by numpy.

A fingerprint of bytes s[p : p + k] is a polynomial sum over 64-bit values of the bytes, modulo 2**64, taken from
running sums; two bases give two independent ones.
"""

from __future__ import annotations

import numpy as np

from .common import worker_cache

INDEX_BITS = 20
MOST = (1 << INDEX_BITS) - 1
_INDEX = np.uint64(MOST)
_MASK = (1 << 64) - 1


def _mix(x: int) -> int:
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & _MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & _MASK
    return x ^ x >> 31


class Base:
    """Values of the bytes and powers of an odd base and of its inverse."""

    def __init__(self, seed: int):
        self.value = np.array([_mix(seed * 1_000_003 + k + 1) for k in range(256)], np.uint64)
        base = _mix(seed) | 1
        self.power = self._powers(base)
        self.inverse = self._powers(pow(base, -1, 1 << 64))

    @staticmethod
    def _powers(base: int) -> np.ndarray:
        out = np.ones(MOST + 1, np.uint64)
        n = 1
        while n < len(out):
            m = min(n, len(out) - n)
            out[n : n + m] = out[:m] * np.uint64(pow(base, n, 1 << 64))
            n += m
        return out

    def sums(self, data: np.ndarray) -> np.ndarray:
        """Running sums over uint8 data of at most MOST bytes, with a leading zero."""
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.value[data] * self.power[: len(data)], out=out[1:])
        return out

    def prints(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        x = (sums[end] - sums[start]) * self.inverse[start]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return x ^ x >> np.uint64(29)

    def rolling(self, sums: np.ndarray, k: int) -> np.ndarray:
        """Fingerprints of all strings of length k."""
        n = len(sums) - k
        x = (sums[k:] - sums[:n]) * self.inverse[:n]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
        return x


def base(seed: int) -> Base:
    bases = worker_cache("rolling", dict)
    if seed not in bases:
        bases[seed] = Base(seed)
    return bases[seed]


def anchors(prints: np.ndarray, width: int) -> np.ndarray:
    """For each window of width consecutive fingerprints, where its smallest stands (the first among equals)."""
    n = len(prints) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    packed = (prints & ~_INDEX) | np.arange(len(prints), dtype=np.uint64)
    rows = -(-len(packed) // width)
    grid = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    grid[: len(packed)] = packed
    grid = grid.reshape(rows, width)
    left = np.minimum.accumulate(grid, axis=1).reshape(-1)
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return (np.minimum(right[:n], left[width - 1 : width - 1 + n]) & _INDEX).astype(np.int64)
