"""64-bit hashes of byte ranges and of neighbouring symbols, for whole numpy arrays at once."""

from __future__ import annotations

import numpy as np

_BASE = 0xD1342543DE82EF95
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def combined(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Hash of two neighbours from the hash of each."""
    return mixed((x * np.uint64(0x9E3779B97F4A7C15)) ^ (y + np.uint64(0xC2B2AE3D27D4EB4F)))


def powers(n: int) -> list[np.ndarray]:
    """At least ``n`` powers of an odd number, and of its inverse, modulo 2**64."""
    if len(_POWERS[0]) < n:
        for k, one in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            values = np.full(n + n // 4, one, np.uint64)
            values[0] = 1
            _POWERS[k] = np.cumprod(values)
    return _POWERS


class Ranges:
    """Hashes of any ranges of ``data`` (bytes): differences of running sums, brought back to the range's begin."""

    def __init__(self, data: np.ndarray, seed: int):
        numbers = np.arange(seed * 256 + 1, seed * 256 + 257, dtype=np.uint64)
        table = mixed(mixed(numbers * np.uint64(0x9E3779B97F4A7C15)))
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.multiply(table[data], up[: len(data)], out=self.sums[1:])
        np.cumsum(self.sums, out=self.sums)

    def hashes(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[begin]) * self.down[begin])


def sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """Minimum or maximum of each ``width`` neighbours."""
    size = 1
    while size * 2 <= width:
        values = pick(values[:-size], values[size:])
        size *= 2
    return values if size == width else pick(values[: len(values) - (width - size)], values[width - size :])
