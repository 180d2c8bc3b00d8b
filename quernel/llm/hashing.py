"""Vectorised hashing of byte texts: any substring's 64-bit hash from two prefix sums."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_U = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits whose output bits all depend on all input bits."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


#: A fixed random value for each byte, so that texts of structure don't meet in a sum.
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD6E8FEB86659FD93))


class Powers:
    """Powers of the base and of its inverse, grown as texts ask for them."""

    def __init__(self) -> None:
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            m = len(self.up)
            step, back = _U(pow(_BASE, m, 1 << 64)), _U(pow(_INVERSE, m, 1 << 64))
            self.up, self.down = np.concatenate([self.up, self.up * step]), np.concatenate([self.down, self.down * back])
        return self.up, self.down


_powers = Powers()


class Prefix:
    """Prefix sums of a byte array; span() hashes substrings by content alone."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers.get(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_VALUES[data] * up[: len(data)], out=self.sums[1:])

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))
