"""Lists of token ids for many strings, kept in arrays and looked up for whole batches."""

from __future__ import annotations

import numpy as np


class Lists:
    """Lists of ids side by side in one array."""

    def __init__(self, kind=np.uint16) -> None:
        self.first, self.n, self.flat, self.count, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, kind), 0, 0

    def add(self, n: np.ndarray, flat: np.ndarray) -> None:
        while self.count + len(n) > len(self.n):
            self.first, self.n = np.concatenate([self.first, np.zeros_like(self.first)]), np.concatenate([self.n, np.zeros_like(self.n)])
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        at = slice(self.count, self.count + len(n))
        self.first[at] = self.used + np.cumsum(n) - n
        self.n[at] = n
        self.flat[self.used : self.used + len(flat)] = flat
        self.count, self.used = self.count + len(n), self.used + len(flat)

    def one(self, row: int) -> list[int]:
        at = self.first[row]
        return self.flat[at : at + self.n[row]].tolist()

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(length of each row's list, all of their ids)."""
        n = self.n[rows]
        ends = np.cumsum(n)
        return n, self.flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.first[rows] - (ends - n), n)]


def sums_of(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of the next sizes[k] values."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


class Rows(dict):
    """Strings numbered as they are first asked for."""

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        return n
