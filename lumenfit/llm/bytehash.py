"""Hashes of all substrings of concatenated texts, in numpy."""

from __future__ import annotations

import numpy as np

U = np.uint64
BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2^64


def mix(z: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the constants are those of splitmix64)."""
    z = (z ^ (z >> U(30))) * U(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> U(27))) * U(0x94D049BB133111EB)
    return z ^ (z >> U(31))


with np.errstate(over="ignore"):
    BYTES = mix(np.arange(1, 257, dtype=np.uint64) * U(BASE))

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse."""
    if len(_powers[0]) < n:
        size = 1 << max(20, (n - 1).bit_length())
        for k, b in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers


class Spans:
    """Polynomial prefix sums of some bytes; ``of(start, end)`` hashes substrings."""

    def __init__(self, values: np.ndarray):
        """values: 64-bit values, such as BYTES[x]."""
        n = len(values)
        up, self.down = powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def all(self, width: int) -> np.ndarray:
        n = len(self.sums) - width
        return mix((self.sums[width:] - self.sums[:n]) * self.down[:n])


def ragged(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0] .. first[0]+size[0]-1, first[1] .., as one array."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - size), size)
