"""Words, and hashes of word and byte sequences, as whole NumPy arrays.

A word is a run of bytes other than space and 0x09-0x0D; in UTF-8 those bytes are never part
of another character. Sequence hashes are polynomial, modulo 2^64, over random 64-bit codes of
the units, so the hash of any stretch comes from two prefix sums.
"""

from __future__ import annotations

import numpy as np

WHITE = "[ \\t-\\r]+"
WORD = "[^ \\t-\\r]+"

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
CODES = np.random.default_rng(20_260_101).integers(1, 1 << 63, 256, dtype=np.uint64)


def mix(values: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    with np.errstate(over="ignore"):
        x = values ^ (values >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


class _Powers:
    """Powers of the base and of its inverse, grown as longer sequences come."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << max(12, (n - 1).bit_length())
            with np.errstate(over="ignore"):
                steps = np.full(size, _BASE, dtype=np.uint64)
                steps[0] = 1
                self.up = np.multiply.accumulate(steps)
                steps[1:] = np.uint64(_INVERSE)
                self.down = np.multiply.accumulate(steps)
        return self.up, self.down


_POWERS = _Powers()


class Sequence:
    """Hashes of stretches [start, end) of a sequence of 64-bit unit codes."""

    def __init__(self, codes: np.ndarray) -> None:
        up, self._down = _POWERS.upto(len(codes) + 1)
        self._sums = np.zeros(len(codes) + 1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(codes * up[: len(codes)], out=self._sums[1:])

    def __len__(self) -> int:
        return len(self._sums) - 1

    def grams(self, k: int) -> np.ndarray:
        """Hashes of all stretches of `k` units."""
        with np.errstate(over="ignore"):
            return (self._sums[k:] - self._sums[:-k]) * self._down[: len(self._sums) - k]

    def stretches(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self._sums[end] - self._sums[start]) * self._down[start]


def byte_array(text: str | bytes | None) -> np.ndarray:
    if text is None:
        return np.zeros(0, dtype=np.uint8)
    return np.frombuffer(text if isinstance(text, bytes) else text.encode(), dtype=np.uint8)


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of every word."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~_SPACE[data]
    edges = np.diff(inside)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def word_codes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit code of every word."""
    hashes = Sequence(CODES[data]).stretches(start, end)
    with np.errstate(over="ignore"):
        return mix(hashes + (end - start).astype(np.uint64) * np.uint64(_BASE))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased."""
    return _LOWER[data]


def winnow(hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the smallest hash of every `width` neighbours, the leftmost of equal ones, and the first
    and last of the starts for which each is the smallest.

    Two sequences that agree on `width` neighbours select the same one there.
    """
    n = len(hashes)
    if n < width:
        return (np.zeros(0, dtype=np.int64),) * 3
    bits = np.uint64(max(1, (n - 1).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    least = (mix(hashes) & ~low) | np.arange(n, dtype=np.uint64)
    span = 1
    while span < width:
        step = min(span, width - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    chosen = (least & low).astype(np.int64)
    first = np.flatnonzero(np.diff(chosen, prepend=-1))
    return chosen[first], first, np.append(first[1:], len(chosen)) - 1
