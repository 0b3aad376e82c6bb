"""Hashes of bytes, words and runs of words, over whole shards at once.

Words are ``[^\\x20\\x09-\\x0D]+``. Hashes are polynomials modulo 2**64 over random 64-bit codes, finished by a mixing
step; equal strings have equal hashes, and different strings do so with a chance of about 2**-50.
"""

from __future__ import annotations

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
CODES = np.random.default_rng(20_011).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


_POWERS = [np.zeros(0, np.uint64)] * 2


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, 0 to n at least. One pair of arrays is kept, for the largest n so far."""
    if len(_POWERS[0]) <= n:
        size = 1 << max(16, int(n).bit_length())
        for i, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            every = np.full(size + 1, np.uint64(base))
            every[0] = 1
            _POWERS[i] = np.multiply.accumulate(every)
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def light(x: np.ndarray) -> np.ndarray:
    """A cheaper bijection in place; the upper half is well spread."""
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x9FB21C651E98DF25)
    return x


def prefix(values: np.ndarray) -> np.ndarray:
    """Sums from which ``span`` takes the hash of any range."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values))[0][: len(values)], out=out[1:])
    return out


def span(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the ranges [start, end)."""
    return mix((sums[end] - sums[start]) * powers(len(sums))[1][start] + (end - start).astype(np.uint64))


def sliding(sums: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all ranges of length k."""
    n = max(0, len(sums) - k)
    if not n:
        return np.zeros(0, np.uint64)
    out = sums[k:] - sums[:n]
    out *= powers(len(sums))[1][:n]
    return light(out)


def word_bounds(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for documents [starts, ends), which follow each other, the place of their first word (one more at the end)."""
    inside = ~SPACE[text]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    cut = starts[(starts > 0) & (starts < len(text))]
    begins[cut] = inside[cut]
    stops[cut - 1] = inside[cut - 1]
    first, last = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return first, last, np.searchsorted(first, np.append(starts, ends[-1] if len(ends) else 0))


def word_hashes(text: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    return span(prefix(CODES[text]), first, last)
