"""Whole texts as flat numpy arrays: code points, word hashes, and the mixing function they share."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Odd multiplier of the wrap-around polynomial hashes, and its inverse modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits (xor-shift-multiply)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row, and the offsets at which each text starts (one more at the end)."""
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return flat, np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def chunks(sizes: list[int], most: int = 1_000_000) -> Iterator[slice]:
    """Slices of consecutive items of at most ``most`` in all; a larger item stands alone."""
    lo, total = 0, 0
    for k, n in enumerate(sizes):
        if k > lo and total + n > most:
            yield slice(lo, k)
            lo, total = k, 0
        total += n
    if lo < len(sizes):
        yield slice(lo, len(sizes))


@lru_cache(maxsize=1)
def powers(n: int = 1 << 16) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, BASE)]), dtype=np.uint64)


@lru_cache(maxsize=1)
def folded() -> np.ndarray:
    """For each code point: 0 unless it is a letter or digit, else the code point of its lower case."""
    table = np.zeros(0x110000, np.uint32)
    for k in range(0x110000):
        c = chr(k)
        if c.isalnum():
            low = c.lower()
            table[k] = ord(low) if len(low) == 1 else k
    return table


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word (run of letters and digits, lower case), and the offsets of each text's words."""
    flat, at = points(texts)
    low = folded()[flat]
    inside = low > 0
    before = np.concatenate([[False], inside[:-1]])
    after = np.concatenate([inside[1:], [False]])
    edges = at[1:-1][at[1:-1] < len(flat)]
    before[edges] = False
    after[edges[edges > 0] - 1] = False
    first, last = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after)
    sizes = last - first + 1
    where = np.arange(len(flat))[inside] - np.repeat(first, sizes)
    weight = powers()[where & 0xFFFF] if len(where) else np.zeros(0, np.uint64)
    if len(where) and where.max() > 0xFFFF:  # words longer than the table of powers
        weight = weight * mix((where >> 16).astype(np.uint64) + np.uint64(1)) * (where > 0xFFFF) + weight * (where <= 0xFFFF)
    value = (low[inside].astype(np.uint64) + np.uint64(1)) * weight
    starts = np.cumsum(sizes) - sizes
    sums = np.add.reduceat(value, starts) if len(starts) else np.zeros(0, np.uint64)
    return mix(sums + sizes.astype(np.uint64) * BASE), np.searchsorted(first, at)
