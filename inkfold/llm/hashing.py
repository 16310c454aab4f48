"""Hashes of words and of runs of words, by numpy over whole texts."""

from __future__ import annotations

from functools import cache

import numpy as np

#: Odd multipliers of two independent polynomial hashes modulo 2**64.
WORD = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
RUN = (0xBF58476D1CE4E5B9, 0xA0761D6478BD642F)


@cache
def _powers(base: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of base and of its inverse modulo 2**64, 2**bits of each."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.ones(1, np.uint64)
        while len(p) < 1 << bits:
            p = np.concatenate([p, p * np.uint64(pow(b, len(p), 1 << 64))])
        out.append(p)
    return out[0], out[1]


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    bits = max(12, (n + 1).bit_length())
    return _powers(base, bits) if bits <= 20 else _powers.__wrapped__(base, bits)  # those of very long texts aren't held


def mix(x: np.ndarray) -> np.ndarray:
    """Spread each number's bits over all 64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans(data: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that aren't separators (a table of 256 booleans)."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~separator[data]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = WORD[0]) -> np.ndarray:
    """A 64-bit hash of each span of bytes, by its bytes and length."""
    up, down = powers(base, len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def run_hashes(words: np.ndarray, n: int, base: int = RUN[0]) -> np.ndarray:
    """A 64-bit hash of each n consecutive words, by the words' hashes."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    up, down = powers(base, len(words))
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * down[: len(words) - n + 1])


def space_table() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[9, 10, 11, 12, 13, 32]] = True
    return table
