"""Vectorised 64-bit hashing of words and substrings in a buffer of bytes.

A substring's hash is a polynomial in an odd base modulo 2^64 over random values of its bytes, taken
from prefix sums, and then mixed. All values come from fixed rules, so they are the same everywhere.
"""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C55 | 1
INVERSE = pow(BASE, -1, 2**64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64's finisher)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, *range(9, 14)]] = True
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 to base^(n-1) modulo 2^64; kept, as all buffers use the same ones."""
    if len(_powers.get(base, ())) < n:
        out = np.full(max(n, 1 << 16), base, np.uint64)
        out[0] = 1
        _powers[base] = np.cumprod(out)
    return _powers[base][:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """One more than the bytes: the sum of BYTES[b] * BASE^i up to each place."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTES[data] * powers(BASE, len(data)), out=out[1:])
    return out


def substrings(sums: np.ndarray, starts: np.ndarray, sizes) -> np.ndarray:
    """The hashes of substrings, by where they start and how long they are."""
    raw = (sums[starts + sizes] - sums[starts]) * powers(INVERSE, len(sums))[starts]
    return mix(raw + np.asarray(sizes).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of all texts, and where each text's words begin (one more than the texts)."""
    data = np.frombuffer(b"\n".join([*texts, b""]) or b"\n", np.uint8)
    if lower:
        data = LOWER[data]
    edges = np.flatnonzero(np.diff(IS_SPACE[data], prepend=True, append=True))
    starts, ends = edges[::2], edges[1::2]
    hashes = substrings(prefix_sums(data), starts, ends - starts)
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=bounds[1:])
    return hashes, np.searchsorted(starts, bounds)
