"""Vectorised 64-bit hashes of words and of runs of words, straight from Arrow's text buffers.

A word's hash is a polynomial over random 64-bit values of its bytes (differences of prefix sums,
modulo 2**64), then mixed. It depends on the word's bytes only, never on its place or batch.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1  # odd, so that it has an inverse modulo 2**64
_P_INVERSE = pow(_P, -1, 1 << 64)
_VALUES = np.random.Generator(np.random.PCG64(20240607)).integers(0, 1 << 64, 256, dtype=np.uint64)
_LOWER = _VALUES.copy()
_LOWER[65:91] = _VALUES[97:123]
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_up, _down = _powers(_P, 1 << 12), _powers(_P_INVERSE, 1 << 12)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _up, _down
    if len(_up) <= n:
        if n > 1 << 23:  # a very long text: not kept
            return _powers(_P, n), _powers(_P_INVERSE, n)
        size = 1 << max(12, int(n).bit_length())
        _up, _down = _powers(_P, size), _powers(_P_INVERSE, size)
    return _up, _down


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def words(buffer: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each text) of the runs of bytes other than space and 0x09 to 0x0D."""
    n = len(buffer)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~SPACE[buffer]
    edges = np.zeros(n + 1, bool)  # a text begins here
    edges[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edges[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edges[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word's bytes; with ``lower``, A-Z count as a-z."""
    n = len(buffer)
    up, down = _tables(n)
    sums = np.zeros(n + 1, np.uint64)
    values = (_LOWER if lower else _VALUES)[buffer]
    values *= up[:n]
    np.cumsum(values, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingle_hashes(hashes: np.ndarray, firsts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all runs of ``k`` words, first shingle of each text); a text of 1 to k-1 words is one shingle."""
    counts = np.diff(firsts)
    sizes = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    at = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(sizes, out=at[1:])
    total = int(at[-1])
    if not total:
        return np.zeros(0, np.uint64), at
    text = np.repeat(np.arange(len(counts)), sizes)
    start = firsts[:-1][text] + (np.arange(total) - at[:-1][text])
    lengths = np.minimum(counts, k)[text]
    out = lengths.astype(np.uint64) * U(0xD6E8FEB86659FD93)
    short = lengths < k
    padded = np.concatenate([hashes, np.zeros(k, np.uint64)])
    for j in range(k):
        part = padded[start + j]
        if short.any():
            part = np.where(lengths > j, part, U(0))
        out = out * U(0xA0761D6478BD642F) + part
    return mix(out), at
