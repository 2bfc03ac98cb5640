"""Hashed word shingles of many texts at a time, for tasks."""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
STEP = 0xD6E8FEB86659FD93


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits spread over the whole 64-bit word; one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**n modulo 2**64."""
    out = np.full(n + 1, base & (2**64 - 1), np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def stretch_hashes(codes: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each stretch of ``codes``, the same wherever it stands."""
    n = len(codes)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(codes.astype(np.uint64) * powers(BASE, n)[:n], dtype=np.uint64, out=sums[1:])
    back = powers(pow(BASE, -1, 2**64), n)
    return mixed((sums[stops] - sums[starts]) * back[starts] + (stops - starts).astype(np.uint64))


def byte_codes(seed: int) -> np.ndarray:
    """A fixed 64-bit number for each byte value."""
    return mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(STEP) + np.uint64(seed))


def is_blank() -> np.ndarray:
    flags = np.zeros(256, bool)
    flags[[0x20, *range(9, 14)]] = True
    return flags


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """The sorted distinct hashed shingles of each text.

    Words are lower-cased for A-Z only. A text of fewer words than ``width`` has
    its whole word sequence as one shingle, one without words has none.
    """
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    data = lower[data]
    inside = ~is_blank()[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True
    before = np.concatenate(([False], inside[:-1])) & ~first[:-1] if len(data) else inside
    after = np.concatenate((inside[1:], [False])) & ~first[1:] if len(data) else inside
    starts, stops = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    words = stretch_hashes(byte_codes(1)[data], starts, stops)
    bounds = np.searchsorted(starts, offsets)
    rolled = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for k in range(width):
        rolled = rolled * np.uint64(STEP) + words[k : k + len(rolled)]
    rolled = mixed(rolled)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            h = 0
            for w in words[a:b].tolist():
                h = (h * STEP + w) & (2**64 - 1)
            out.append(mixed(np.array([h + (b - a)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
