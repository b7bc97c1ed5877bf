"""64-bit hashes of many runs of bytes at once, depending on a seed.

A run of up to LONG bytes is read as numbers of eight bytes, and each is mixed with what came before
it by a bijection of 64-bit numbers; longer runs are hashed one by one by XXH3. Both are functions of
all bits of a run without algebraic structure, so that different ones of n runs have equal hashes with a chance of
about n^2 / 2^65, however they repeat themselves. Whoever could write runs that collide would have to know the seed.
"""

from __future__ import annotations

import numpy as np
import xxhash

U = np.uint64
#: Bytes of a run that are mixed in arrays, a multiple of eight.
LONG = 32
_KEPT = np.array([(1 << 8 * n) - 1 for n in range(9)], "u8")
_STEP = U(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U(33))
    h = h * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def run_hashes(data: bytes, begins: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """The hash of each run data[begin:end] of bytes."""
    whole = np.frombuffer(data + bytes(8), "u1")
    at_byte = np.ndarray((len(data) + 1,), "<u8", whole, strides=(1,))
    length = (ends - begins).astype("i8")
    h = mix((length.astype("u8") + U(1)) * _STEP ^ U(seed & (1 << 64) - 1))
    for j in range(0, LONG, 8):
        own = np.flatnonzero(length > j) if j else slice(None)
        left = np.minimum(length[own] - j, 8)
        h[own] = mix(h[own] * _STEP ^ at_byte[begins[own] + j] & _KEPT[left])
    for i in np.flatnonzero(length > LONG).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[begins[i] : ends[i]], seed & (1 << 64) - 1)
    return h
