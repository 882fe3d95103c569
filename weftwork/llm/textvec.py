"""Hashes of words and of runs of words, over whole batches of texts at once.

Words are what lies between the bytes 0x20 and 0x09-0x0D. Hashes have 64 bits and are the
same in every task, so that equal runs meet whatever document they stand in.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np

U = np.uint64
GAPS = np.zeros(256, bool)
GAPS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWERED = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_random = np.random.Generator(np.random.PCG64(20240607))
BYTE = _random.integers(1, 2**63, 256, dtype=np.uint64) | U(1)
BASE = int(_random.integers(2**62, 2**63, dtype=np.uint64)) | 1
ROLL = int(_random.integers(2**62, 2**63, dtype=np.uint64)) | 1
LONG_WORD = 48


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which each bit of the result depends on all of x."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


@lru_cache(4)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n."""
    inverse = pow(base, -1, 2**64)
    out = []
    for b in (base, inverse):
        steps = np.full(n, b, np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n).bit_length())
    a, b = _powers(base, size)
    return a[:n], b[:n]


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the number of words of each text."""
    data = b" ".join(texts) + b" "
    raw = np.frombuffer(data, np.uint8)
    gap = GAPS[raw]
    edge = np.flatnonzero(np.diff(gap, prepend=True))
    starts, ends = edge[::2], edge[1::2]
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    counts = np.diff(np.searchsorted(starts, np.concatenate(([0], np.cumsum(lengths)))))
    if not len(starts):
        return np.empty(0, np.uint64), counts
    up, down = powers(BASE, len(raw))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(BYTE[raw] * up, out=total[1:])
    h = mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    for i in np.flatnonzero(ends - starts > LONG_WORD):
        h[i] = U(int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8).digest(), "little"))
    return h, counts


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each k consecutive words; the caller leaves out those that cross a text's end."""
    if len(h) < k:
        return np.empty(0, np.uint64)
    if k <= 8:
        out = np.zeros(len(h) - k + 1, np.uint64)
        for i in range(k):
            out += mixed(h[i : len(h) - k + 1 + i] + U((0x9E3779B97F4A7C15 * (i + 1)) % 2**64))
        return mixed(out)
    up, down = powers(ROLL, len(h))
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up, out=total[1:])
    n = len(h) - k + 1
    return mixed((total[k:] - total[:n]) * down[:n])


def inside(counts: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of the n runs of k words lie within one text."""
    ok = np.zeros(n, bool)
    at = 0
    for c in counts:
        if c >= k:
            ok[at : at + c - k + 1] = True
        at += c
    return ok
