"""Words and hashes of word shingles, computed on whole arrays of bytes.

Words are runs of bytes other than space and \\x09-\\x0D, with A-Z in lower case. A word's hash
is the sum of a random 64-bit value per byte times an odd power per position; a shingle's hash
mixes those of its words. All values are fixed, so hashes agree between tasks and runs.
"""

from functools import cache

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RNG = np.random.default_rng(20240501)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE = np.where(_SPACE, np.uint64(0), _BYTE[_LOWER])
_BASE = int(_RNG.integers(1, 1 << 62)) * 2 + 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads each bit over all."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@cache
def _powers(bits: int, base: int) -> np.ndarray:
    p = np.full(1 << bits, base, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each word of a UTF-8 text."""
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64)
    inside = ~_SPACE[b]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    edge = np.concatenate((([0] if inside[0] else []), edge, ([len(b)] if inside[-1] else [])))
    edge = edge.astype(np.int64)
    start, end = edge[::2], edge[1::2]
    bits = max(12, int(len(b)).bit_length())
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[b] * _powers(bits, _BASE)[: len(b)], out=sums[1:])
    return start, end, mix((sums[end] - sums[start]) * _powers(bits, _INVERSE)[start])


def shingles(word_hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words, in order; none, if there are fewer words."""
    count = len(word_hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(count, n, np.uint64)
    for k in range(n):
        h = mix(h * _STEP + word_hashes[k : k + count])
    return h


class Runs:
    """Hashes of any runs of values, each from two prefix sums."""

    def __init__(self, values: np.ndarray):
        self.bits = max(12, int(len(values)).bit_length())
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(mix(values) * _powers(self.bits, _BASE)[: len(values)], out=self.sums[1:])

    def hashes(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return mix((self.sums[start + size] - self.sums[start]) * _powers(self.bits, _INVERSE)[start])


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct shingles of a text; of fewer than n words, the whole sequence is one."""
    h = words((text or "").encode())[2]
    return np.unique(shingles(h, min(n, len(h)))) if len(h) else np.zeros(0, np.uint64)
