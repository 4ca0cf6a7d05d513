"""Word shingles of texts as 64-bit hashes, vectorised over the bytes."""

from __future__ import annotations

import numpy as np

_RANDOM = np.random.Generator(np.random.PCG64(20240607))
#: Random values of bytes, and the odd base of the word polynomial with its inverse.
BYTES = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all (murmur finaliser)."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _power(base: np.uint64, count: int) -> np.ndarray:
    key = str(base)
    if key not in _powers or len(_powers[key]) < count:
        steps = np.full(max(count, 1 << 16), base, np.uint64)
        steps[0] = 1
        _powers[key] = np.multiply.accumulate(steps)
    return _powers[key][:count]


def word_hashes(text: str) -> np.ndarray:
    """A hash for each word; words are runs of characters above the ASCII space, case folded."""
    raw = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    solid = np.empty(len(raw) + 2, np.int8)
    solid[0] = solid[-1] = 0
    np.greater(raw, 32, out=solid[1:-1], casting="unsafe")
    edges = np.flatnonzero(np.diff(solid))
    starts, ends = edges[::2], edges[1::2]
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(BYTES[raw] * _power(BASE, len(raw)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power(INVERSE, len(raw))[starts] if len(starts) else np.zeros(0, np.uint64))


def shingle_hashes(text: str, words: int = 5) -> np.ndarray:
    """A hash for each run of `words` words; a shorter text with any word is one shingle."""
    own = word_hashes(text)
    size = min(words, len(own))
    if not size:
        return own
    total = np.zeros(len(own) - size + 1, np.uint64)
    for k in range(size):
        total *= BASE
        total += own[k : len(own) - size + 1 + k]
    return mix(total + np.uint64(size))


def multiset(text: str, words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles in order of their hashes, and how often each occurs."""
    return np.unique(shingle_hashes(text, words), return_counts=True)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of the smaller counts over the sum of the larger ones; 0 if either is empty."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    union = int(a[1].sum() + b[1].sum()) - both
    return both / union if both else 0.0
