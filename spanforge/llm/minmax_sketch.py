"""Shingle sets and min-max sketches of texts."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

#: Words whose hashes a task remembers at a time.
MEMO_WORDS = 100_000

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> _S33)
    x = x * _MIX1
    x = x ^ (x >> _S33)
    x = x * _MIX2
    return x ^ (x >> _S33)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


def shingles(text: str | None, memo: WordHashes, words: int = 2) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; A-Z is lower-cased.

    With fewer words the whole sequence is the one shingle; without words there is none.
    """
    tokens = (text or "").encode().translate(_LOWER).split()
    if not tokens:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, tokens), np.uint64, len(tokens))
    width = min(words, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - width + 1 + i])
    return np.unique(out)


def set_key(hashes: np.ndarray) -> bytes:
    """128 bits that name a shingle set."""
    return hashlib.blake2b(hashes.astype("<u8").tobytes(), digest_size=16).digest()


class MinMax:
    """Minimum and maximum under each permutation, in bands.

    A permutation is hashed once and gives two signature values. Both values are
    unbiased for the Jaccard similarity, and, where sets differ by few elements,
    one that moves the minimum can't also be the one that moves the maximum, so
    their mean varies less than that of two minima. Bands of minima and bands of
    maxima take ``rows`` different permutations each.
    """

    def __init__(self, bands: int = 40, rows: int = 6, seed: int = 5):
        if bands % 2:
            raise ValueError("bands must be even: half are of minima, half of maxima")
        self.bands, self.rows = bands, rows
        self.multipliers = np.random.default_rng(seed).integers(1, 1 << 63, bands // 2 * rows, np.uint64) * np.uint64(2) + np.uint64(1)

    def sketch(self, hashes: np.ndarray) -> np.ndarray:
        """Band keys (64-bit), alike for two sets where all rows of a band are."""
        low = high = None
        for at in range(0, len(hashes), 512):  # so that a block of hash values stays in the cache
            x = hashes[at : at + 512, None] * self.multipliers
            x ^= x >> np.uint64(32)
            x *= _MIX1
            low = x.min(axis=0) if low is None else np.minimum(low, x.min(axis=0))
            high = x.max(axis=0) if high is None else np.maximum(high, x.max(axis=0))
        keys = np.arange(self.bands, dtype=np.uint64)
        rows = np.concatenate([low.reshape(-1, self.rows), high.reshape(-1, self.rows)])
        for r in range(self.rows):
            keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + rows[:, r])
        return keys


def linked(a: np.ndarray, b: np.ndarray, percent: int = 80) -> bool:
    """Whether 100 x intersection is at least ``percent`` x union, on sorted sets."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large) or not len(small):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = len(large) - 1
    both = int(np.count_nonzero(large[at] == small))
    return 100 * both >= percent * (len(a) + len(b) - both)
