"""Content-defined anchors of byte strings: every window of ``width`` bytes belongs to one anchor, by content alone."""

from __future__ import annotations

import numpy as np

GRAM = 64
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_LETTERS = np.random.default_rng(17).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


class Powers:
    """Powers of the base and of its inverse, grown as needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up), 1 << 16)
            self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, _BASE, np.uint64)]), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, _INVERSE, np.uint64)]), dtype=np.uint64)


def gram_hashes(data: np.ndarray, powers: Powers, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes at each start, by content alone."""
    n = len(data)
    powers.grow(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_LETTERS[data] * powers.up[:n], out=sums[1:])
    h = (sums[gram:] - sums[: n - gram + 1]) * powers.down[: n - gram + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def sliding_minima(h: np.ndarray, width: int) -> np.ndarray:
    n = len(h) - width + 1
    padded = np.full(-(-len(h) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(h)] = h
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


#: Windows that are hashed at a time.
AT_ONCE = 1 << 20


def _inside(h: np.ndarray, keys: np.ndarray, first: np.ndarray, last: np.ndarray, grams: int) -> np.ndarray:
    """Whether a run's windows hold its key's gram at two places, as equal windows of one run would."""
    listed = np.zeros(4096, bool)
    listed[(keys & np.uint64(4095)).astype(int)] = True
    places = np.flatnonzero(listed[(h & np.uint64(4095)).astype(np.int16)])
    values, counts = np.unique(h[places], return_counts=True)
    twice = np.isin(keys, values[counts > 1])
    for i in np.flatnonzero(twice):
        twice[i] = np.count_nonzero(h[first[i] : last[i] + grams] == keys[i]) > 1
    return twice


def runs(data: np.ndarray, width: int, powers: Powers, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, first, last, inside): windows starting at first..last share the key, the least gram hash inside each.

    Two equal windows anywhere have one key; if they are in one run, ``inside``
    is true for it. Runs over a repetitive stretch are cut at ``width`` windows,
    so none is longer.
    """
    found = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))]
    for at in range(0, len(data) - width + 1, AT_ONCE):
        part = data[at : at + AT_ONCE + width - 1]
        h = gram_hashes(part, powers, gram)
        least = sliding_minima(h, width - gram + 1)
        first = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
        last = np.concatenate([first[1:] - 1, [len(least) - 1]])
        if (last - first).max() >= width:
            first = np.concatenate([np.arange(a, b + 1, width) for a, b in zip(first, last)])
            last = np.concatenate([first[1:] - 1, [len(least) - 1]])
        found.append((least[first], first + at, last + at, _inside(h, least[first], first, last, width - gram + 1)))
    return tuple(map(np.concatenate, zip(*found)))
