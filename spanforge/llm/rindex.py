"""A run-length index of a short text and the matching statistics that it streams.

Suffixes are sorted by their first ``depth`` bytes or more; the Burrows-Wheeler
transform is cut into runs, and at run ends the suffix position and its
neighbour in the suffix order are sampled. Only the runs and these samples are
kept; the order itself is dropped. Along a run, neighbours in the suffix order
stay neighbours one byte to the left, so the longest match with a neighbour
grows by one with each byte that is streamed from right to left, but for the
sampled ends, where it is measured against the text.
"""

from __future__ import annotations

import numpy as np

#: Bytes that an index may have: rank, rank and position share a 64-bit sort key.
MOST_BYTES = (1 << 21) - 2
_BITS, _MASK = np.uint64(21), np.uint64((1 << 21) - 1)
#: A byte that UTF-8 doesn't have, between the strings of a text.
SEPARATOR = 0xFF
_FIRST = 5


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffix positions, ordered by their first ``depth`` bytes or more, then by position."""
    n = len(text)
    index = np.arange(n, dtype=np.uint64)
    padded = np.concatenate([text, np.full(_FIRST, SEPARATOR, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for i in range(_FIRST):
        key = (key << np.uint64(8)) | padded[i : n + i]
    sorted_to = _FIRST
    while True:
        packed = np.sort((key << _BITS) | index)
        order = (packed & _MASK).astype(np.int32)
        if sorted_to >= depth:
            return order
        packed >>= _BITS
        new = np.empty(n, bool)
        new[0], new[1:] = True, packed[1:] != packed[:-1]
        rank = np.empty(n, np.int32)
        rank[order] = np.cumsum(new, dtype=np.int32)
        key = rank.astype(np.uint64) << _BITS
        if sorted_to < n:
            key[: n - sorted_to] |= rank[sorted_to:].astype(np.uint64)
        sorted_to *= 2


class RunLengthIndex:
    """Runs of the transform (``run_bytes``, ``run_lengths``) and, for either side, sampled positions with their neighbours (-1: none)."""

    def __init__(self, text: np.ndarray, depth: int):
        if len(text) > MOST_BYTES:
            raise ValueError("the text is too long for one index")
        self.text, self.depth = text, depth
        order = suffix_order(text, depth)
        place = np.empty(len(text), np.int32)
        place[order] = np.arange(len(text), dtype=np.int32)
        before = text[order - 1]
        before[order == 0] = SEPARATOR
        # Order beyond ``depth`` is by position; a run is also cut where that parts neighbours.
        left = place[order - 1]
        starts = np.flatnonzero(np.concatenate([[True], (before[1:] != before[:-1]) | (left[1:] - left[:-1] != 1)]))
        self.run_bytes, self.run_lengths = before[starts], np.diff(starts, append=len(text))
        self.above = self._sampled(order[starts] - 1, order, place, -1)
        self.below = self._sampled(order[starts + self.run_lengths - 1] - 1, order, place, 1)

    def _sampled(self, positions: np.ndarray, order: np.ndarray, place: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
        """Text positions one byte left of the suffixes at run ends, and their neighbours ``step`` places on."""
        n = len(self.text)
        at = np.unique(np.append(positions[positions >= 0], n - 1))
        beside = place[at] + step
        inside = (beside >= 0) & (beside < n)
        return at, np.where(inside, order[np.where(inside, beside, 0)], -1)

    def _common(self, x: np.ndarray, y: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Lengths of the longest common prefixes of suffixes at x and y, up to ``depth`` or a little more."""
        n, found, open_ = len(self.text), np.zeros(len(x), np.int64), np.flatnonzero(y >= 0)
        while len(open_):
            a, b = x[open_] + found[open_], y[open_] + found[open_]
            same = (words[a] == words[b]) & (np.maximum(a, b) + 8 <= n)
            open_ = open_[same]
            found[open_] += 8
            open_ = open_[found[open_] < self.depth]
        rest = np.flatnonzero((y >= 0) & (found < self.depth))
        for _ in range(7):
            a, b = x[rest] + found[rest], y[rest] + found[rest]
            inside = np.maximum(a, b) < n
            rest = rest[inside][self.text[a[inside]] == self.text[b[inside]]]
            found[rest] += 1
        return found

    def matching_statistics(self) -> np.ndarray:
        """For each position the longest match with another position; from ``depth`` on only known to be that long."""
        n = len(self.text)
        padded = np.concatenate([self.text, np.zeros(16, np.uint8)]).astype(np.uint64)
        words = np.zeros(n + 8, np.uint64)
        for i in range(8):
            words |= padded[i : n + 8 + i] << np.uint64(8 * i)
        longest = np.zeros(n, np.int64)
        for at, beside in (self.above, self.below):
            length = self._common(at, beside, words)
            nearest = np.repeat(np.arange(len(at)), np.diff(at, prepend=-1))
            longest = np.maximum(longest, length[nearest] + at[nearest] - np.arange(n))
        return longest


def repeated_windows(strings: list[bytes], width: int) -> list[np.ndarray]:
    """For each string and each start of a window of ``width`` bytes, whether the window starts elsewhere too, in any of the strings."""
    unique: dict[bytes, int] = {}
    times: list[int] = []
    which = []
    for s in strings:
        i = unique.setdefault(s, len(unique))
        if i == len(times):
            times.append(0)
        times[i] += 1
        which.append(i)
    text = np.frombuffer(b"".join(s + b"\xff" for s in unique), np.uint8)
    lengths = np.fromiter(map(len, unique), np.int64, len(unique))
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    flags = []
    if len(text) > width + 1:
        longest = RunLengthIndex(text, width).matching_statistics()
    else:
        longest = np.zeros(len(text), np.int64)
    for a, n, k in zip(starts, lengths, times):
        windows = max(0, n - width + 1)
        flags.append(np.ones(windows, bool) if k > 1 else longest[a : a + windows] >= width)
    return [flags[i] for i in which]
