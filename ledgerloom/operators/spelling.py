"""Nearest spellings: upper bounds of the matching-blocks ratio, for many entries at once.

The ratio of two strings is twice the letters in matching blocks by the letters of both.  Matching blocks are a common subsequence, so it is bounded by
the shorter length, by the letters that both have (with their counts), and by the longest common subsequence.  Each bound costs more than the one before
and is asked only of what that has left; the ratio itself is computed for the few entries that can still be among the best.
"""

from __future__ import annotations

import difflib
import heapq

import numpy as np

#: Counters for letters (several letters may share one: the bound only gets wider), and letters that a machine word holds.
COUNTERS, WORD = 64, 64


class Entries:
    """Entries of one block with their lengths, letter counts and letters in a matrix."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        self.size = np.array([len(t) for t in texts], np.int64)
        width = int(self.size.max(initial=0))
        self.letters = np.full((len(texts), width), -1, np.int32)
        for row, t in zip(self.letters, texts):
            row[: len(t)] = np.frombuffer(t.encode("utf-32-le"), np.int32)
        self.counts = np.zeros((len(texts), COUNTERS), np.int32)
        at = self.letters >= 0
        np.add.at(self.counts, (np.nonzero(at)[0], self.letters[at] % COUNTERS), 1)

    def bounds(self, value: str, cutoff: float) -> tuple[np.ndarray, np.ndarray]:
        """Entries whose ratio with ``value`` may reach the cutoff, and the bound of each."""
        n = len(value)
        both = self.size + n
        share = lambda common, which: np.where(both[which] > 0, 2.0 * common / np.maximum(both[which], 1), 1.0)
        left = np.arange(len(self.texts))
        left = left[share(np.minimum(self.size, n), left) >= cutoff]
        points = np.frombuffer(value.encode("utf-32-le"), np.int32)
        mine = np.bincount(points % COUNTERS, minlength=COUNTERS)
        common = np.minimum(self.counts[left], mine).sum(axis=1)
        keep = share(common, left) >= cutoff
        left, common = left[keep], common[keep]
        if 0 < n <= WORD and len(left):
            common = np.minimum(common, self._subsequence(points, left))
            keep = share(common, left) >= cutoff
            left, common = left[keep], common[keep]
        return left, share(common, left)

    def _subsequence(self, points: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Longest common subsequence of ``points`` and each entry, by bit vectors: one step per letter of the longest entry."""
        known, place = np.unique(points, return_inverse=True)
        masks = np.zeros(len(known) + 1, np.uint64)
        for k, p in enumerate(place):
            masks[p] |= np.uint64(1 << k)
        rows = self.letters[which, : int(self.size[which].max())]
        at = np.searchsorted(known, rows)
        mask = masks[np.where(known[np.minimum(at, len(known) - 1)] == rows, at, len(known))]
        state = np.full(len(which), np.uint64(0xFFFFFFFFFFFFFFFF))
        for column in mask.T:
            met = state & column
            state = (state + met) | (state - met)
        return np.bitwise_count(~state & np.uint64((1 << len(points)) - 1)).astype(np.int64)


def nearest(value: str, entries: Entries, limit: int, cutoff: float) -> tuple[list[tuple[float, str]], int]:
    """The ``limit`` best ``(ratio, entry)`` at or above the cutoff, greatest entry first among equals; and how many ratios that took."""
    left, bound = entries.bounds(value, cutoff)
    matcher = difflib.SequenceMatcher()
    matcher.set_seq2(value)
    best: list[tuple[float, str]] = []
    scored = 0
    for k in np.argsort(-bound, kind="stable"):
        if len(best) == limit and bound[k] < best[0][0]:
            break
        text = entries.texts[left[k]]
        matcher.set_seq1(text)
        scored += 1
        ratio = matcher.ratio()
        if ratio >= cutoff:
            (heapq.heappush if len(best) < limit else heapq.heappushpop)(best, (ratio, text))
    return sorted(best, reverse=True), scored
