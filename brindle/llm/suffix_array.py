"""An enhanced suffix array of many short byte strings, and its common-prefix interval tree.

The strings are sorted together: suffixes by rank doubling with array operations, each ending at its own string's
end.  A scan over the common-prefix lengths with a stack then visits every interval of the tree from the leaves
up.  An interval whose suffixes are preceded by different bytes (or by a string's beginning) cannot be extended to
the left; nor can an interval be extended to the right, as its suffixes part after its common prefix.  So each
such interval is a maximal repeat, and its suffixes are all the repeat's occurrences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

FIRST = 7  # symbols of 9 bits in the first key: a byte plus one, or 0 past the end
DIVERSE = -1


class SuffixArray:
    """``least``: only suffixes of at least so many bytes are listed."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, least: int):
        n = len(data)
        self.lengths = np.diff(np.append(starts, n))
        self.string = np.repeat(np.arange(len(starts)), self.lengths)
        self.left = np.repeat(starts + self.lengths, self.lengths) - np.arange(n)  # bytes to the string's end
        self.data, self.starts, self.levels = data, starts, []
        order = self._sort()
        self.order = order[self.left[order] >= least]
        self.lcp = self._common()

    def _sort(self) -> np.ndarray:
        n = len(self.data)
        key = np.zeros(n, dtype=np.uint64)
        padded = np.concatenate([self.data.astype(np.uint64) + np.uint64(1), np.zeros(FIRST, np.uint64)])
        for k in range(FIRST):
            key = (key << np.uint64(9)) | np.where(self.left > k, padded[k : k + n], np.uint64(0))
        h = FIRST
        while True:
            order = np.argsort(key)
            rank = np.empty(n, dtype=np.uint32)
            ordered = key[order]
            steps = np.ones(n, dtype=np.uint32)
            steps[1:] = ordered[1:] != ordered[:-1]
            number = np.cumsum(steps, dtype=np.uint32)
            rank[order] = number
            self.levels.append((h, rank))
            if not n or number[-1] == n or h >= self.lengths.max():
                return order
            further = np.zeros(n, dtype=np.uint64)
            further[:-h] = rank[h:]
            key = (rank.astype(np.uint64) << np.uint64(32)) | np.where(self.left > h, further, np.uint64(0))
            h *= 2

    def _common(self) -> np.ndarray:
        """lcp[i]: of suffixes i - 1 and i; lcp[0] is 0."""
        a, b = self.order[:-1], self.order[1:]
        most = np.minimum(self.left[a], self.left[b])
        out = np.zeros(len(a), dtype=np.int64)
        for h, rank in reversed(self.levels):
            inside = out + h <= most  # a level that reaches past the end cannot match unless both end there
            at_a, at_b = np.where(out < most, a + out, 0), np.where(out < most, b + out, 0)
            same = (out < most) & (rank[at_a] == rank[at_b])
            out = np.where(same, np.where(inside, out + h, most), out)
        going = out < most
        for _ in range(FIRST - 1):  # fewer bytes than the lowest level tells are left
            at_a, at_b = np.where(going, a + out, 0), np.where(going, b + out, 0)
            going &= self.data[at_a] == self.data[at_b]
            out = out + going
            going &= out < most
        return np.concatenate([[0], np.minimum(out, most)])[: len(self.order)]

    def maximal_repeats(self, least: int, low: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(length, first, last, lowest): suffixes order[first..last] share ``length`` >= ``least`` bytes, not all
        preceded by the same byte; lowest: the least ``low`` of their strings."""
        if not len(self.order):
            return
        before = np.where(self.order > self.starts[self.string[self.order]], self.data[self.order - 1].astype(np.int64), DIVERSE)
        lows = low[self.string[self.order]]
        runs = np.flatnonzero(self.lcp < least)
        lasts = np.append(runs[1:], len(self.order)) - 1
        # a run that one byte precedes throughout is the tail of a longer repeat, and so are its parts
        same = (np.minimum.reduceat(before, runs) == np.maximum.reduceat(before, runs)) & (before[runs] != DIVERSE)
        open_ = np.flatnonzero((lasts > runs) & ~same)
        for a, b in zip(runs[open_].tolist(), lasts[open_].tolist(), strict=True):
            lcp, lefts, minima = self.lcp[a : b + 1].tolist(), before[a : b + 1].tolist(), lows[a : b + 1].tolist()
            stack: list[list[int]] = []
            for i in range(1, b - a + 2):
                now = lcp[i] if i <= b - a else 0
                first, left, lowest = i - 1, lefts[i - 1], minima[i - 1]
                while stack and now < stack[-1][0]:
                    length, first, other, other_low = stack.pop()
                    left = left if left == other else DIVERSE
                    lowest = min(lowest, other_low)
                    if left == DIVERSE:
                        yield length, a + first, a + i - 1, lowest
                if stack and stack[-1][0] == now:
                    top = stack[-1]
                    top[2] = left if left == top[2] else DIVERSE
                    top[3] = min(top[3], lowest)
                elif now >= least:
                    stack.append([now, first, left, lowest])


def concatenated(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(s) for s in strings], dtype=np.int64)
    return np.frombuffer(b"".join(strings), dtype=np.uint8), np.cumsum(lengths) - lengths


def repeat_groups(strings: list[bytes], least: int) -> list[tuple[bytes, list[tuple[int, int]]]]:
    """Every maximal repeat of at least ``least`` bytes with all its occurrences (string, place); strings are not empty."""
    data, starts = concatenated(strings)
    array = SuffixArray(data, starts, least)
    out = []
    for length, a, b, _ in array.maximal_repeats(least, np.zeros(len(strings), dtype=np.int64)):
        at = array.order[a : b + 1]
        places = sorted(zip(array.string[at].tolist(), (at - starts[array.string[at]]).tolist(), strict=True))
        s, p = places[0]
        out.append((strings[s][p : p + length], places))
    return out


def covered_by_lower(strings: list[bytes], low: np.ndarray, least: int) -> list[list[tuple[int, int]]]:
    """Per string the spans of its bytes in repeats that also occur in a string of smaller ``low``, merged."""
    data, starts = concatenated(strings)
    array = SuffixArray(data, starts, least)
    change = np.zeros(len(data) + len(strings) + 1, dtype=np.int32)  # one place more a string, so that ends stay apart
    for length, a, b, lowest in array.maximal_repeats(least, low):
        at = array.order[a : b + 1]
        of = array.string[at]
        worse = low[of] > lowest
        begin = at[worse] + of[worse]
        np.add.at(change, begin, 1)
        np.add.at(change, begin + length, -1)
    covered = np.cumsum(change) > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8)))
    first = starts + np.arange(len(strings))
    owner = np.searchsorted(first, edges[::2], side="right") - 1
    out: list[list[tuple[int, int]]] = [[] for _ in strings]
    for o, a, b in zip(owner.tolist(), (edges[::2] - first[owner]).tolist(), (edges[1::2] - first[owner]).tolist(), strict=True):
        out[o].append((a, b))
    return out
