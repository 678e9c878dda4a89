"""A compressed full-text index of a set of strings: suffix order, wavelet matrix, matching statistics; all in numpy."""

from __future__ import annotations

import numpy as np


def suffix_order(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """The sorted order of all suffixes by prefix doubling, and the ranks at each doubled length.

    ``depth`` is a length within which any two suffixes differ.
    """
    n = len(symbols)
    packed = np.zeros(n + 2, np.int64)
    packed[:n] = symbols + 1
    key = (packed[:n] << 42) | (packed[1 : n + 1] << 21) | packed[2 : n + 2]
    length, ranks = 3, []
    while True:
        order = np.argsort(key)
        step = np.empty(n, np.int32)
        step[0] = 0
        np.cumsum(key[order[1:]] != key[order[:-1]], out=step[1:])
        rank = np.empty(n, np.int32)
        rank[order] = step
        ranks.append((length, rank))
        if step[-1] == n - 1 or length >= depth:
            return order, ranks
        far = np.zeros(n, np.int64)
        far[: n - length] = rank[length:] + np.int64(1) if length < n else 0
        key = (rank.astype(np.int64) << 32) | far
        length *= 2


def common_prefixes(order: np.ndarray, ranks: list[tuple[int, np.ndarray]], symbols: np.ndarray) -> np.ndarray:
    """For each row but the first its common prefix with the row above; -1 at both ends (length ``n + 1``)."""
    n = len(order)
    a, b = order[:-1].astype(np.int64), order[1:].astype(np.int64)
    common = np.zeros(n - 1, np.int32)
    for length, rank in reversed(ranks):
        i, j = a + common, b + common
        inside = np.maximum(i, j) + length <= n
        same = inside & (rank[np.minimum(i, n - 1)] == rank[np.minimum(j, n - 1)])
        common[same] += length
    for _ in range(2):  # the shortest rank is of three symbols
        i, j = a + common, b + common
        inside = np.maximum(i, j) < n
        common[inside & (symbols[np.minimum(i, n - 1)] == symbols[np.minimum(j, n - 1)])] += 1
    return np.concatenate(([-1], common, [-1])).astype(np.int32)


def smaller_before(values: np.ndarray) -> np.ndarray:
    """For each place the last earlier one with a smaller value (0 if none), by pointer jumping."""
    before = np.maximum(np.arange(-1, len(values) - 1), 0)
    open_ = np.flatnonzero((values[before] >= values) & (before > 0))
    while len(open_):
        before[open_] = before[before[open_]]
        at = before[open_]
        open_ = open_[(values[at] >= values[open_]) & (at > 0)]
    return before


class WaveletMatrix:
    """Bit vectors of 64-bit words with counts, one for each bit of the symbols; answers how often a symbol comes first."""

    def __init__(self, sequence: np.ndarray, symbols: int) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []
        rest = sequence.astype(np.int32)
        self.top = max(1, int(symbols - 1).bit_length())
        for level in range(self.top - 1, -1, -1):
            bit = ((rest >> level) & 1).astype(bool)
            padded = np.zeros((len(bit) // 64 + 1) * 64, bool)
            padded[: len(bit)] = bit
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            counts = np.zeros(len(words), np.int32)
            np.cumsum(np.bitwise_count(words[:-1]), out=counts[1:])
            self.levels.append((words, counts, len(bit) - int(bit.sum())))
            rest = np.concatenate((rest[~bit], rest[bit]))
        every = np.arange(symbols, dtype=np.int64)
        self.start = self._walk(every, np.zeros(symbols, np.int64))

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, (words, counts, zeros) in zip(range(self.top - 1, -1, -1), self.levels, strict=True):
            word = at >> 6
            below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = counts[word] + np.bitwise_count(words[word] & below)
            at = np.where((symbol >> level) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before the place ``at``."""
        return self._walk(symbol, at) - self.start[symbol]


class FmIndex:
    """The index of several strings, each with a label (its document); one of ``several`` stands under other labels, too.

    The suffixes of a string end at the string's own separator, so every two differ. Only the wavelet matrix of the
    Burrows-Wheeler transform, the symbol counts, the common prefixes and the labels' changes are kept.
    """

    def __init__(self, points: np.ndarray, ends: np.ndarray, labels: np.ndarray, several: np.ndarray) -> None:
        self.starts = ends[:-1] + np.arange(len(ends) - 1)
        count = len(ends) - 1
        self.alphabet, compact = np.unique(points, return_inverse=True)
        n = len(points) + count
        own = np.repeat(np.arange(count), np.diff(ends))
        place = np.arange(len(points)) + own
        self.text = np.zeros(n, np.int64)
        self.text[place] = compact + 1
        ordered = self.text + count - 1
        stops = ends[1:] + np.arange(count)
        ordered[stops] = np.arange(count)
        order, ranks = suffix_order(ordered, int(np.diff(ends).max(initial=0)) + 1)
        self.common = common_prefixes(order, ranks, ordered)
        del ranks
        sizes = np.bincount(self.text, minlength=len(self.alphabet) + 1)
        self.first = np.concatenate(([0], np.cumsum(sizes)))
        self.wavelet = WaveletMatrix(self.text[order - 1], len(self.alphabet) + 1)
        row = np.repeat(np.arange(count), np.diff(ends) + 1)[order]
        row_label, twofold = labels[row], several[row]
        change = np.flatnonzero((row_label[1:] != row_label[:-1]) | twofold[1:]) + 1
        # up to which row there is one label alone (one of several labels is no such row itself), and the nearest rows
        # with a smaller common prefix on both sides
        self.other = np.repeat(np.append(change, n), np.diff(np.concatenate(([0], change, [n]))))
        self.other[twofold] = np.flatnonzero(twofold)
        self.before = smaller_before(self.common)
        self.after = len(self.common) - 1 - smaller_before(self.common[::-1])[::-1]
        self.n = n

    def matching_statistics(self, which: np.ndarray, lengths: np.ndarray, least: int) -> np.ndarray:
        """For every character of the strings ``which``, one after another, the longest match that starts there and
        also occurs under another label. All strings are searched backwards side by side. Those that can't reach
        ``least`` any more stop, so values below it may be too small.
        """
        base = np.cumsum(lengths) - lengths
        out = np.zeros(int(lengths.sum()), np.int32)
        left = lengths.astype(np.int64) - 1
        low, high = np.zeros(len(which), np.int64), np.full(len(which), self.n, np.int64)
        size = np.zeros(len(which), np.int64)
        start, live = self.starts[which], np.arange(len(which))
        while len(live):
            symbol = self.text[start[live] + left[live]]
            rank = self.wavelet.rank(np.concatenate((symbol, symbol)), np.concatenate((low[live], high[live])))
            a, b = self.first[symbol] + rank[: len(live)], self.first[symbol] + rank[len(live) :]
            longer = (b > a) & (self.other[np.minimum(a, self.n - 1)] < b)
            go = live[longer]
            low[go], high[go] = a[longer], b[longer]
            size[go] += 1
            out[base[go] + left[go]] = size[go]
            left[go] -= 1
            stay = live[~longer]
            left[stay[size[stay] == 0]] -= 1
            stay = stay[size[stay] > 0]
            # drop characters at the right end until the match is in more places
            at_low, at_high = self.common[low[stay]], self.common[high[stay]]
            top = np.maximum(at_low, at_high)
            new_low = np.where(at_low == top, self.before[low[stay]], low[stay])
            new_high = np.where(at_high == top, self.after[high[stay]], high[stay])
            root = top <= 0
            low[stay], high[stay] = np.where(root, 0, new_low), np.where(root, self.n, new_high)
            size[stay] = np.maximum(top, 0)
            live = live[(left[live] >= 0) & (size[live] + left[live] + 1 >= least)]
        return out
