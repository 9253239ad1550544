"""Word passages that documents share, by matching statistics over a compressed FM-index of each shard.

The index holds the Burrows-Wheeler transform of the shard's segments as a wavelet tree of packed bits, one array of
bits per binary digit of the word codes with counts at every 64th place, the common prefixes of neighbours in order, and the id of each suffix. Runs of
documents are streamed against it from their last word to their first: a backward step extends the match by one word to
the left; where no suffix goes on like that, the match is cut by a word at its right end, to its parent interval by the common prefixes, until one does. Each
step gives the length of the longest match from there on, as far as the threshold, and its interval; intervals that reach the threshold are reported, and the match goes on one word shorter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from corpusloom.llm.batches import ranges
from corpusloom.llm.repeats import Units, cut_repeats
from corpusloom.llm.suffix_array import doubled

SEPARATOR = 1


class Wavelet:
    """Ranks of symbols in a sequence of small numbers."""

    def __init__(self, sequence: np.ndarray, size: int):
        self.levels: list[tuple[int, np.ndarray, np.ndarray, int]] = []
        for digit in range(max(1, int(size - 1).bit_length()) - 1, -1, -1):
            bit = (sequence >> digit) & 1
            packed = np.packbits(bit.astype(np.uint8), bitorder="little").tobytes()
            words = np.frombuffer(packed + bytes(16 - len(packed) % 8), "<u8")
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(words))[:-1]]).astype(np.int32)
            self.levels.append((digit, words, before, int(len(sequence) - bit.sum())))
            sequence = np.concatenate([sequence[bit == 0], sequence[bit == 1]])
        self.start = self._down(np.arange(size), np.zeros(size, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for digit, words, before, zeros in self.levels:
            word = at >> 6
            ones = before[word] + np.bitwise_count(words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where((symbol >> digit) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        return self._down(symbol, at) - self.start[symbol]


class Index:
    """Suffixes of a text of small numbers, ordered by their first ``depth`` symbols."""

    def __init__(self, text: np.ndarray, size: int, depth: int):
        self.size, self.depth = size, depth
        self.sa = doubled(text, depth)
        self.tree = Wavelet(text[self.sa - 1], size)
        self.below = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))])
        # Common prefix of each suffix with the one before, up to the depth.
        self.shared = np.zeros(len(text), np.int64)
        live = np.arange(1, len(text))
        for done in range(depth):
            a, b = self.sa[live - 1] + done, self.sa[live] + done
            inside = (a < len(text)) & (b < len(text))
            live = live[inside][text[a[inside]] == text[b[inside]]]
            self.shared[live] = done + 1
        self.cuts: dict[int, np.ndarray] = {}

    def parent(self, low: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Interval of the first ``length`` symbols of the suffixes at ``low``."""
        first, end = np.empty_like(low), np.empty_like(low)
        for n in np.unique(length).tolist():
            if n not in self.cuts:
                self.cuts[n] = np.append(np.flatnonzero(self.shared < n), len(self.sa)) if n else np.array([0, len(self.sa)])
            own = length == n
            at = np.searchsorted(self.cuts[n], low[own], "right")
            first[own], end[own] = self.cuts[n][at - 1], self.cuts[n][at]
        return first, end

    def matching_statistics(self, text: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Streams runs of ``text`` from right to left, all in step: number of the run, place in it, length of the longest match from there on (at most the depth), and its interval.

        Symbols that the index does not know are numbers from ``size`` on.
        """
        live = np.arange(len(begins))
        low, high, length = np.zeros(len(begins), np.int64), np.full(len(begins), len(self.sa)), np.zeros(len(begins), np.int64)
        for step in range(int(lengths.max()) if len(lengths) else 0):
            going = lengths[live] > step
            if not going.all():
                live, low, high, length = live[going], low[going], high[going], length[going]
            at = lengths[live] - 1 - step
            symbol = text[begins[live] + at]
            full = length == self.depth
            if full.any():
                length[full] -= 1
                low[full], high[full] = self.parent(low[full], length[full])
            open_ = np.flatnonzero(symbol < self.size)
            unknown = symbol >= self.size
            low[unknown], high[unknown], length[unknown] = 0, len(self.sa), 0
            while len(open_):
                both = self.tree.rank(np.tile(symbol[open_], 2), np.concatenate([low[open_], high[open_]])) + np.tile(self.below[symbol[open_]], 2)
                found = both[:len(open_)] < both[len(open_):]
                hit = open_[found]
                low[hit], high[hit] = both[:len(open_)][found], both[len(open_):][found]
                length[hit] += 1
                open_ = open_[~found]
                # A symbol that stands nowhere in the text ends all matches.
                open_ = open_[length[open_] > 0]
                length[open_] -= 1
                low[open_], high[open_] = self.parent(low[open_], length[open_])
            yield live, at, length.copy(), low.copy(), high.copy()


def least_ids(data: np.ndarray, lengths: np.ndarray, ids: np.ndarray, window: int) -> np.ndarray:
    """For every window of every segment, the smallest id of all segments that hold the same words.

    ``data``: the segments' word hashes one after the other; ``ids``: each segment's id; each segment has at least one window.
    """
    n = len(lengths)
    known, code = np.unique(data, return_inverse=True)
    begins = np.cumsum(lengths + 1) - (lengths + 1)
    text = np.full(int((lengths + 1).sum()) + 1, SEPARATOR, np.int64)
    text[ranges(begins, lengths)] = code + SEPARATOR + 1
    text[-1] = 0
    index = Index(text, len(known) + SEPARATOR + 1, window)
    segment = np.append(np.repeat(np.arange(n), lengths + 1), n)
    id_at = np.append(ids, np.iinfo(np.int64).max)[segment[index.sa]]
    windows = lengths - window + 1
    first = np.cumsum(windows) - windows
    low_of, high_of = np.zeros(int(windows.sum()), np.int64), np.zeros(int(windows.sum()), np.int64)
    for run, at, length, low, high in index.matching_statistics(text, begins, lengths):
        reached = length >= window
        low_of[first[run[reached]] + at[reached]], high_of[first[run[reached]] + at[reached]] = low[reached], high[reached]
    starts, which = np.unique(low_of, return_inverse=True)
    ends = np.zeros(len(starts), np.int64)
    ends[which] = high_of
    # Intervals of equal length patterns don't overlap; the gaps between them are reduced too and passed over.
    edges = np.stack([starts, ends], 1).ravel()
    least = np.minimum.reduceat(np.append(id_at, np.iinfo(np.int64).max), edges)[::2] if len(edges) else id_at[:0]
    return least[which]


def cut_repeated_words(docs: DataFrame, window: int = 13, keep: tuple[str, ...] = ()) -> DataFrame:
    """Cuts the words of windows of ``window`` words that also start in a document with a smaller id; see ``repeats.cut_repeats``."""
    return cut_repeats(docs, Units(words=True, window=window, gram=max(1, (window - 1) // 2)), least_ids, keep=keep)
