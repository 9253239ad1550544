"""Suffix arrays by prefix doubling, and their permuted common prefixes, for the text of one shard.

Suffixes are sorted by as many first symbols as one number holds beside a position. What is tied is sorted again by the ranks of the suffixes that begin where
the sorted prefix ends, which doubles it in each round; only tied suffixes take part, so a round costs less the more of the order is known, and a periodic text
needs as many rounds as the logarithm of its length.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from corpusloom.llm.batches import reused_memory, words8
from corpusloom.llm.repeats import Units, cut_repeats

# Keys from which sorting numbers that carry their position beats an indirect sort.
BUCKET = 100


def ordered(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the order of their keys (of so many bits), and the keys in order. Sorting numbers that carry their position is faster than an indirect sort."""
    place = int(len(key)).bit_length()
    if bits + place > 63 or len(key) < BUCKET:
        order = np.argsort(key, kind="stable")
        return order, key[order]
    both = np.sort((key << place) | np.arange(len(key)))
    return both & ((1 << place) - 1), both >> place


def doubled(t: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Suffixes of ``t`` in order, by prefix doubling; with ``depth``, only by so many symbols at least."""
    n, step = len(t), 1
    rank = t.astype(np.int64)
    while True:
        base = int(rank.max()) + 2
        key = rank * base
        key[:n - step] += rank[step:] + 1
        order, key = ordered(key, 2 * base.bit_length())
        rank[order] = np.cumsum(np.append(False, key[1:] != key[:-1]))
        step *= 2
        if rank[order[-1]] == n - 1 or step >= (n if depth is None else min(n, depth)):
            return order


def first_symbols(code: np.ndarray, bits: int, depth: int) -> np.ndarray:
    """The first ``depth`` symbols (of so many bits) of every suffix as one number, made of powers of two of them."""
    n, taken, width = len(code), 0, 1
    key, part = np.zeros(n, np.int64), np.zeros(n + depth, np.int64)
    part[:n] = code
    while True:
        if depth & width:
            key <<= width * bits
            key |= part[taken:taken + n]
            taken += width
        if taken == depth:
            return key
        longer = part[:-width] << width * bits
        longer |= part[width:]
        part, width = longer, 2 * width


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Positions of all suffixes in order. ``t``: small numbers, the last one smaller than all others and found only there."""
    n = len(t)
    used = np.zeros(int(t.max()) + 1, bool)
    used[t] = True
    code = np.cumsum(used)
    bits, place = int(code[-1]).bit_length(), n.bit_length()
    depth = max(1, (62 - place) // bits)
    order, key = ordered(first_symbols(code[t], bits, depth), depth * bits)
    # A suffix has the first place of those that are tied with it as its rank.
    rank, tied, at = np.empty(n, np.int64), np.arange(n), order.copy()
    while True:
        new = np.ones(len(key) + 1, bool)
        np.not_equal(key[1:], key[:-1], out=new[1:-1])
        rank[at] = np.maximum.accumulate(tied * new[:-1])
        live = np.flatnonzero(~(new[:-1] & new[1:]))
        if not len(live):
            return order
        # No tied suffix ends within ``depth`` symbols: the last symbol is found once.
        tied, at, group = tied[live], at[live], np.cumsum(new[live])
        by, key = ordered((group << place) | rank[at + depth], int(group[-1]).bit_length() + place)
        at = at[by]
        order[tied] = at
        depth *= 2


def permuted_prefixes(data: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each position, how long a prefix its suffix shares with the suffix before it in ``sa``. The last byte is found only there.

    Only positions whose preceding byte differs from that of the other suffix are compared, eight bytes at a time; at every other
    position the prefix ends where that of the position before does.
    """
    n = len(sa)
    before = np.empty(n, np.int64)
    before[sa[1:]], before[sa[0]] = sa[:-1], -1
    left = np.empty(n, np.int16)
    left[1:], left[0] = data[:-1], -1
    start = left[before] != left
    start[sa[0]] = False
    i = np.flatnonzero(start)
    a, b, live, eight = i, before[i], np.arange(len(i)), words8(data).copy()
    # Ends of the shared prefixes: they never fall from one position to the next.
    end = i.copy()
    while len(live):
        x = eight[a] ^ eight[b]
        same = x == 0
        x &= ~x + np.uint64(1)
        x -= np.uint64(1)
        end[live] += np.bitwise_count(x) >> 3
        live = live[same]
        a, b = a[same] + 8, b[same] + 8
    far = np.zeros(n, np.int64)
    far[i], far[sa[0]] = end, sa[0]
    np.maximum.accumulate(far, out=far)
    far -= np.arange(n)
    return far


def least_ids(data: np.ndarray, lengths: np.ndarray, ids: np.ndarray, window: int) -> np.ndarray:
    """For every window of every segment, the smallest id of all segments that hold the same bytes.

    ``data``: the segments' bytes one after the other; ``ids``: each segment's id; each segment has at least one window.
    """
    with reused_memory():
        return _least_ids(data, lengths, ids, window)


def _least_ids(data: np.ndarray, lengths: np.ndarray, ids: np.ndarray, window: int) -> np.ndarray:
    ends = np.cumsum(lengths + 1) - 1
    inside = np.ones(len(data) + len(lengths) + 1, bool)
    inside[ends], inside[-1] = False, False
    # Bytes that no UTF-8 text holds stand for the separators and the end; as symbols they are the smallest ones.
    raw = np.full(len(inside), 0xFF, np.uint8)
    raw[inside] = data
    raw[-1] = 0xFE
    sa = suffix_array(raw + np.uint8(2))
    shared = permuted_prefixes(raw, sa)
    # Positions where a window starts, and the id of the segment of each.
    starts = inside
    for back in range(window):
        starts[ends - back] = False
    id_at = np.append(np.repeat(ids, lengths + 1), 0)
    at = np.flatnonzero(starts[sa])
    order = sa[at]
    # The shared prefix with the window before in order is the least of all values in between.
    low = np.minimum.reduceat(shared[sa[:at[-1] + 1]], np.append(at[:1] * 0, at[:-1] + 1)) if len(at) else at
    cut = np.flatnonzero(np.append(True, low[1:] < window)) if len(order) else order
    least = np.minimum.reduceat(id_at[order], cut) if len(order) else ids[:0]
    out = np.empty(len(raw), np.int64)
    out[order] = np.repeat(least, np.diff(np.append(cut, len(order))))
    return out[starts]


def cut_repeated_bytes(docs: DataFrame, window: int = 50, characters: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Cuts the bytes of strings of ``window`` bytes that also start in a document with a smaller id; see ``repeats.cut_repeats``."""
    return cut_repeats(docs, Units(words=False, window=window, gram=max(8, (window // 2) // 8 * 8)), least_ids, characters, keep)
