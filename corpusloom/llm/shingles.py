"""Words of texts and hashes of word sequences, for whole batches at once."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import xxhash

from corpusloom.llm.batches import words8

MIX = np.uint64(0x9E3779B97F4A7C15)
MIX2 = np.uint64(0xD6E8FEB86659FD93)
FACTOR = 0xA0761D6478BD642F | 1
SHIFT = np.uint64(32)
# Bytes from which a word is hashed by itself.
LONG_WORD = 256


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers; one to one."""
    x = (x ^ (x >> SHIFT)) * MIX2
    x = (x ^ (x >> SHIFT)) * MIX2
    return x ^ (x >> SHIFT)


@lru_cache(maxsize=2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """FACTOR to the powers 0..n-1 and to 0..-(n-1), modulo 2**64."""
    out = []
    for factor in (FACTOR, pow(FACTOR, -1, 1 << 64)):
        p = np.ones(n, np.uint64)
        if n > 1:
            p[1:] = np.uint64(factor)
            np.multiply.accumulate(p, out=p)
        out.append(p)
    return out[0], out[1]


def lower_table(lower: bool) -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    if lower:
        table[ord("A"):ord("Z") + 1] += 32
    return table


SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word (run of bytes other than 20 and 09-0D), and the number of words before each text, with the total last."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~SPACES[data]
    # A text's edge cuts a word like a space does.
    start = word.copy()
    start[1:] &= ~word[:-1]
    edge = offsets[:-1][offsets[:-1] < len(data)]
    start[edge] = word[edge]
    end = word.copy()
    end[:-1] &= ~word[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    end[last] = word[last]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """A 64-bit hash of the bytes of every word, A-Z in lower case if asked for.

    Eight bytes at a time are mixed in by one-to-one steps that are not linear, so words of equal length up to eight bytes never collide and no
    pattern of letters makes longer ones do so.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    if lower:
        data = lower_table(True)[data]
    eight, n = words8(data), ends - starts
    h = mixed(n.astype(np.uint64) * MIX + np.uint64(FACTOR))
    live = np.arange(len(starts))
    for done in range(0, LONG_WORD, 8):
        left = n[live] - done
        value = eight[starts[live] + done]
        short = left < 8
        value[short] &= (np.uint64(1) << (left[short] * 8).astype(np.uint64)) - np.uint64(1)
        h[live] = mixed((h[live] ^ value) * np.uint64(FACTOR))
        live = live[left > 8]
        if not len(live):
            return h
    for i in live.tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[starts[i]:ends[i]].tobytes())
    return h


def sequence_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of ``size`` consecutive words from every position on; positions too near the end are left out."""
    n = max(len(words) - size + 1, 0)
    h = np.zeros(n, np.uint64)
    for i in range(size):
        h = mixed(h * np.uint64(FACTOR) + words[i:i + n] + np.uint64(i))
    return h


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int, lower: bool = True) -> list[np.ndarray]:
    """Sorted distinct hashes of the ``size``-word shingles of each text; of fewer words, one for the whole sequence."""
    starts, ends, first = word_bounds(data, offsets)
    words = word_hashes(data, starts, ends, lower)
    all_hashes = sequence_hashes(words, size)
    sets = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            x = np.sort(all_hashes[a:b - size + 1])
            sets.append(x[np.append(True, x[1:] != x[:-1])])
        elif b > a:
            sets.append(sequence_hashes(words[a:b], b - a) ^ np.uint64(b - a))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets
