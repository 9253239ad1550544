"""Benchmark passages inside documents, by Wu-Manber search for many patterns at once.

A pattern is the text of one window of item words, `` w1 w2 ... ``, with a space at both ends. A table of shifts by
the last bytes at a position tells how far the search may move on without missing a pattern; where the shift is zero,
the patterns whose suffix hashes to the same bucket are compared byte by byte. All documents of a batch are one text,
searched by many lanes in step, so each step is a few numpy calls.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.llm.batches import column, flat, pieces, ranges, words8
from corpusloom.session import written

# Benchmark text searched for at once: the tables made of it take about 60 times as much memory in each Python worker.
BLOCK_BYTES = 1 << 20
LANE = 512
HASH_BITS = 20
MIX = np.uint64(0x9E3779B97F4A7C15)
SPACE, END = 32, 10
FOUND = ("n_words bigint, spans array<struct<first:bigint,last:bigint>>, items array<string>")


def _byte_table() -> np.ndarray:
    """Word bytes with A-Z in lower case; every other byte is a space."""
    table = np.full(256, SPACE, np.uint8)
    table[0x80:] = np.arange(0x80, 256)
    for first, last in (("0", "9"), ("a", "z")):
        table[ord(first):ord(last) + 1] = np.arange(ord(first), ord(last) + 1)
    table[ord("A"):ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
    return table


TABLE = _byte_table()


def normal(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Each text as `` w1 w2 ... \\n`` with single spaces, all in one array that begins with an end mark."""
    n = len(offsets) - 1
    out = np.full(len(data) + 3 * n + 1, SPACE, np.uint8)
    out[0] = END
    data = TABLE[data]
    at = 1
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        out[at + 1:at + 1 + b - a] = data[a:b]
        at += b - a + 3
        out[at - 1] = END
    space = out == SPACE
    space[1:] &= space[:-1].copy()
    space[0] = False
    return out[~space]


def windows(text: str | None, size: int) -> list[str]:
    """The patterns of one item: its runs of ``size`` words, or all its words if there are fewer."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    words = normal(raw, np.array([0, len(raw)]))[1:-1].tobytes().split()
    words = [w.decode("utf-8", "surrogatepass") for w in words]
    if not words:
        return []
    return [f" {' '.join(words[i:i + size])} " for i in range(max(1, len(words) - size + 1))]


class Patterns:
    """Patterns of about the same length with their shift table and their buckets."""

    def __init__(self, patterns: list[bytes], numbers: list[int]):
        order = sorted(range(len(patterns)), key=lambda i: patterns[i])
        self.numbers = np.array([numbers[i] for i in order], np.int64)
        patterns = [patterns[i] for i in order]
        self.lengths = np.array([len(p) for p in patterns], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.data = words8(np.frombuffer(b"".join(patterns), np.uint8))
        self.least = m = int(self.lengths.min())
        # A block long enough that a text position seldom matches one of all patterns' blocks by chance.
        self.block = b = max(1, min(m, 8, int(np.ceil(np.log2(2.0 * m * len(patterns) + 1) / 2))))
        self.mask = np.uint64((1 << 8 * b) - 1)
        shift = np.full(1 << HASH_BITS, m - b + 1, np.uint8 if m < 250 else np.int32)
        for back in range(m - b, -1, -1):
            shift[self.hashed(self.data[self.starts + (m - b - back)] & self.mask)] = back
        self.shift = shift
        suffix = self.data[self.starts + (m - b)] & self.mask
        self.order = np.argsort(suffix, kind="stable")
        self.suffix = suffix[self.order]

    @staticmethod
    def hashed(block: np.ndarray) -> np.ndarray:
        return (block * MIX) >> np.uint64(64 - HASH_BITS)

    def find(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where patterns begin in ``text``, and which: ``text`` is what ``words8`` gives."""
        n, m, b = len(text) - 1, self.least, self.block
        at = np.arange(0, n - m + 1, LANE, dtype=np.int64)
        stop = np.minimum(at + LANE, n - m + 1)
        hits: list[np.ndarray] = []
        while len(at):
            move = self.shift[self.hashed(text[at + (m - b)] & self.mask)]
            still = move == 0
            if still.any():
                hits.append(at[still])
            at = at + np.maximum(move, 1)
            inside = at < stop
            if not inside.all():
                at, stop = at[inside], stop[inside]
        if not hits:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.concatenate(hits)
        block = text[at + (m - b)] & self.mask
        low, high = np.searchsorted(self.suffix, block, "left"), np.searchsorted(self.suffix, block, "right")
        at, which = np.repeat(at, high - low), self.order[ranges(low, high - low)]
        inside = at + self.lengths[which] <= n
        at, which = at[inside], which[inside]
        done = 0
        longest = int(self.lengths[which].max()) if len(which) else 0
        while done < longest and len(at):
            left = self.lengths[which] - done
            mask = np.where(left >= 8, ~np.uint64(0), (np.uint64(1) << (8 * np.clip(left, 0, 7)).astype(np.uint64)) - np.uint64(1))
            here = np.minimum(at + done, n)
            there = np.minimum(self.starts[which] + done, len(self.data) - 1)
            same = ((text[here] ^ self.data[there]) & mask) == 0
            at, which = at[same], which[same]
            done += 8
        return at, self.numbers[which]


class Search:
    """All patterns of a block of items."""

    def __init__(self, items: list[tuple[str, str | None]], size: int):
        of: dict[str, set[str]] = defaultdict(set)
        for item, text in items:
            for pattern in windows(text, size):
                of[pattern].add(item)
        self.items = [sorted(found) for found in of.values()]
        self.n_words = np.array([p.count(" ") - 1 for p in of], np.int64)
        groups: dict[int, list[tuple[bytes, int]]] = defaultdict(list)
        # One very short pattern would hold all shifts small; patterns are searched with others of like length.
        for i, pattern in enumerate(of):
            raw = pattern.encode("utf-8", "surrogatepass")
            groups[len(raw).bit_length() if len(raw) < 32 else 6].append((raw, i))
        self.groups = [Patterns([p for p, _ in g], [i for _, i in g]) for g in groups.values()]

    def run(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[list[dict]], list[list[str]]]:
        n = len(offsets) - 1
        text = normal(data, offsets)
        ends = np.flatnonzero(text == END)
        # A word begins behind every space but the last of a text.
        spaces = np.flatnonzero(text == SPACE)
        spaces = spaces[text[np.minimum(spaces + 1, len(text) - 1)] != END]
        before = np.searchsorted(spaces, ends)
        n_words = np.diff(before)
        spans: list[list[dict]] = [[] for _ in range(n)]
        items: list[list[str]] = [[] for _ in range(n)]
        view = words8(text)
        found = [g.find(view) for g in self.groups]
        if found and sum(len(at) for at, _ in found):
            at, which = (np.concatenate([f[i] for f in found]) for i in (0, 1))
            doc = np.searchsorted(ends, at) - 1
            first = np.searchsorted(spaces, at) - before[doc]
            last = first + self.n_words[which] - 1
            order = np.lexsort((last, first, doc))
            for d, a, b in zip(doc[order].tolist(), first[order].tolist(), last[order].tolist(), strict=True):
                if spans[d] and a <= spans[d][-1]["last"] + 1:
                    spans[d][-1]["last"] = max(spans[d][-1]["last"], b)
                else:
                    spans[d].append({"first": a, "last": b})
            named: dict[int, set[str]] = defaultdict(set)
            for pair in np.unique(doc * len(self.items) + which).tolist():
                named[pair // len(self.items)].update(self.items[pair % len(self.items)])
            for d, names in named.items():
                items[d] = sorted(names)
        return n_words, spans, items


def _scan(docs: DataFrame, items: list[tuple[str, str | None]], window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(items, window)
        kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
        for batch in pieces(batches, "_text"):
            n_words, spans, names = search.run(*flat(column(batch, "_text")))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(batch.num_columns - 1)), pa.array(n_words, pa.int64()), pa.array(spans, kind),
                 pa.array(names, pa.list_(pa.string()))], [*batch.schema.names[:-1], "n_words", "spans", "items"])

    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema[:-1])
    return docs.mapInArrow(run, f"{keys}, {FOUND}")


def _joined(spans: Column) -> Column:
    """Spans of several blocks, sorted, with those that touch made one."""
    ordered = F.array_sort(F.flatten(spans))

    def add(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.struct(last["first"].alias("first"), F.greatest(last["last"], x["last"]).alias("last"))
        return (F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["last"] >= x["first"] - 1),
                       F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(longer)))
                .otherwise(F.concat(done, F.array(x))))

    return F.aggregate(ordered, F.slice(ordered, 1, 0), add)


def find_passages(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES,
                  keep: tuple[str, ...] = ()) -> DataFrame:
    """Occurrences of benchmark windows in documents.

    ``docs``: ``doc_id``, ``text``; ``benchmark``: ``item_id``, ``text``; other columns are ignored. Returns per row of
    ``docs``: ``doc_id``, the columns named in ``keep``, ``n_words``, ``spans`` (array of first and last word of each run of hit words, in order),
    ``items`` (ids of the items with occurring windows, as sorted strings). A null or empty text has no words and no
    hits; items with a null id or without words are passed over; repeated rows count as one item, or give one row each.

    The benchmark is searched for in blocks of ``block_bytes`` of text, each read by the driver in turn; documents
    are scanned once for each block and shuffled only if there are several.
    """
    docs = docs.select("doc_id", *keep, F.col("text").alias("_text"))
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").filter("item_id is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    if blocks == 1:
        return _scan(docs, [tuple(r) for r in items.collect()], window)
    keyed = written(docs.withColumn("_row", F.monotonically_increasing_id()), "passages")
    narrow = keyed.select("_row", "_text")
    found = None
    for block in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        one = _scan(narrow, [tuple(r) for r in part.collect()], window)
        found = one if found is None else found.unionByName(one)
    merged = found.groupBy("_row").agg(
        F.max("n_words").alias("n_words"), F.collect_list("spans").alias("spans"), F.collect_list("items").alias("items"))
    merged = keyed.select("_row", "doc_id", *keep).join(merged, "_row")
    return merged.select("doc_id", *keep, "n_words", _joined(F.col("spans")).alias("spans"),
                         F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"))
