"""Byte-level BPE encoding and decoding with the vocabulary of a tokenizer file.

Texts are cut into words by the classes of their characters, for a whole batch at once, and equal words are brought together by hashes
of their bytes; hashes only propose, bytes decide. The merges run in numpy rounds over the symbols of many words: one flat array holds the
symbols, another the ranks of their pairs, every word merges its lowest-ranked pair, and only pairs beside a merge are looked up
again, by binary search over the sorted pair keys.
A worker keeps the ids of words it has met; the store is emptied when it is full, which changes speed and no result.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from corpusloom.llm.batches import column, flat, pieces, ranges, reused_memory, words8
from corpusloom.llm.repeats import LONG, gathered
from corpusloom.llm.shingles import word_hashes

# Fixed value: the pattern of byte-level BPE that cuts a text into words before merging.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NEVER = np.iinfo(np.int64).max
STORE_WORDS = 500_000
# Classes of characters.
SPACE, LETTER, NUMBER, OTHER, UNKNOWN = range(5)


def byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Bpe:
    """A vocabulary with its sorted pair keys. Built once in each Python worker."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        vocabulary, merges = said["model"]["vocab"], said["model"]["merges"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        added = {x["content"]: x["id"] for x in said["added_tokens"]}
        to_byte = byte_characters()
        size = max([*vocabulary.values(), *added.values()]) + 1
        content: list[bytes] = [b""] * size
        for token, i in vocabulary.items():
            content[i] = bytes(to_byte[c] for c in token) if all(c in to_byte for c in token) else token.encode()
        for token, i in added.items():
            content[i] = token.encode()
        self.size = size
        self.token_bytes = np.frombuffer(b"".join(content), np.uint8)
        self.token_lengths = np.array([len(x) for x in content], np.int64)
        self.token_starts = np.cumsum(self.token_lengths) - self.token_lengths
        self.of_byte = np.zeros(256, np.int64)
        for c, b in to_byte.items():
            self.of_byte[b] = vocabulary[c]
        keys = np.array([vocabulary[a] * size + vocabulary[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocabulary[a + b] for a, b in merges], np.int64)
        self.kinds = np.full(0x110000, UNKNOWN, np.uint8)
        self.classify(np.arange(128))
        self.added = added
        self.split = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True)) + ")") if added else None
        self.clear()

    def clear(self) -> None:
        """Empties the store: hashes of words in order with the number of each word; of each word its bytes and its ids."""
        self.known, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.data, self.begins, self.sizes = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.starts, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def classify(self, codes: np.ndarray) -> None:
        """Looks up the classes of characters that were not met before."""
        for code in codes.tolist():
            c = chr(code)
            self.kinds[code] = SPACE if regex.match(r"\s", c) else LETTER if regex.match(r"\p{L}", c) else NUMBER if regex.match(r"\p{N}", c) else OTHER

    def words(self, codes: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Where the words of ``WORDS`` start in the characters of texts that begin at ``edges``; every character is in a word."""
        n = len(codes)
        kind = self.kinds[codes]
        if (kind == UNKNOWN).any():
            self.classify(np.unique(codes[kind == UNKNOWN]))
            kind = self.kinds[codes]
        mark = np.ones(n + 1, bool)
        np.not_equal(kind[1:], kind[:-1], out=mark[1:-1])
        mark[edges] = True
        run = np.flatnonzero(mark)
        first, end, kind = run[:-1], run[1:], kind[run[:-1]]
        # Runs that another one of the same text follows.
        inner = np.ones(n + 1, bool)
        inner[edges], inner[n] = False, False
        inner = inner[end]
        blank = inner & (kind == SPACE)
        # The last of several blanks stands alone, or goes with the run behind it if it is U+0020.
        mark[end[blank] - 1] = True
        joins = np.flatnonzero(blank)[codes[end[blank] - 1] == 0x20] + 1
        mark[first[joins]] = False
        # An apostrophe with one of the endings 's 't 'm 'd 're 've 'll is a word.
        short = np.flatnonzero((kind[:-1] == OTHER) & (kind[1:] == LETTER) & inner[:-1] & (end[:-1] - first[:-1] == 1) & (codes[first[:-1]] == 0x27) & mark[first[:-1]])
        if len(short):
            at, room = first[short], end[short + 1] - end[short]
            a, b = codes[at + 1], np.where(room > 1, codes[np.minimum(at + 2, n - 1)], 0)
            one = np.isin(a, [ord(c) for c in "stmd"])
            two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
            mark[at[one | two] + 1] = False
            mark[at[one] + 2] = True
            mark[at[two] + 3] = True
        return np.flatnonzero(mark[:-1])

    def ranked(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of symbols."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER)

    def merge(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words (their bytes one after the other) in one flat array, and the number of ids of each word."""
        symbols = self.of_byte[data]
        word = np.repeat(np.arange(len(sizes)), sizes)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank = np.full(len(symbols), NEVER)
        inside = np.flatnonzero(word[1:] == word[:-1])
        rank[inside] = self.ranked(symbols[inside], symbols[inside + 1])
        while len(symbols) > 1:
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            lowest = np.minimum.reduceat(rank, first)
            count = np.diff(np.append(first, len(symbols)))
            keep = np.repeat(lowest != NEVER, count)
            if not keep.all():
                done.append((symbols[~keep], word[~keep]))
            hit = np.flatnonzero((rank == np.repeat(lowest, count)) & keep)
            # Of pairs that overlap, as in "aaa", every second one from the left is merged.
            run = np.flatnonzero(np.diff(hit, prepend=-2) != 1)
            hit = hit[(np.arange(len(hit)) - np.repeat(run, np.diff(np.append(run, len(hit))))) % 2 == 0]
            symbols[hit] = self.merged[rank[hit]]
            keep[hit + 1] = False
            hit = np.cumsum(keep)[hit] - 1
            symbols, word, rank = symbols[keep], word[keep], rank[keep]
            # Only the pairs on both sides of a merged one are new.
            near = np.concatenate([hit, hit[hit > 0] - 1])
            rank[hit] = NEVER
            near = near[near < len(word) - 1]
            near = near[word[near] == word[near + 1]]
            rank[near] = self.ranked(symbols[near], symbols[near + 1])
        done.append((symbols, word))
        symbols, word = np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])
        order = np.argsort(word, kind="stable")
        return symbols[order].astype(np.int32), np.bincount(word, minlength=len(sizes)).astype(np.int64)

    def learn(self, data: np.ndarray, begins: np.ndarray, sizes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Adds words to the store; their numbers."""
        data = gathered(data, begins, sizes)
        ids, counts = self.merge(data, sizes)
        number = np.arange(len(sizes)) + len(self.sizes)
        self.begins = np.append(self.begins, np.cumsum(sizes) - sizes + len(self.data))
        self.starts = np.append(self.starts, np.cumsum(counts) - counts + len(self.ids))
        self.data, self.sizes = np.append(self.data, data), np.append(self.sizes, sizes)
        self.ids, self.lengths = np.append(self.ids, ids), np.append(self.lengths, counts)
        # Of different words with one hash the first one is found again.
        known, numbers = np.append(self.known, hashes), np.append(self.number, number)
        order = np.argsort(known, kind="stable")
        order = order[np.append(True, known[order[1:]] != known[order[:-1]])]
        self.known, self.number = known[order], numbers[order]
        return number

    def numbered(self, data: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The number of each word in the store, to which new ones are added."""
        hashes = word_hashes(data, begins, begins + sizes, lower=False)
        order = np.argsort(hashes)
        new = np.append(True, hashes[order[1:]] != hashes[order[:-1]])
        of = np.empty(len(order), np.int64)
        of[order] = np.cumsum(new) - 1
        lead = order[new]
        odd = np.flatnonzero(~same_bytes(data, begins, data, begins[lead[of]], sizes, sizes[lead[of]]))
        if len(odd):
            # Different words of one hash are told apart by their bytes.
            apart: dict[bytes, int] = {}
            for i in odd.tolist():
                of[i] = len(lead) + apart.setdefault(data[begins[i]:begins[i] + sizes[i]].tobytes(), len(apart))
            lead = np.append(lead, odd[np.unique(of[odd], return_index=True)[1]])
        number = np.full(len(lead), -1)
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, hashes[lead]), len(self.known) - 1)
            found = np.flatnonzero(self.known[at] == hashes[lead])
            old, own = self.number[at[found]], lead[found]
            same = same_bytes(self.data, self.begins[old], data, begins[own], self.sizes[old], sizes[own])
            number[found[same]] = old[same]
        new = np.flatnonzero(number < 0)
        if len(new):
            number[new] = self.learn(data, begins[lead[new]], sizes[lead[new]], hashes[lead[new]])
        return number[of]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one flat array, and the number of ids of each text."""
        if len(self.sizes) > STORE_WORDS:
            self.clear()
        parts, owner, special = [], [], []
        for t, text in enumerate(texts):
            if self.split is not None and any(token in text for token in self.added):
                for part in self.split.split(text):
                    if part in self.added:
                        special.append((len(parts), self.added[part]))
                        part = ""
                    parts.append(part)
                    owner.append(t)
            else:
                parts.append(text)
                owner.append(t)
        joined = "".join(parts)
        lengths = np.array([len(x) for x in parts], np.int64)
        edges = np.cumsum(lengths) - lengths
        data = np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8)
        if len(data):
            codes = data if len(data) == len(joined) else np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
            first = self.words(codes, edges[lengths > 0])
            part = np.flatnonzero(lengths > 0)
            part = np.repeat(part, np.diff(np.append(np.searchsorted(first, edges[part]), len(first))))
            begins = np.append(first, len(codes))
            if len(data) != len(codes):
                width = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
                begins = np.concatenate([[0], np.cumsum(width)])[begins]
            at = self.numbered(data, begins[:-1], np.diff(begins))
            starts, counts = self.starts[at], self.lengths[at]
        else:
            part = starts = counts = np.zeros(0, np.int64)
        table = self.ids
        if special:
            where, ids = np.array([p for p, _ in special]), np.array([i for _, i in special], np.int32)
            order = np.argsort(np.append(part, where), kind="stable")
            part = np.append(part, where)[order]
            starts, counts = np.append(starts, len(table) + np.arange(len(ids)))[order], np.append(counts, np.ones(len(ids), np.int64))[order]
            table = np.append(table, ids)
        total = np.bincount(np.array(owner, np.int64)[part], counts, len(texts)).astype(np.int64)
        return table[ranges(starts, counts)], total

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """The text of each list of ids; ids outside the vocabulary have no text, broken UTF-8 becomes U+FFFD."""
        ids = np.asarray(ids, np.int64)
        known = (ids >= 0) & (ids < self.size)
        at = np.where(known, ids, 0)
        lengths = np.where(known, self.token_lengths[at], 0)
        data = self.token_bytes[ranges(self.token_starts[at], lengths)]
        before = np.concatenate([[0], np.cumsum(lengths)])
        offsets = before[np.concatenate([[0], np.cumsum(counts)])]
        raw = data.tobytes()
        try:
            raw.decode()
            whole = not len(raw) or not ((data[np.minimum(offsets, len(data) - 1)] & 0xC0) == 0x80).any()
        except UnicodeDecodeError:
            whole = False
        if whole:
            return pa.LargeStringArray.from_buffers(len(counts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw)).cast(pa.string())
        return pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.string())


def same_bytes(a: np.ndarray, begin_a: np.ndarray, b: np.ndarray, begin_b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Whether the words of ``a`` and those of ``b`` have the same bytes, eight at a time."""
    out = size_a == size_b
    for i in np.flatnonzero(out & (size_a > LONG)).tolist():
        out[i] = np.array_equal(a[begin_a[i]:begin_a[i] + size_a[i]], b[begin_b[i]:begin_b[i] + size_b[i]])
    live = np.flatnonzero(out & (size_a <= LONG))
    eight_a, eight_b, done = words8(a), words8(b), 0
    while len(live):
        left = size_a[live] - done
        x = eight_a[begin_a[live] + done] ^ eight_b[begin_b[live] + done]
        short = left < 8
        x[short] &= (np.uint64(1) << (left[short] * 8).astype(np.uint64)) - np.uint64(1)
        out[live[x != 0]] = False
        live = live[(x == 0) & (left > 8)]
        done += 8
    return out


_loaded: dict[str, Bpe] = {}


def _bpe(path: str) -> Bpe:
    """The vocabulary as this worker has loaded it; a function that travels with a job has its own copy of this module's names."""
    import importlib

    here = importlib.import_module("corpusloom.llm.bpe")
    if path not in here._loaded:
        here._loaded[path] = here.Bpe(path)
    return here._loaded[path]


def _lists(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids, pa.int32()))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id``, ``ids`` (token ids of the whole ``text``). One row per row; a null or empty text has no ids.

    Special tokens that stand in a text are recognised, none is added. Other columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(path)
        for batch in pieces(batches, most=2 << 20):
            with reused_memory():
                ids, counts = bpe.encode([t or "" for t in column(batch, "text").to_pylist()])
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), _lists(ids, counts)], ["doc_id", "ids"])

    docs = docs.select("doc_id", "text")
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """``doc_id``, ``text`` from ``doc_id``, ``ids``. A null list is an empty text, as are null ids and ids that are not in the vocabulary."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(path)
        for batch in batches:
            lists = column(batch, "ids").fill_null([]) if column(batch, "ids").null_count else column(batch, "ids")
            counts = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            ids = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), bpe.decode(ids, counts)], ["doc_id", "text"])

    tokens = tokens.select("doc_id", "ids")
    return tokens.mapInArrow(run, f"doc_id {tokens.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id``, ``ids``, ``decoded``: what ``encode`` and then ``decode`` give, in one pass through Python."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(path)
        for batch in pieces(batches, most=2 << 20):
            with reused_memory():
                ids, counts = bpe.encode([t or "" for t in column(batch, "text").to_pylist()])
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), _lists(ids, counts), bpe.decode(ids, counts)],
                                             ["doc_id", "ids", "decoded"])

    docs = docs.select("doc_id", "text")
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string")
