"""Passages that documents share: every window of symbols that also starts in a document with a smaller id.

Symbols are the bytes or the words of a text. The job finds the windows that repeat, in three shuffles:

1. Marks. Each window has a *minimum*, the smallest hash of its grams; equal windows have equal minima. Runs of windows with one
   minimum are its occurrences. Each task packs the minima of its documents into one row for each shard of hash values; a shard
   reports those that occur in two documents at least. A minimum that occurs twice inside a task's pack is reported there at
   once and sent on only once, with the number of symbols of its runs. A shard also reports the minima whose runs have more symbols
   than a shard of step 2 should hold.
2. Shards. Marked runs are cut out as segments and sent to the shard of their minimum, where all equal windows meet; many shards travel in bundles. Inside a pack,
   equal segments are sent once with their smallest id; the others are repeats already. The shard's index (a suffix
   array, or an FM-index) says for each window the smallest id that holds it. Each window of the runs of a minimum that is too large for a shard (a passage
   shorter than a window, in many documents of different context) is a segment of its own, sent to the shard of the window's hash and solved there like others.
   Hashes only bring segments together: equal ones are found by comparing their symbols.
3. Cuts. The runs of repeated windows go back to their documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from corpusloom.llm.batches import column, flat, pieces, ranges, reused_memory, words8
from corpusloom.llm.shingles import FACTOR, MIX, mixed, powers, word_bounds, word_hashes
from corpusloom.session import released, written

PACK_RUNS = 1_000_000
PACK_SYMBOLS = 4 << 20
# Text of one shard of minima, and symbols of one shard of segments.
MARK_BYTES = 16 << 20
SHARD_SYMBOLS = 1 << 19
PIECE = 1 << 20
CHUNK = 1 << 14
# Shards that share a row of a pack, where there are more than so many of them: bytes of their segments at most.
SHARD_ROWS = 64
BUNDLE_BYTES = 16 << 20
# Symbols from which two segments are compared by themselves.
LONG = 1024
Solve = Callable[[np.ndarray, np.ndarray, np.ndarray, int], np.ndarray]


@dataclass(frozen=True)
class Units:
    """What a window consists of: ``window`` symbols, compared first by grams of ``gram`` symbols (bytes: a multiple of 8)."""

    words: bool
    window: int
    gram: int

    @property
    def usual(self) -> int:
        """Symbols of the longest run whose minimum is the hash of one gram."""
        return 2 * self.window - self.gram

    def symbols(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of all texts (bytes, or hashes of words), and the number of symbols before each text."""
        if not self.words:
            return data, offsets
        starts, ends, first = word_bounds(data, offsets)
        return word_hashes(data, starts, ends, lower=False), first

    def minima(self, symbols: np.ndarray) -> np.ndarray:
        """The minimum of the window at each position."""
        n, g = len(symbols) - self.window + 1, self.gram
        if n <= 0:
            return np.zeros(0, np.uint64)
        if n > CHUNK:
            # In stretches whose hashes stay in a core's cache.
            return np.concatenate([self.minima(symbols[a:a + CHUNK + self.window - 1]) for a in range(0, n, CHUNK)])
        m = len(symbols) - g + 1
        # One copy in place: numbers that lie at any byte are slow to read again and again.
        values, step = (symbols, 1) if self.words else (words8(symbols).copy(), 8)
        h, high = np.zeros(m, np.uint64), np.empty(m, np.uint64)
        for i in range(0, g, step):
            h ^= values[i:i + m]
            h *= np.uint64(FACTOR)
            h ^= np.right_shift(h, np.uint64(29), out=high)
        h *= MIX
        h ^= np.right_shift(h, np.uint64(32), out=high)
        h *= np.uint64(FACTOR)
        width, want = 1, self.window - g + 1
        while 2 * width <= want:
            h = np.minimum(h[:len(h) - width], h[width:])
            width *= 2
        return np.minimum(h[:n], h[want - width:want - width + n])

    def runs(self, symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of every run of windows with one minimum: the minimum, its text, its number in the text, first symbol and windows."""
        h = self.minima(symbols)
        a, b = first[:-1], first[1:] - self.window + 1
        texts = np.flatnonzero(b > a)
        if not len(texts):
            return h[:0], texts, texts, texts, texts
        change = np.ones(len(h), bool)
        np.not_equal(h[1:], h[:-1], out=change[1:])
        change[a[texts]] = True
        change[np.minimum(b[texts], len(h) - 1)[b[texts] < len(h)]] = True
        starts = np.flatnonzero(change)
        text = np.repeat(texts, np.diff(np.concatenate([[0], np.searchsorted(starts, a[texts[1:]]), [len(starts)]])))
        length = np.diff(np.append(starts, len(h)))
        inside = (starts >= a[text]) & (starts < b[text])
        starts, text, length = starts[inside], text[inside], length[inside]
        new = np.flatnonzero(np.diff(text, prepend=-1))
        number = np.arange(len(text)) - np.repeat(new, np.diff(np.append(new, len(text))))
        # Smallest hashes crowd at the low end; mixed again they fall evenly on the shards.
        return mixed(h[starts]), text, number, starts, length

    def content_hashes(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Hashes that equal segments share; who needs equality compares the symbols too (``same_content``)."""
        if not self.words:
            return word_hashes(symbols, starts, starts + lengths, lower=False)
        up, down = powers(1 << max(20, int(len(symbols)).bit_length()))
        total = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(symbols * up[:len(symbols)], out=total[1:])
        return mixed((total[starts + lengths] - total[starts]) * down[starts] + lengths.astype(np.uint64) * MIX)


def same_content(symbols: np.ndarray, begin: np.ndarray, size: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Segments in an order in which equal ones stand together, ``new`` where a hash differs from the one before: numbers of their groups, none of which holds two contents."""
    first = np.flatnonzero(new)
    number = np.cumsum(new) - 1
    lead = first[number]
    other = np.flatnonzero((lead != np.arange(len(new))) & (size == size[lead]))
    wrong = size != size[lead]
    wrong[other] = ~_equal(symbols, begin[other], begin[lead[other]], size[other])
    if wrong.any():
        # Different contents of one hash: their groups are made anew by the symbols themselves.
        known: dict[tuple[int, bytes], int] = {}
        for i in np.flatnonzero(np.isin(number, number[wrong])).tolist():
            key = int(lead[i]), symbols[begin[i]:begin[i] + size[i]].tobytes()
            number[i] = known.setdefault(key, -1 - len(known))
        number = np.unique(number, return_inverse=True)[1]
    return number


def _equal(symbols: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the segments from ``a`` and from ``b`` on hold the same symbols; bytes are compared by eights."""
    out = np.ones(len(a), bool)
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = np.array_equal(symbols[a[i]:a[i] + size[i]], symbols[b[i]:b[i] + size[i]])
    live = np.flatnonzero(size <= LONG)
    wide = symbols.itemsize == 1
    values, step, done = words8(symbols) if wide else symbols, 8 if wide else 1, 0
    while len(live):
        # The last eight bytes of a segment may overlap those before.
        at = np.minimum(done, size[live] - step) if wide else done
        equal = values[a[live] + at] == values[b[live] + at]
        out[live[~equal]] = False
        done += step
        live = live[equal & (size[live] > done)]
    return out


def gathered(symbols: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The symbols of the segments from ``begin`` on, one after the other."""
    raw, width = symbols.tobytes(), symbols.itemsize
    return np.frombuffer(b"".join([raw[a:b] for a, b in zip((begin * width).tolist(), ((begin + size) * width).tolist(), strict=True)]), symbols.dtype)


MARKED = "shard int, kind int, minimum binary, many binary, weight binary, doc binary, run binary, ids binary, keys binary, pack bigint"
SEGMENTS = "shard int, kind int, data binary, lengths binary, hashes binary, part binary, content binary, doc binary, start binary, size binary, ids binary, keys binary, pack bigint"
FOUND = "pack bigint, doc binary, found binary, ids binary, keys binary"


def _shards(values: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each hash; ascending with the hash."""
    return (((values >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


def _packed(shard: int, kind: int, arrays: list[np.ndarray | None], doc: np.ndarray, ids: np.ndarray, keys: np.ndarray, at: int) -> list:
    """One row; documents are renumbered to those that the row speaks of."""
    used, local = np.unique(doc, return_inverse=True)
    arrays = [*arrays[:at], local.astype(np.int32), *arrays[at:]]
    # Unsigned numbers wrap, so any id will do, negative and very large ones too.
    pack = int(mixed((ids[:1].view(np.uint64) * np.uint64(3) + np.uint64(len(ids))) ^ keys[:1].view(np.uint64)).view(np.int64)[0])
    return [int(shard), kind, *(None if x is None else _squeezed(x) for x in arrays), _squeezed(ids[used]), _squeezed(keys[used]), pack]


def _squeezed(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values.tobytes())


def _batch(rows: list[list], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    fields = [f.strip().split(" ") for f in schema.split(",")]
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)],
                                      [n for n, _ in fields])


def _unpacked(table: pa.Table) -> list[dict]:
    """The rows of a shard, with buffers in place of copies of their bytes."""
    columns = {n: [x.as_buffer() if pa.types.is_binary(x.type) else x.as_py() for x in table[n]] for n in table.column_names}
    return [{n: c[i] for n, c in columns.items()} for i in range(table.num_rows)]


def _numbers(row: dict, name: str, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(row[name]), kind)


def _mark(units: Units, shards: int):
    def pack(held: list[tuple], ids: np.ndarray, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        value, doc, run, weight = (np.concatenate([h[i] for h in held]) for i in range(4))
        some = int(ids[doc[-1]])
        order = np.argsort(value)
        value, doc, run, weight = value[order], doc[order], run[order], weight[order]
        first = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
        many = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
        inside = np.repeat(many, np.diff(np.append(first, len(value))))
        if inside.any():
            # Known to repeat: passed through, dealt out evenly.
            yield _batch([_packed(some % shards, 0, [None, None, None, run[inside].astype(np.int32)], doc[inside], ids, keys, 3)], MARKED)
        send = ~inside
        send[first] = True
        flag = np.zeros(len(value), bool)
        flag[first] = many
        # Symbols of all runs that an entry stands for; 0 for one run of usual length.
        weight = np.where(weight > units.usual, weight, 0)
        weight[first[many]] = np.minimum(np.add.reduceat(np.maximum(weight, units.usual), first), np.iinfo(np.int32).max)[many]
        value, doc, run, flag, weight = value[send], doc[send], run[send], flag[send], weight[send]
        shard = _shards(value, shards)
        cut = np.flatnonzero(np.diff(shard, prepend=-1))
        rows = []
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(shard)], strict=True):
            rows.append(_packed(shard[a], 1, [value[a:b], flag[a:b], weight[a:b].astype(np.int32), run[a:b].astype(np.int32)], doc[a:b], ids, keys, 3))
            if len(rows) == 64:
                yield _batch(rows, MARKED)
                rows = []
        if rows:
            yield _batch(rows, MARKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids, keys, n, size = [], [], [], 0, 0
        for batch in pieces(batches, most=PIECE):
            symbols, first = units.symbols(*flat(column(batch, "text")))
            value, doc, number, _, windows = units.runs(symbols, first)
            held.append((value, doc.astype(np.int32) + np.int32(n), number.astype(np.int32), windows + units.window - 1))
            ids.append(column(batch, "doc_id").to_numpy())
            keys.append(column(batch, "key").to_numpy())
            n, size = n + batch.num_rows, size + len(value)
            if size >= PACK_RUNS:
                yield from pack(held, np.concatenate(ids), np.concatenate(keys))
                held, ids, keys, n, size = [], [], [], 0, 0
        if size:
            yield from pack(held, np.concatenate(ids), np.concatenate(keys))
    return run


def _by_pack(rows: list[dict], doc: np.ndarray, values: np.ndarray, docs_before: list[int]) -> pa.Table:
    """What was found for the documents of each row (``doc`` counts on through the rows), one row for each."""
    order = np.argsort(doc, kind="stable")
    doc, values = doc[order], values[order]
    ends = np.searchsorted(doc, docs_before[1:])
    out, start = [], 0
    for row, before, end in zip(rows, docs_before[:-1], ends.tolist(), strict=True):
        if end > start:
            out.append([row["pack"], _squeezed((doc[start:end] - before).astype(np.int32)), _squeezed(values[start:end]), row["ids"].to_pybytes(), row["keys"].to_pybytes()])
        start = end
    fields = [f.split(" ") for f in FOUND.split(", ")]
    columns = list(zip(*out, strict=True)) or [[]] * len(fields)
    return pa.table({n: pa.array(list(c), pa.int64() if k == "bigint" else pa.binary()) for c, (n, k) in zip(columns, fields, strict=True)})


def _documents_of(name: str, width: int):
    """The rows of one pack as one row for each of its documents."""
    def run(table: pa.Table) -> pa.Table:
        rows = _unpacked(table)
        if rows[0]["pack"] is None:
            # Minima that are too large for a shard; of no document.
            return pa.table({"doc_id": pa.nulls(len(rows), pa.int64()), "key": pa.nulls(len(rows), pa.int64()),
                             name: pa.array([_numbers(r, "found", np.uint64).tobytes() for r in rows], pa.binary())})
        before, ids, keys = _gathered(rows)
        doc = np.concatenate([_numbers(r, "doc", np.int32) + b for r, b in zip(rows, before, strict=False)])
        values = np.concatenate([_numbers(r, "found", np.int32).reshape(-1, width) for r in rows])
        order = np.lexsort((keys[doc], ids[doc]))
        doc, values = doc[order], values[order]
        cut = np.flatnonzero(np.append(True, (ids[doc[1:]] != ids[doc[:-1]]) | (keys[doc[1:]] != keys[doc[:-1]])))
        raw, size = values.astype(np.int32).tobytes(), 4 * width
        ends = [*cut[1:].tolist(), len(doc)]
        return pa.table({"doc_id": pa.array(ids[doc[cut]], pa.int64()), "key": pa.array(keys[doc[cut]], pa.int64()),
                         name: pa.array([raw[a * size:b * size] for a, b in zip(cut.tolist(), ends, strict=True)], pa.binary())})
    return run


def _gathered(rows: list[dict]) -> tuple[list[int], np.ndarray, np.ndarray]:
    ids, keys = [_numbers(r, "ids", np.int64) for r in rows], [_numbers(r, "keys", np.int64) for r in rows]
    before = np.cumsum([0, *(len(i) for i in ids)])
    return before.tolist(), np.concatenate(ids), np.concatenate(keys)


def _repeated(units: Units, most: int):
    """Runs of a shard whose minimum occurs in two documents at least; and, in a row without pack, minima of more than ``most`` symbols."""
    def run(table: pa.Table) -> pa.Table:
        rows = _unpacked(table)
        before, ids, keys = _gathered(rows)
        doc, number, large = [], [], np.zeros((0, 2), np.uint64)
        sent = [(r, b) for r, b in zip(rows, before, strict=False) if r["kind"]]
        if sent:
            value = np.concatenate([_numbers(r, "minimum", np.uint64) for r, _ in sent])
            many = np.concatenate([_numbers(r, "many", bool) for r, _ in sent])
            weight = np.concatenate([_numbers(r, "weight", np.int32) for r, _ in sent])
            d = np.concatenate([_numbers(r, "doc", np.int32) + b for r, b in sent])
            n = np.concatenate([_numbers(r, "run", np.int32) for r, _ in sent])
            order = np.argsort(value)
            value, many, d, n = value[order], many[order], d[order], n[order]
            first = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
            repeated = (np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first)) | np.logical_or.reduceat(many, first)
            keep = np.repeat(repeated, np.diff(np.append(first, len(value))))
            doc.append(d[keep])
            number.append(n[keep])
            symbols = np.add.reduceat(np.maximum(weight[order], units.usual).astype(np.int64), first)
            heavy = repeated & (symbols > most)
            large = np.stack([value[first[heavy]], symbols[heavy].astype(np.uint64)], 1)
        for r, b in zip(rows, before, strict=False):
            if not r["kind"]:
                doc.append(_numbers(r, "doc", np.int32) + b)
                number.append(_numbers(r, "run", np.int32))
        out = _by_pack(rows, np.concatenate(doc), np.concatenate(number), before)
        if len(large):
            out = pa.concat_tables([out, pa.table([[None], [None], [_squeezed(large)], [None], [None]], schema=out.schema)])
        return out
    return run


def _bundle(units: Units, shards: int) -> int:
    """Consecutive shards that travel in one row of a pack: rows grow with the packs alone, not with packs times shards, until a bundle is as large as a task should hold."""
    return max(1, min(shards // SHARD_ROWS, BUNDLE_BYTES // (SHARD_SYMBOLS * (8 if units.words else 1))))


def _segments(units: Units, shards: int, large: np.ndarray):
    bundle = _bundle(units, shards)

    def pack(held: list[tuple], ids: np.ndarray, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        value, content, doc, start, size, symbols = (np.concatenate([h[i] for h in held]) for i in range(6))
        begin = np.cumsum(size) - size
        content = mixed(content ^ mixed(value + size.astype(np.uint64)))
        order = np.lexsort((ids[doc], content, value))
        value, content, doc, start, size, begin = (x[order] for x in (value, content, doc, start, size, begin))
        number = same_content(symbols, begin, size, np.append(True, (value[1:] != value[:-1]) | (content[1:] != content[:-1])))
        if (number[1:] < number[:-1]).any():
            order = np.lexsort((ids[doc], number, value))
            value, content, doc, start, size, begin, number = (x[order] for x in (value, content, doc, start, size, begin, number))
        first = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
        number = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(value))))
        later = ids[doc] > ids[doc[first]][number]
        if later.any():
            by = np.flatnonzero(later)
            yield _batch([_packed(int(content[by[0]] % np.uint64(shards)) // bundle, 0, [None] * 5 + [start[by].astype(np.int32), size[by].astype(np.int32)],
                                  doc[by], ids, keys, 5)], SEGMENTS)
        shard = _shards(value, shards)
        row = shard // bundle
        cut = np.flatnonzero(np.diff(row, prepend=-1))
        symbols, ends = gathered(symbols, begin[first], size[first]), np.concatenate([[0], np.cumsum(size[first])])
        rows, total = [], 0
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(shard)], strict=True):
            x, y = int(number[a]), int(number[b - 1]) + 1
            own = first[x:y]
            send = a + np.flatnonzero(~later[a:b])
            data = symbols[ends[x]:ends[y]]
            rows.append(_packed(row[a], 1, [data, size[own].astype(np.int32), content[own], (shard[own] - row[a] * bundle).astype(np.int32),
                                            (number[send] - x).astype(np.int32), start[send].astype(np.int32), None], doc[send], ids, keys, 5))
            total += data.nbytes
            if total > PIECE:
                yield _batch(rows, SEGMENTS)
                rows, total = [], 0
        if rows:
            yield _batch(rows, SEGMENTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids, keys, n, total = [], [], [], 0, 0
        for batch in pieces(batches, most=PIECE):
            symbols, first = units.symbols(*flat(column(batch, "text")))
            value, doc, number, start, windows = units.runs(symbols, first)
            lists = column(batch, "runs")
            marks, ends = flat(lists.flatten())
            of = np.repeat(np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy()), np.diff(ends) // 4)
            runs = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=batch.num_rows))])
            at = np.unique(marks.view(np.int32) + runs[of])
            by_window = np.isin(value[at], large)
            few, at = at[by_window], at[~by_window]
            # A window of a run that is dealt by window is a segment of its own.
            begin, of = ranges(start[few], windows[few]), np.repeat(few, windows[few])
            place = [(value[at], doc[at], start[at], windows[at] + units.window - 1)]
            if len(few):
                width = np.full(len(begin), units.window)
                place.append((mixed(units.content_hashes(symbols, begin, width) ^ value[of]), doc[of], begin, width))
            for v, d, s, size in place:
                for a, b in _stretches(size, PACK_SYMBOLS):
                    own = slice(a, b)
                    held.append((v[own], units.content_hashes(symbols, s[own], size[own]), d[own] + n, s[own] - first[d[own]], size[own], gathered(symbols, s[own], size[own])))
                    total += int(size[own].sum())
                    if total * (8 if units.words else 1) >= 2 * PACK_SYMBOLS:
                        yield from pack(held, np.concatenate([*ids, column(batch, "doc_id").to_numpy()]), np.concatenate([*keys, column(batch, "key").to_numpy()]))
                        held, total = [], 0
            ids.append(column(batch, "doc_id").to_numpy())
            keys.append(column(batch, "key").to_numpy())
            n += batch.num_rows
            if not held:
                ids, keys, n = [], [], 0
        if held:
            yield from pack(held, np.concatenate(ids), np.concatenate(keys))
    return run


def _stretches(size: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive segments of about ``most`` symbols together."""
    total, start = np.cumsum(size), 0
    while start < len(size):
        end = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + most, "right")))
        yield start, end
        start = end


def _solved(units: Units, solve: Solve):
    """Spans of symbols to be cut, of the segments of a bundle of shards, which are solved one after the other."""
    def run(table: pa.Table) -> pa.Table:
        with reused_memory():
            return spans(_unpacked(table))

    def spans(rows: list[dict]) -> pa.Table:
        before, ids, keys = _gathered(rows)
        doc, begin, end = [], [], []
        for r, b in zip(rows, before, strict=False):
            if not r["kind"]:
                start = _numbers(r, "start", np.int32).astype(np.int64)
                doc.append(_numbers(r, "doc", np.int32) + b)
                begin.append(start)
                end.append(start + _numbers(r, "size", np.int32))
        sent = [(r, b) for r, b in zip(rows, before, strict=False) if r["kind"] == 1]
        if sent:
            size = np.concatenate([_numbers(r, "lengths", np.int32) for r, _ in sent]).astype(np.int64)
            hashes = np.concatenate([_numbers(r, "hashes", np.uint64) for r, _ in sent])
            n_content = np.cumsum([0, *(len(_numbers(r, "lengths", np.int32)) for r, _ in sent)])
            d = np.concatenate([_numbers(r, "doc", np.int32) + b for r, b in sent])
            start = np.concatenate([_numbers(r, "start", np.int32) for r, _ in sent]).astype(np.int64)
            content = np.concatenate([_numbers(r, "content", np.int32) + c for (r, _), c in zip(sent, n_content, strict=False)])
            data = np.concatenate([_numbers(r, "data", np.uint64 if units.words else np.uint8) for r, _ in sent])
            part = np.concatenate([_numbers(r, "part", np.int32) for r, _ in sent])
            order = np.argsort(hashes)
            at = np.cumsum(size) - size
            distinct = np.empty(len(order), np.int64)
            distinct[order] = same_content(data, at[order], size[order], np.append(True, hashes[order[1:]] != hashes[order[:-1]]))
            # Contents in the order of their shards.
            chosen = np.unique(distinct, return_index=True)[1]
            by = np.argsort(part[chosen], kind="stable")
            chosen, place = chosen[by], np.empty(len(by), np.int64)
            place[by] = np.arange(len(by))
            content = place[distinct[content]]
            least = np.full(len(chosen), np.iinfo(np.int64).max)
            np.minimum.at(least, content, ids[d])
            data, size, part = gathered(data, at[chosen], size[chosen]), size[chosen], part[chosen]
            cut = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part)).tolist()
            ends = np.concatenate([[0], np.cumsum(size)])
            smallest = np.concatenate([solve(data[ends[a]:ends[b]], size[a:b], least[a:b], units.window) for a, b in zip(cut[:-1], cut[1:], strict=True)])
            windows = size - units.window + 1
            first = np.cumsum(windows) - windows
            # A segment goes as a whole if all its windows do; where only some do, each is looked at.
            whole = np.maximum.reduceat(smallest, first)[content] < ids[d]
            some = np.flatnonzero(~whole & (np.minimum.reduceat(smallest, first)[content] < ids[d]))
            doc.append(d[whole])
            begin.append(start[whole])
            end.append(start[whole] + size[content[whole]])
            for a, b in _stretches(windows[content[some]], PIECE):
                few = some[a:b]
                total = windows[content[few]]
                own, offset = np.repeat(few, total), ranges(np.zeros(len(few), np.int64), total)
                hit = smallest[first[content][own] + offset] < ids[d][own]
                doc.append(d[own[hit]])
                begin.append(start[own[hit]] + offset[hit])
                end.append(begin[-1] + units.window)
        doc, begin, end = np.concatenate(doc), np.concatenate(begin), np.concatenate(end)
        doc, found = merged(doc, begin, end)
        return _by_pack(rows, doc, found.astype(np.int32), before)
    return run


def merged(doc: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of each document in order, with those that touch or overlap made one: document, and (begin, end)."""
    if not len(doc):
        return doc, np.zeros((0, 2), np.int64)
    doc = doc.astype(np.int64)  # offsets are the product of documents and symbols
    order = np.lexsort((begin, doc))
    doc, begin, end = doc[order], begin[order], end[order]
    # The farthest end so far within the document: documents are kept apart by an offset.
    far = int(end.max()) + 2
    reach = np.maximum.accumulate(end + doc * far)
    new = np.append(True, (begin + doc * far)[1:] > reach[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], np.stack([begin[first], reach[last] - doc[first] * far], 1)


def _cut(words: bool, drop_partial: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
        for batch in pieces(batches, most=PIECE):
            data, offsets = flat(column(batch, "text"))
            spans = column(batch, "spans").to_pylist()
            found = [(i, np.frombuffer(b"".join(s), np.int32).reshape(-1, 2).astype(np.int64)) for i, s in enumerate(spans) if s]
            doc = np.concatenate([np.full(len(s), i) for i, s in found]) if found else np.zeros(0, np.int64)
            both = np.concatenate([s for _, s in found]) if found else np.zeros((0, 2), np.int64)
            doc, both = merged(doc, both[:, 0], both[:, 1])
            if words:
                starts, ends, first = word_bounds(data, offsets)
                count = np.diff(first)
                gone = np.zeros(len(starts), bool)
            else:
                first, count = offsets, np.diff(offsets)
                gone = np.zeros(len(data), bool)
            gone[ranges(first[doc] + both[:, 0], both[:, 1] - both[:, 0])] = True
            if words:
                raw, kept = data.tobytes(), []
                for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                    own = a + np.flatnonzero(~gone[a:b])
                    kept.append(b" ".join([raw[s:e] for s, e in zip(starts[own].tolist(), ends[own].tolist(), strict=True)]))
            else:
                if drop_partial:
                    # A character goes with any of its bytes.
                    head = np.flatnonzero((data & 0xC0) != 0x80)
                    if len(head):
                        gone = np.repeat(np.logical_or.reduceat(gone, head), np.diff(np.append(head, len(data))))
                rest, before = data[~gone].tobytes(), np.concatenate([[0], np.cumsum(~gone)])[offsets].tolist()
                kept = [rest[a:b] for a, b in zip(before[:-1], before[1:], strict=True)]
            n_removed = np.bincount(doc, both[:, 1] - both[:, 0], batch.num_rows).astype(np.int64)
            at = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=batch.num_rows))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at), pa.StructArray.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1] - 1)], ["first", "last"]))
            if words or drop_partial:
                kept = pa.array(kept, pa.binary()).cast(pa.string())
            keep = [batch.column(i) for i, n in enumerate(batch.schema.names) if n not in ("key", "spans", "text")]
            names = [n for n in batch.schema.names if n not in ("key", "spans", "text")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(count, pa.int64()), pa.array(n_removed), lists.cast(kind), pa.array(kept) if isinstance(kept, list) else kept],
                                             [*names, "n_symbols", "n_removed", "spans", "kept"])
    return run


def _per_row(found: DataFrame, name: str) -> DataFrame:
    """One row for each document; it has several only if rows repeat both id and text, in packs of their own."""
    return found.groupBy("doc_id", "key").agg(F.collect_list(name).alias(name))


def cut_repeats(docs: DataFrame, units: Units, solve: Solve, characters: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Cuts from every text the symbols of windows that also start in a document with a smaller id.

    ``docs``: ``doc_id`` (long), ``text``. Returns per row ``doc_id``, the columns named in ``keep``, ``n_symbols``, ``n_removed``, ``spans``
    (first and last symbol of each maximal removed run) and ``kept`` (bytes: binary; words: string, joined by one space). With ``characters``, ``kept``
    is a string from which a character goes with any of its bytes. Windows are judged on the input. A null text is
    empty; a row without id neither loses anything nor counts for others; rows with the same id don't count for
    each other. Other columns are ignored.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    named = texts.filter("doc_id is not null and text is not null")
    with released(spark):
        size = named.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        marks = named.mapInArrow(_mark(units, shards := max(1, -(-size // MARK_BYTES))), MARKED)
        marks = marks.groupBy("shard").applyInArrow(_repeated(units, SHARD_SYMBOLS), FOUND)
        marks = written(marks.groupBy("pack").applyInArrow(_documents_of("runs", 1), "doc_id long, key long, runs binary"), "marks")
        # At most one minimum, with the symbols of its runs, for every SHARD_SYMBOLS symbols of the input.
        found = marks.filter("doc_id is null").select("runs").collect()
        found = np.concatenate([np.zeros((0, 2), np.uint64), *(np.frombuffer(r.runs, np.uint64).reshape(-1, 2) for r in found)])
        large, by_window = found[:, 0], float(found[:, 1].sum()) * (units.window - units.gram + 1) / units.usual * units.window
        marks = marks.filter("doc_id is not null")
        runs = marks.agg(F.sum(F.octet_length("runs").cast("long"))).first()[0] or 0
        length = ((units.window - units.gram + 2) / 2 + units.window) / 4
        shards = max(1, int((runs * length + by_window) // SHARD_SYMBOLS) + 1)
        segments = named.join(_per_row(marks, "runs"), ["doc_id", "key"]).mapInArrow(_segments(units, shards, large), SEGMENTS)
        spans = segments.groupBy("shard").applyInArrow(_solved(units, solve), FOUND)
        spans = written(spans.groupBy("pack").applyInArrow(_documents_of("spans", 2), "doc_id long, key long, spans binary"), "spans")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, F.xxhash64("text").alias("key"), "text")
    rows = rows.join(_per_row(spans, "spans"), ["doc_id", "key"], "left").select("doc_id", *keep, "key", "text", "spans")
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in ("doc_id", *keep))
    kept = "string" if units.words or characters else "binary"
    return rows.mapInArrow(_cut(units.words, characters), f"{own}, n_symbols long, n_removed long, spans array<struct<first:bigint,last:bigint>>, kept {kept}")
