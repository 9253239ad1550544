import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from corpusloom.llm import fm_index, repeats, suffix_array

from .conftest import awkward_rows


def brute(rows, words, window):
    """(id, symbols, removed, spans, kept) of each (id, text)."""
    texts = [(i, re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) if words else (t or "").encode()) for i, t in rows]
    first = {}
    for i, x in texts:
        for j in range(len(x) - window + 1):
            if i is not None:
                key = tuple(x[j:j + window])
                first[key] = min(i, first.get(key, i))
    out = []
    for i, x in texts:
        gone = np.zeros(len(x), bool)
        for j in range(len(x) - window + 1):
            if i is not None and first[tuple(x[j:j + window])] < i:
                gone[j:j + window] = True
        edge = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        spans = [[a, b - 1] for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True)]
        kept = b" ".join(x[j] for j in np.flatnonzero(~gone)).decode() if words else bytes(np.frombuffer(x, np.uint8)[~gone])
        out.append((i, len(x), int(gone.sum()), spans, kept))
    return sorted(out, key=repr)


def got(df, words, window):
    cut = fm_index.cut_repeated_words(df, window) if words else suffix_array.cut_repeated_bytes(df, window)
    return sorted(((r.doc_id, r.n_symbols, r.n_removed, [[s.first, s.last] for s in r.spans], r.kept if words else bytes(r.kept)) for r in cut.collect()), key=repr)


@pytest.mark.parametrize("words", [False, True])
def test_awkward_rows(awkward, no_rows, words):
    window = 13 if words else 50
    assert got(awkward, words, window) == brute([r[:2] for r in awkward_rows()], words, window)
    assert got(no_rows, words, window) == []


@pytest.mark.parametrize("words", [False, True])
def test_many_shards(spark, monkeypatch, words):
    """Texts over a few words, with copies, shared and periodic passages, dealt over many small shards."""
    monkeypatch.setattr(repeats, "MARK_BYTES", 4_000)
    monkeypatch.setattr(repeats, "SHARD_SYMBOLS", 3_000)
    rng = random.Random(5)
    shared = [" ".join(rng.choices("ab cd ef gh".split(), k=40)) for _ in range(5)]
    rows = [(i, " ".join(rng.choice(["the of", f"u{rng.randrange(10**5)}", rng.choice(shared), "aa " * rng.randrange(30)]) for _ in range(rng.randrange(12)))) for i in range(150)]
    rows += [(i + 150, rows[i][1]) for i in range(40)]
    rng.shuffle(rows)
    window = 13 if words else 50
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(df, words, window) == brute(rows, words, window)


@pytest.mark.parametrize("words", [False, True])
def test_shards_travel_in_bundles(spark, monkeypatch, words):
    """Rows of a pack do not grow with the shards, and shards that share a row are solved one by one."""
    monkeypatch.setattr(repeats, "SHARD_SYMBOLS", 2_000)
    monkeypatch.setattr(repeats, "SHARD_ROWS", 3)
    rng = random.Random(6)
    shared = [" ".join(f"{rng.randrange(10**5)}" for _ in range(60)) for _ in range(60)]
    rows = [(i, " ".join(rng.sample(shared, 3)) + f" tail {i}") for i in range(120)]
    rows += [(i + 120, rows[i][1]) for i in range(10)]
    window, inner = (13, fm_index.least_ids) if words else (50, suffix_array.least_ids)

    def solve(data, lengths, ids, window):
        if len(data) > 12_000:
            raise MemoryError(f"{len(data)} symbols in one shard")
        return inner(data, lengths, ids, window)

    units = repeats.Units(words=words, window=window, gram=6 if words else 24)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = repeats.cut_repeats(df, units, solve).collect()
    found = sorted(((r.doc_id, r.n_symbols, r.n_removed, [[s.first, s.last] for s in r.spans], r.kept if words else bytes(r.kept)) for r in out), key=repr)
    assert found == brute(rows, words, window)


def test_rows_of_a_pack_do_not_grow_with_the_shards():
    units = repeats.Units(words=False, window=50, gram=24)
    rng = random.Random(6)
    text = " ".join(f"{rng.randrange(10**9)}" for _ in range(3_000))
    runs = len(units.runs(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))[0])
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "key": [2], "text": [text], "runs": [[np.arange(runs, dtype=np.int32).tobytes()]]})
    few, many = (sum(b.num_rows for b in repeats._segments(units, shards, np.zeros(0, np.uint64))(iter([batch]))) for shards in (100, 1_000))
    assert runs > 1_000 and many <= 128 and few <= 100


@pytest.mark.parametrize("words", [False, True])
def test_short_passage_of_many_documents(spark, monkeypatch, words):
    """A passage shorter than a window, in every document with a context of its own, does not make one large shard."""
    monkeypatch.setattr(repeats, "SHARD_SYMBOLS", 1_000)
    rng = random.Random(8)
    passage = "the quick brown fox jumps over a lazy dog ok"
    rows = [(i, " ".join(f"{rng.randrange(10**7)}" for _ in range(12)) + f" {passage} " + " ".join(f"{rng.randrange(10**7)}" for _ in range(12))) for i in range(400)]
    # Some repeat whole windows around it.
    rows += [(i + 400, f"n{i} {rows[7 * i][1]} {i}m" if i % 2 else rows[7 * i][1][40:-40]) for i in range(50)]
    rng.shuffle(rows)
    window, inner = (13, fm_index.least_ids) if words else (50, suffix_array.least_ids)

    def solve(data, lengths, ids, window):
        if len(data) > 10_000:
            raise MemoryError(f"{len(data)} symbols in one shard")
        return inner(data, lengths, ids, window)

    units = repeats.Units(words=words, window=window, gram=6 if words else 24)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = repeats.cut_repeats(df, units, solve).collect()
    found = sorted(((r.doc_id, r.n_symbols, r.n_removed, [[s.first, s.last] for s in r.spans], r.kept if words else bytes(r.kept)) for r in out), key=repr)
    assert found == brute(rows, words, window)
    assert sum(r.n_removed for r in out) > 0


def thue_morse(n, a, b):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


@pytest.mark.parametrize("words", [False, True])
def test_patterns_that_polynomials_do_not_tell_apart(spark, words):
    """Words and texts of Thue-Morse patterns differ, and so do those of any length around the sizes that are hashed in one piece."""
    long = [thue_morse(n, a, b) for n in (7, 8, 9, 16, 255, 256, 257, 512, 1024, 2048) for a, b in (("x", "y"), ("y", "x"))]
    rows = [(i, " ".join([w, *(f"w{j}" for j in range(12))])) for i, w in enumerate(long)]
    rows += [(100 + i, " ".join(thue_morse(600, *p))) for i, p in enumerate(("xy", "yx"))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    window = 13 if words else 50
    assert got(df, words, window) == brute(rows, words, window)


@pytest.mark.parametrize("words", [False, True])
def test_ids_of_any_sign_and_size(spark, words):
    rng = random.Random(4)
    rows = [(i - 30, " ".join(f"{rng.randrange(10**6)}" for _ in range(30))) for i in range(40)]
    rows += [(i, rows[k][1] + " tail") for k, i in enumerate((-2**63, 2**63 - 1, -10**18, 7 * 10**18, 2**62))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    window = 13 if words else 50
    assert got(df, words, window) == brute(rows, words, window)


def test_spans_of_many_long_documents():
    """Spans of different documents stay apart where documents times symbols exceed 32 bits."""
    doc = np.arange(5_000, dtype=np.int32)
    begin = np.full(5_000, 900_000)
    own, spans = repeats.merged(doc, begin, begin + 50)
    assert own.tolist() == doc.tolist() and (spans == [900_000, 900_050]).all()


def test_periodic_texts_take_few_rounds():
    """A shard that is one period over and over is sorted in seconds, not in minutes."""
    t = np.append(np.tile(np.array([5, 6, 7], np.int16), 150_000), 0).astype(np.int16)
    start = time.process_time()
    sa = suffix_array.suffix_array(t)
    assert time.process_time() - start < 10
    n = len(t) - 1
    assert sa.tolist() == [n, *range(n - 3, -1, -3), *range(n - 2, -1, -3), *range(n - 1, -1, -3)]


def test_equal_hashes_of_different_contents(monkeypatch):
    """Segments that share a hash only are told apart by their symbols."""
    segments = [b"aaaa", b"bbbb", b"aaaa", b"cc", b"bbbb", b"cc", b"dd"]
    symbols = np.frombuffer(b"".join(segments), np.uint8)
    size = np.array([len(x) for x in segments])
    number = repeats.same_content(symbols, np.cumsum(size) - size, size, np.array([True, False, False, False, False, False, True]))
    assert len(set(number.tolist())) == 4
    assert all((number[i] == number[j]) == (segments[i] == segments[j]) for i in range(7) for j in range(7))


def test_characters_stay_whole(spark):
    text = "é" * 60
    rows = [(0, "x" + text), (1, "yy" + text + "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'k' as lang")
    cut = {r.doc_id: (r.lang, r.kept) for r in suffix_array.cut_repeated_bytes(df, 51, characters=True, keep=("lang",)).collect()}
    assert cut == {0: ("k", "x" + text), 1: ("k", "yyz")}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=60), st.sampled_from([1, 300]))
def test_suffix_array(symbols, bucket):
    t = np.array([*symbols, 0])
    before, suffix_array.BUCKET = suffix_array.BUCKET, bucket
    try:
        sa = suffix_array.suffix_array(t)
    finally:
        suffix_array.BUCKET = before
    assert sa.tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
    shared = suffix_array.permuted_prefixes(t.astype(np.uint8), sa)
    for a, b in zip(sa[:-1], sa[1:], strict=True):
        n = 0
        while max(a, b) + n < len(t) and t[a + n] == t[b + n]:
            n += 1
        assert shared[b] == n


@settings(max_examples=200, deadline=None)
@given(st.data(), st.integers(1, 5), st.booleans())
def test_least_ids(data, window, words):
    segments = data.draw(st.lists(st.lists(st.integers(0, 2), min_size=window, max_size=window + 8), min_size=1, max_size=7))
    ids = np.array(data.draw(st.lists(st.integers(0, 4), min_size=len(segments), max_size=len(segments))))
    least = {}
    for s, i in zip(segments, ids, strict=True):
        for j in range(len(s) - window + 1):
            key = tuple(s[j:j + window])
            least[key] = min(i, least.get(key, i))
    want = [least[tuple(s[j:j + window])] for s in segments for j in range(len(s) - window + 1)]
    flat = np.array([x for s in segments for x in s], np.uint64 if words else np.uint8)
    solve = fm_index.least_ids if words else suffix_array.least_ids
    assert solve(flat, np.array([len(s) for s in segments]), ids, window).tolist() == want


def test_wavelet_ranks():
    rng = np.random.default_rng(1)
    sequence = rng.integers(0, 11, 500)
    tree = fm_index.Wavelet(sequence, 11)
    for at in (0, 1, 64, 128, 499, 500):
        assert tree.rank(np.arange(11), np.full(11, at)).tolist() == [int((sequence[:at] == c).sum()) for c in range(11)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(2, 4), min_size=1, max_size=40), st.lists(st.integers(2, 6), min_size=1, max_size=20), st.integers(1, 7))
def test_matching_statistics(symbols, run, depth):
    """Lengths and intervals of runs that the index need not hold, against plain search."""
    text = np.array([*symbols, 1, 0])
    index = fm_index.Index(text, 5, depth)
    for _, at, length, low, high in index.matching_statistics(np.array(run), np.array([0]), np.array([len(run)])):
        rest, own = run[at[0]:], symbols
        want = max(n for n in range(min(depth, len(rest)) + 1) if not n or any(own[i:i + n] == rest[:n] for i in range(len(own))))
        places = sorted(i for i in range(len(text)) if text[i:i + want].tolist() == rest[:want])
        assert length[0] == want and sorted(index.sa[low[0]:high[0]].tolist()) == places
