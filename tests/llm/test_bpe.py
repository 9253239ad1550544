import random

import numpy as np
import pytest
import regex
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from corpusloom.llm import bpe
from corpusloom.llm.queries import tokenizer_path

from .conftest import awkward_rows

PATH = tokenizer_path()


@pytest.fixture(scope="module")
def own():
    return bpe.Bpe(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def same(own, library, texts):
    ids, counts = own.encode(texts)
    ends = np.cumsum(counts)
    decoded = own.decode(ids, counts).to_pylist()
    for text, a, n, back in zip(texts, ends - counts, counts, decoded, strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids[a:a + n].tolist() == want, text
        assert back == library.decode(want, skip_special_tokens=False)


def test_texts_of_many_kinds(own, library):
    rng = random.Random(1)
    letters = "aaab  \n\t'sll1२½éß中一́ 　​😀_-.<|>"
    texts = ["".join(rng.choices(letters, k=rng.randrange(60))) for _ in range(500)]
    texts += ["", "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "<|endof", " " * 50 + "x", "a" * 3000, "aaa" * 7, "\x00\x01"]
    same(own, library, texts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(), max_size=4))
def test_any_text(own, library, texts):
    same(own, library, texts)


def test_full_store_is_emptied(own, library, monkeypatch):
    monkeypatch.setattr(bpe, "STORE_WORDS", 3)
    for i in range(5):
        same(own, library, [f"some words {i} here", "and others"])


def test_words_of_a_batch_are_those_of_the_pattern(own):
    rng = random.Random(2)
    letters = "aaab  \n\t'sll'remtdv1½²éß中́\u3000 \u200b😀_-.\x00\x1c\x85"
    pattern = regex.compile(bpe.WORDS)
    for _ in range(300):
        texts = ["".join(rng.choices(letters, k=rng.randrange(1, 25))) for _ in range(rng.randrange(1, 6))]
        joined, lengths = "".join(texts), np.array([len(t) for t in texts])
        starts = [*own.words(np.frombuffer(joined.encode("utf-32-le"), np.uint32), np.cumsum(lengths) - lengths).tolist(), len(joined)]
        assert [joined[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)] == [w for t in texts for w in pattern.findall(t)]


def test_equal_hashes_of_different_words(own, library, monkeypatch):
    """Words that share a hash only keep their own ids, inside a batch and beside the store."""
    monkeypatch.setattr(bpe, "word_hashes", lambda data, starts, ends, lower: (ends - starts).astype(np.uint64) // np.uint64(4))
    own.clear()
    try:
        for i in range(3):
            same(own, library, [f"some words {i} here here", "and other words", "a" * 40 + "b " + "a" * 41, "x" * 2000, "x" * 1999 + "y"])
    finally:
        own.clear()


def test_broken_utf8_and_unknown_ids(own):
    half = own.encode(["é"])[0]
    assert own.decode(np.array([own.of_byte[0xC3]]), np.array([1])).to_pylist() == ["�"]
    assert own.decode(np.array([10**6, -1, *half]), np.array([2 + len(half), 0][:2])).to_pylist() == ["é", ""]


def test_tables(awkward, no_rows):
    want = sorted((str(i), t or "") for i, t, *_ in awkward_rows())
    got = bpe.round_trip(awkward, PATH).collect()
    assert sorted((str(r.doc_id), r.decoded) for r in got) == want
    tokens = bpe.encode(awkward, PATH)
    assert sorted((str(r.doc_id), r.ids) for r in tokens.collect()) == sorted((str(r.doc_id), r.ids) for r in got)
    assert sorted((str(r.doc_id), r.text) for r in bpe.decode(tokens, PATH).collect()) == want
    assert bpe.round_trip(no_rows, PATH).count() == 0
    with_null = tokens.limit(1).selectExpr("doc_id", "cast(null as array<int>) as ids").union(tokens.limit(1).selectExpr("doc_id", "array(null) as ids"))
    assert [r.text for r in bpe.decode(with_null, PATH).collect()] == ["", ""]
