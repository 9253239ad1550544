import random
import re

from hypothesis import given, settings, strategies as st

import numpy as np

from corpusloom.llm import decontaminate

from .conftest import awkward_rows

LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(rows, items, window):
    out = []
    for i, text in rows:
        w, hit, names = words(text), set(), set()
        for item, t in items:
            v = words(t)
            size = min(window, len(v))
            for j in range(len(v) - size + 1) if v and item is not None else ():
                for k in range(len(w) - size + 1):
                    if w[k:k + size] == v[j:j + size]:
                        hit |= set(range(k, k + size))
                        names.add(str(item))
        out.append((i, len(w), sorted(hit), sorted(names)))
    return sorted(out, key=repr)


def got(df, benchmark, window, **more):
    found = decontaminate.find_passages(df, benchmark, window, **more).collect()
    return sorted(((r.doc_id, r.n_words, [k for s in r.spans for k in range(s.first, s.last + 1)], list(r["items"])) for r in found), key=repr)


def test_awkward_rows(spark, awkward, no_rows):
    passage = " ".join(f"P{i}" for i in range(10, 40))
    items = [(1, passage), (1, passage), (2, "one"), (10, "ONE, two!"), (3, None), (4, "--"), (None, "one"), (5, "東京" * 60), (6, passage + " zz")]
    benchmark = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as spans", "2 as items")
    rows = [r[:2] for r in awkward_rows()]
    want = brute(rows, items, 10)
    assert got(awkward, benchmark, 10) == want
    assert got(awkward, benchmark, 10, block_bytes=100) == want
    assert got(no_rows, benchmark, 10) == []
    assert got(awkward, benchmark.limit(0), 10) == brute(rows, [], 10)


def test_kept_columns(spark, awkward):
    benchmark = spark.createDataFrame([(2, "one")], "item_id long, text string")
    found = decontaminate.find_passages(awkward, benchmark, 10, keep=("text", "lang"))
    assert found.columns == ["doc_id", "text", "lang", "n_words", "spans", "items"]
    assert sorted(map(str, found.select("doc_id", "text").collect())) == sorted(map(str, awkward.select("doc_id", "text").collect()))


@settings(max_examples=150, deadline=None)
@given(st.data(), st.integers(1, 4))
def test_search(data, window):
    text = st.lists(st.sampled_from(["a", "bb", "A-a", "é", "ab", "longerwordthanothers", "\n", "."]), max_size=14).map(" ".join)
    items = [(str(i), t) for i, t in enumerate(data.draw(st.lists(text, max_size=5)))]
    docs = data.draw(st.lists(text, min_size=1, max_size=4))
    raw = [d.encode() for d in docs]
    n, spans, names = decontaminate.Search(items, window).run(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    found = [(i, int(a), [k for s in b for k in range(s["first"], s["last"] + 1)], c) for i, (a, b, c) in enumerate(zip(n, spans, names, strict=True))]
    assert sorted(found, key=repr) == brute(list(enumerate(docs)), items, window)


def test_long_patterns_and_texts():
    rng = random.Random(2)
    vocabulary = ["ring", "ti", "on", "the", "ouer", "thnd"]
    text = " ".join(rng.choices(vocabulary, k=8000))
    items = [(str(i), " ".join(text.split()[s:s + 30])) for i, s in enumerate(range(0, 7000, 900))] + [("x", " ".join(rng.choices(vocabulary, k=40)))]
    raw = text.encode()
    _, spans, names = decontaminate.Search(items, 10).run(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    assert brute([(0, text)], items, 10)[0][2:] == ([k for s in spans[0] for k in range(s["first"], s["last"] + 1)], names[0])
