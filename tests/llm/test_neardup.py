import random
import re

import pytest

from corpusloom.llm import neardup
from corpusloom.llm.components import components

from .conftest import awkward_rows


def brute(rows, size, percent=80):
    """Component and number of shingles of each (id, text), by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if None in (rows[i][0], rows[j][0]) or not a or not b:
                continue
            if rows[i][0] == rows[j][0] or 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (own, _) in enumerate(rows):
        if own is not None:
            least[find(i)] = min(own, least.get(find(i), own))
    return sorted(((own, len(s), least.get(find(i)), own is None or own == least[find(i)]) for i, ((own, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def got(df, size):
    return sorted((tuple(r) for r in neardup.near_duplicates(df, size).collect()), key=repr)


@pytest.mark.parametrize("size", [2, 5])
def test_awkward_rows(awkward, size):
    assert got(awkward, size) == brute([r[:2] for r in awkward_rows()], size)


def test_no_rows(no_rows):
    assert neardup.near_duplicates(no_rows).count() == 0


def test_groups_of_near_copies(spark, monkeypatch):
    """Chains, copies that are near a hidden centre and not each other, and blocks smaller than the groups."""
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rng = random.Random(7)
    rows, n = [], 0
    for group in range(6):
        base = [f"g{group}w{rng.randrange(10**6)}" for _ in range(80)]
        for _ in range(60):
            words = list(base)
            for i in rng.sample(range(80), rng.randrange(0, 9)):
                words[i] = f"n{rng.randrange(10**6)}"
            rows.append((n, " ".join(words)))
            n += 1
    rng.shuffle(rows)
    assert got(spark.createDataFrame(rows, "doc_id long, text string"), 2) == brute(rows, 2)


def test_patterned_words_are_told_apart(spark):
    def pattern(n, a, b):
        return "".join(b if bin(i).count("1") % 2 else a for i in range(n))

    rows = [(i, " ".join([pattern(n, *p), "one", "two"])) for i, (n, p) in enumerate((n, p) for n in (8, 256, 512, 1024, 2048) for p in ("xy", "yx"))]
    assert got(spark.createDataFrame(rows, "doc_id long, text string"), 2) == brute(rows, 2)


def test_pruning_keeps_pairs_at_the_threshold():
    least = neardup.least_matches(0.8)
    assert least[0] <= 0 and all(0.5 * n < m < 0.8 * n for n, m in zip(range(96, 289, 32), least[3:], strict=True))


@pytest.mark.parametrize("task_links", [5, 100])
def test_components(spark, task_links):
    links = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7)]
    found = components(spark.createDataFrame(links, "a long, b long"), task_links)
    assert {r.id: r.component for r in found.collect()} == {i: 0 for i in range(41)} | {90: 90, 95: 90, 100: 90}
    assert components(spark.createDataFrame([], "a long, b long"), task_links).count() == 0
