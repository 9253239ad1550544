import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import codebooks

KIND = "vec_id long, label int, vector array<double>"


def brute(rows):
    """Plain integers, one vector length after the other."""
    kept = [(i, label, v) for i, label, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for dim in {len(v) for _, _, v in kept}:
        own = sorted((r for r in kept if len(r[2]) == dim), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
        whole = [[math.floor(int(x) * 4096 if abs(x) > 2**60 else x * 4096) for x in v] for _, _, v in own]
        cuts = [(i * dim // 8, (i + 1) * dim // 8) for i in range(8)]
        books, codes, errors = [], [""] * len(own), [0] * len(own)
        for a, b in cuts:
            parts = [w[a:b] for w in whole]
            entries = [list(p) for p in parts[:16]]

            def nearest(p, entries=entries):
                return min((sum((x - y) ** 2 for x, y in zip(p, e, strict=True)), i) for i, e in enumerate(entries))

            for _ in range(6):
                groups = {}
                for p in parts:
                    groups.setdefault(nearest(p)[1], []).append(p)
                for i, g in groups.items():
                    entries[i] = [sum(c) // len(g) for c in zip(*g, strict=True)]
            for n, p in enumerate(parts):
                d, i = nearest(p)
                codes[n] += f"{i:02x}"
                errors[n] += d
            books += [str(x) for e in entries for x in e]
        sums = {}
        errors = [min(e, codebooks.LONG) for e in errors]
        for (_, label, _), e in zip(own, errors, strict=True):
            sums[label] = sums.get(label, 0) + e
        digest = hashlib.sha256(",".join(books).encode()).hexdigest()
        out += [(i, c, e, min(sums[label], codebooks.LONG), digest) for (i, label, _), c, e in zip(own, codes, errors, strict=True)]
    return sorted(out, key=repr)


def compressed(spark, rows, clash=True):
    df = spark.createDataFrame(rows, KIND).repartition(3)
    if clash:
        df = df.withColumns({n: F.lit("clash") for n in ("code", "error", "dim", "entry", "part", "label_error", "salt", "value")})
    return sorted(map(tuple, codebooks.compress(df).collect()), key=repr)


def some(n, dim, rng, spread=1.0):
    return [(i, rng.choice([None, 1, 2]), [rng.gauss(0, spread) for _ in range(dim)]) for i in range(n)]


def test_usual_vectors(spark, monkeypatch):
    monkeypatch.setattr(codebooks, "BLOCK_ROWS", 90)
    rows = some(400, 16, random.Random(1))
    assert compressed(spark, rows) == brute(rows)


def test_clustered_vectors_with_repeats(spark):
    rng = random.Random(2)
    centers = [[rng.gauss(0, 5) for _ in range(16)] for _ in range(6)]
    rows = [(i, i % 4, [c + rng.gauss(0, 0.01) for c in centers[i % 6]]) for i in range(300)]
    rows += [(1000 + i, 7, centers[0]) for i in range(200)] + rows[:20]
    assert compressed(spark, rows) == brute(rows)


def test_awkward_rows(spark):
    rng = random.Random(3)
    rows = some(40, 16, rng) + [(50, 1, None), (51, 1, [0.0] * 15 + [None]), (52, 1, [float("nan")] * 16), (53, 1, [float("inf")] + [0.0] * 15), (None, None, [0.5] * 16), (None, 3, [0.5] * 16),
                                (3, 9, [0.25] * 16), (3, 9, [0.25] * 16), (54, 5, []), (55, 5, []), (56, None, [1.0, 2.0]), (57, 1, [1.0] * 9), (58, 1, [-1.0] * 9)]
    assert compressed(spark, rows) == brute(rows)


def test_few_and_no_rows(spark):
    assert compressed(spark, []) == []
    rows = [(5, None, [0.1] * 8), (2, None, [-0.00001] * 8)]
    assert compressed(spark, rows) == brute(rows)


@pytest.mark.parametrize("large", [40_000.0, 1e12, 3e38, 1e300])
def test_large_components(spark, large):
    """Components that leave 32 and 64 bits; errors beyond a long are given as the largest one."""
    rng = random.Random(4)
    rows = some(60, 8, rng) + [(100 + i, 1, [rng.choice([large, -large / 3, 0.5]) for _ in range(8)]) for i in range(30)]
    assert compressed(spark, rows) == brute(rows)


def test_a_hot_label_without_broadcast(spark, monkeypatch):
    rng = random.Random(5)
    rows = some(120, 8, rng)
    monkeypatch.setattr(codebooks, "BROADCAST_KEY_BYTES", -1)
    assert compressed(spark, rows) == brute(rows)


def test_balls_are_owned_without_looking_at_their_points():
    rng = np.random.default_rng(6)
    centers = rng.integers(-40_000, 40_000, (8, 8))
    x = centers[rng.integers(0, 8, 4_000)] + rng.integers(-300, 300, (4_000, 8))
    tree = codebooks.Tree(codebooks.Anchors(x).row(), x)
    assert sorted(tree.points.tolist()) == list(range(len(x)))
    inner = np.flatnonzero(tree.left >= 0)
    assert (tree.first[inner] == tree.first[tree.left[inner]]).all() and (tree.last[tree.left[inner]] == tree.first[tree.right[inner]]).all()
    for b in range(len(tree.first)):
        own = tree.x[tree.first[b]:tree.last[b]]
        assert (own.sum(0) == tree.sums[b]).all() and np.sqrt(((own - tree.pivots[b]) ** 2).sum(1)).max() <= tree.radius[b]
    owned, _, points, _ = tree.owners(centers)
    assert tree.counts[owned].sum() + len(points) == len(x) and len(points) < 0.1 * len(x)
    code, error = tree.codes(centers)
    d = ((x[:, None] - centers[None]) ** 2).sum(2)
    assert (code == d.argmin(1)).all() and (error == d.min(1)).all()
