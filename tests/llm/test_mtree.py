import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import mtree


def brute(rows, k):
    good = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in sorted({(i, tuple(v)) for i, v in good if i % 50 == 0}):
        found = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in good if i != q and len(w) == len(v))
        out += [(q, n, i, min(max(-s, -2**63), 2**63 - 1)) for n, (s, i) in enumerate(found[:k], 1)]
    return sorted(out)


def got(df, k):
    vectors = df.select("vec_id", mtree.quantised(F.col("embedding")).alias("vector"))
    return sorted(tuple(r) for r in mtree.top_k(mtree.build(vectors), vectors.filter("vec_id % 50 = 0"), k).select("query_id", "rank", "vec_id", "score").collect())


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as score", "2 as rank", "3 as vector").repartition(3)


def test_clusters_ties_and_copies(spark, monkeypatch):
    monkeypatch.setattr(mtree, "TOGETHER", 7)
    monkeypatch.setattr(mtree, "TREE_ROWS", 300)
    rng = np.random.default_rng(3)
    centers = rng.normal(0, 1, (6, 8))
    rows = [(i, (centers[i % 6] + rng.normal(0, 0.1, 8)).astype(np.float32).tolist()) for i in range(900)]
    rows += [(1000 + i, rows[50][1]) for i in range(300)] + [(1300 + i, [0.0] * 8) for i in range(60)]
    rows += [(2000 + i, rng.integers(-2, 3, 8).astype(float).tolist()) for i in range(400)]
    assert got(table(spark, rows), 5) == brute(rows, 5)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (50, None), (100, [1.0, None]), (150, [nan, 1.0]), (200, [inf, 0.0]), (None, [1.0, 1.0]), (1, [1.0, 2.0]), (1, [1.0, 2.0]),
            (2, [0.5, 0.25]), (3, [1.0]), (250, [3.0]), (300, []), (4, []), (5, [-1.0, 0.001])]
    assert got(table(spark, rows), 5) == brute(rows, 5)
    assert got(table(spark, rows).limit(0), 5) == []
    assert got(table(spark, [r for r in rows if r[0] in (1, 2)]), 5) == []


def test_bounds_pass_over_entries():
    """On clustered vectors most entries are passed over, and the result is still exact."""
    rng = np.random.default_rng(5)
    centers = rng.integers(-200, 200, (40, 16))
    x = (centers[rng.integers(0, 40, 4000)] + rng.integers(-3, 4, (4000, 16))).astype(np.int32)
    fields = [f.strip().split(" ")[0] for f in mtree.TREE.split(",")]
    tree = mtree.Tree(dict(zip(fields, mtree.grow(x, np.arange(4000)), strict=True)))
    taken = []
    tree._take = lambda who, entries, *rest, f=tree._take: (taken.append(len(who) * len(entries)), f(who, entries, *rest))
    who, vec, score = tree.search(x[:50].astype(float), np.arange(50), 5)
    score = np.array(score)
    assert sum(taken) < 50 * 4000 / 4
    for q in range(50):
        s = x @ x[q].astype(np.int64)
        s[q] = -10**9
        want = sorted(zip(-s, range(4000), strict=True))[:5]
        assert [(-a, b) for a, b in zip(score[who == q], vec[who == q], strict=True)] == [(int(a), b) for a, b in want]


@pytest.mark.parametrize("large", [40_000.0, 3e5, 1e7, 3e38, 1e300])
def test_large_components(spark, monkeypatch, large):
    """Finite components of any size take part, as queries and as candidates; products that differ only in their last digits are told apart."""
    monkeypatch.setattr(mtree, "TREE_ROWS", 200)
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(0, 1, 6).tolist()) for i in range(260)]
    rows += [(1000 + i, (rng.normal(0, 1, 6) * rng.choice([1, large, large / 7])).tolist()) for i in range(160)]
    rows += [(2000 + i, [large, 1.0 + i / 256, 0.0, 0.0, 0.0, -large]) for i in range(60)]
    assert got(table(spark, rows), 5) == brute(rows, 5)


def test_queries_stay_off_the_driver(spark):
    """One scan of the trees in the plan, however many queries there are, and none of them in a closure."""
    rows = [(i, [float(i % 13), float(i % 7)]) for i in range(4000)]
    vectors = table(spark, rows).select("vec_id", mtree.quantised(F.col("embedding")).alias("vector"))
    plan = mtree.top_k(mtree.build(vectors), vectors, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") <= 2 and "LocalTableScan" not in plan
