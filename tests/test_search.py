"""Vector and keyword search against plain restatements of the formulas."""

import itertools
import math
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from corpusloom import session
from corpusloom.functions import scores
from corpusloom.operators import ann, dense, sparse
from corpusloom.operators.block_topk import BestK, best_per_query, cell_topk
from corpusloom.plans import registry
from corpusloom.schemas import BlockLimits

BLOCKS = BlockLimits(broadcast_bytes=100, doc_rows=7, query_rows=3, matrix_cells=16)


def vectors(spark, n, dim, key, seed):
    rng = np.random.default_rng(seed)
    data = [(i, [float(x) for x in rng.normal(size=dim)]) for i in range(n)]
    return spark.createDataFrame(data, f"{key} long, embedding array<float>"), np.array([v for _, v in data], np.float32).astype(float)


def expected(queries, docs, k, metric):
    out = []
    for q, query in enumerate(queries):
        if metric in ("l2", "euclid"):
            cost = ((docs - query) ** 2).sum(axis=1)
            cost = np.sqrt(cost) if metric == "euclid" else cost
        else:
            cost = -(docs @ query)
            if metric == "cosine":
                cost = cost / np.linalg.norm(docs, axis=1) / np.linalg.norm(query)
        for rank, d in enumerate(sorted(range(len(docs)), key=lambda i: (round(cost[i], 6), i))[:k], 1):
            out.append((q, d, rank))
    return sorted(out, key=repr)


@pytest.mark.parametrize("metric", scores.METRICS)
@pytest.mark.parametrize("limits", [BlockLimits(), BLOCKS], ids=["broadcast", "blocks"])
def test_exact_search(spark, rows, metric, limits):
    queries, q = vectors(spark, 8, 5, "query_id", 1)
    docs, d = vectors(spark, 60, 5, "doc_id", 2)
    hits = dense.search(queries, docs, 6, metric, "identity", limits)
    assert rows(hits, "query_id", "doc_id", "rank") == expected(q, d, 6, metric)


def test_one_vector_copied_many_times(spark, rows):
    """A third of the documents are copies: ties go to the smaller id, in every physical form."""
    base, _ = vectors(spark, 60, 4, "doc_id", 3)
    copies = spark.range(1000, 1030).select(F.col("id").alias("doc_id"), F.array(*[F.lit(0.5).cast("float")] * 4).alias("embedding"))
    docs = base.unionByName(copies)
    query = spark.createDataFrame([("q", [0.5] * 4)], "query_id string, embedding array<float>")
    for limits in (BlockLimits(), BLOCKS):
        hits = dense.search(query, docs, 5, limits=limits)
        assert rows(hits, "rank", "doc_id", "distance") == [(i + 1, 1000 + i, 0.0) for i in range(5)]


def test_string_ids_and_short_corpus(spark, rows):
    docs = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", [0.0, 1.0])], "doc_id string, embedding array<float>")
    query = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, embedding array<float>")
    assert rows(dense.search(query, docs, 10), "rank", "doc_id", "score") == [(1, "a", 1.0), (2, "b", 1.0), (3, "c", 1 / 3)]


def test_zero_vector_has_no_cosine(spark, rows):
    docs = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 1.0])], "doc_id long, embedding array<float>")
    query = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, embedding array<float>")
    assert rows(dense.search(query, docs, 5, "cosine"), "rank", "doc_id", "score") == [(1, 2, 0.0), (2, 1, None)]


def test_filter_before_and_after(spark):
    docs = spark.createDataFrame([(i, [float(i)], "near" if i < 3 else "far") for i in range(8)],
                                 "doc_id long, embedding array<float>, kind string")
    query = spark.createDataFrame([(0, [0.0])], "query_id long, embedding array<float>")
    keep = F.col("kind") == "far"
    assert dense.search_filtered(query, docs, keep, 3, "pre").count() == 3
    assert dense.search_filtered(query, docs, keep, 3, "post").count() == 0
    deleted = spark.createDataFrame([(0,), (1,)], "doc_id long")
    assert dense.search_without(query, docs, deleted, 3, "pre").count() == 3
    assert dense.search_without(query, docs, deleted, 3, "post").count() == 1


def test_hot_cell_is_split(spark, rows):
    """One cell holds most documents and queries; blocks of seven rows still give the exact answer."""
    docs, d = vectors(spark, 90, 3, "doc_id", 5)
    queries, q = vectors(spark, 12, 3, "query_id", 6)
    hot = lambda key, n: F.when(F.col(key) < n, 1).otherwise(F.col(key) % 4 + 2)
    hits = cell_topk(queries.withColumn("cell", hot("query_id", 9)), docs.withColumn("cell", hot("doc_id", 60)),
                     dense.VectorKernel("l2", 16), 4, limits=BLOCKS)
    best = best_per_query(hits, 4)
    shipped = cell_topk(queries.withColumn("cell", hot("query_id", 9)), docs.withColumn("cell", hot("doc_id", 60)), dense.VectorKernel("l2", 16), 4, F.lit(1))
    assert rows(best_per_query(shipped, 4), "query_id", "doc_id", "rank") == rows(best, "query_id", "doc_id", "rank")
    cell = lambda i, n: 1 if i < n else i % 4 + 2
    want = []
    for i in range(12):
        mates = [j for j in range(90) if cell(j, 60) == cell(i, 9)]
        cost = {j: round(float(((d[j] - q[i]) ** 2).sum()), 6) for j in mates}
        want += [(i, j, rank) for rank, j in enumerate(sorted(mates, key=lambda j: (cost[j], j))[:4], 1)]
    assert rows(best, "query_id", "doc_id", "rank") == sorted(want, key=repr)


@pytest.mark.parametrize("limits", [BlockLimits(), BLOCKS], ids=["broadcast", "blocks"])
def test_each_query_with_its_own_filter(spark, rows, limits):
    docs = spark.createDataFrame([(i, [float(i)], {"parity": str(i % 2), "big": str(i > 5)} if i < 9 else {}) for i in range(10)],
                                 "doc_id long, embedding array<float>, metadata map<string,string>")
    asked = [("all", {}), ("none", None), ("odd", {"parity": "1"}), ("odd and big", {"parity": "1", "big": "true"}), ("unknown", {"x": "y"})]
    queries = spark.createDataFrame([(name, [0.0], own) for name, own in asked], "query_id string, embedding array<float>, filter map<string,string>")
    docs = docs.withColumn("metadata", F.transform_values("metadata", lambda _, v: F.lower(v)))
    found = {}
    for name, doc in rows(dense.search(queries, docs, 3, limits=limits), "query_id", "doc_id"):
        found.setdefault(name, []).append(doc)
    assert found == {"all": [0, 1, 2], "none": [0, 1, 2], "odd": [1, 3, 5], "odd and big": [7]}


@pytest.mark.parametrize("name", ["knn_l2_topk", "knn_l2_blocks", "knn_ivf", "knn_lsh", "bm25_blocks", "assign_ids"])
def test_plans_have_no_nested_loops(spark, sf, name):
    plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_score_conversions(spark):
    row = spark.range(1).select(
        scores.score("l2", "inverse", F.lit(1.0)).alias("a"), scores.score("l2", "one_minus", F.lit(3.0)).alias("b"),
        scores.score("dot", "identity", F.lit(-2.0)).alias("c")).first()
    assert tuple(row) == (0.5, -2.0, 2.0)
    with pytest.raises(ValueError):
        scores.score("l2", "other", F.lit(1.0))


def test_unknown_metric(spark):
    df, _ = vectors(spark, 1, 2, "query_id", 0)
    with pytest.raises(ValueError):
        dense.search(df, df.withColumnRenamed("query_id", "doc_id"), 1, "manhattan")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 4), min_size=9, max_size=9), min_size=1, max_size=4), st.integers(1, 6), st.integers(1, 9))
def test_running_best_does_not_depend_on_the_cut(costs, k, step):
    """Any cut into blocks gives the same best k, and best k is a prefix of best k + 1."""
    matrix, ids = np.array(costs, float), np.array([5, 3, 8, 1, 9, 2, 7, 4, 6])

    def best(k, step):
        running = BestK(len(matrix), k)
        for start in range(0, 9, step):
            running.offer(ids[start:start + step], matrix[:, start:start + step])
        rows, cost, found = running.merge()
        return list(zip(rows.tolist(), cost.tolist(), found.tolist()))

    whole = best(k, 9)
    assert best(k, step) == whole
    assert set(whole) <= set(best(k + 1, step))
    assert [(c, i) for r, c, i in whole if r == 0] == sorted(zip(matrix[0], ids))[:k]


def test_inverted_lists(spark, sf, tmp_path, rows):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    docs = table.select(F.col("vec_id").alias("doc_id"), "embedding")
    queries = table.select(F.col("vec_id").alias("query_id"), "embedding")
    exact = set(rows(dense.search(queries, docs, 10), "query_id", "doc_id"))
    lists = ann.train_lists(docs, 16)
    stored = ann.store_lists(docs, lists, str(tmp_path / "lists"))
    assert stored.count() == docs.count()
    recall = {}
    for n_probe in (4, 16):
        found = set(rows(ann.search_lists(queries, stored, lists, 10, n_probe, limits=BLOCKS), "query_id", "doc_id"))
        recall[n_probe] = len(found & exact) / len(exact)
    assert recall[16] == 1.0
    assert recall[4] > 0.45


def clustered(spark, n, key, seed):
    rng = np.random.default_rng(7)
    centers = rng.normal(0, 10, (12, 6))
    rng = np.random.default_rng(seed)
    data = [(i, [float(x) for x in centers[rng.integers(12)] + rng.normal(0, 0.3, 6)]) for i in range(n)]
    return spark.createDataFrame(data, f"{key} long, embedding array<float>")


@pytest.mark.parametrize("limits", [BlockLimits(), BLOCKS], ids=["broadcast", "blocks"])
@pytest.mark.parametrize("metric", ["l2", "euclid"])
def test_lists_are_visited_until_the_bound(spark, tmp_path, rows, metric, limits):
    """On clustered vectors a small share of the lists is visited, and the hits are those of the exact search."""
    docs, queries = clustered(spark, 600, "doc_id", 1), clustered(spark, 40, "query_id", 2)
    lists = ann.train_lists(docs, 12)
    stored = ann.store_lists(docs, lists, str(tmp_path / "lists"))
    log = []
    found = rows(ann.search_all_lists(queries, stored, lists, 5, metric, limits=limits, log=log), "query_id", "doc_id", "rank", "score")
    assert found == rows(dense.search(queries, docs, 5, metric), "query_id", "doc_id", "rank", "score")
    assert sum(log) < 40 * 12 / 2


def test_lists_with_few_vectors(spark, tmp_path, rows):
    """Fewer vectors than hits asked for, empty lists, no queries, copies."""
    docs = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(7)], "doc_id long, embedding array<float>")
    queries = spark.createDataFrame([(0, [0.0, 0.0]), (1, [5.0, 5.0]), (2, None)], "query_id long, embedding array<float>")
    lists = ann.InvertedLists(np.array([[0.0, 1.0], [1.0, 1.0], [2.0, 1.0], [90.0, 90.0]]))
    stored = ann.store_lists(docs, lists, str(tmp_path / "lists"))
    assert rows(ann.search_all_lists(queries, stored, lists, 20), "query_id", "doc_id", "rank") == rows(dense.search(queries, docs, 20), "query_id", "doc_id", "rank")
    assert ann.search_all_lists(queries.limit(0), stored, lists, 3).count() == 0
    with pytest.raises(ValueError):
        ann.search_all_lists(queries, stored, lists, 3, "dot")


def test_hashing(spark, sf, rows):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    docs = table.select(F.col("vec_id").alias("doc_id"), "embedding")
    queries = table.select(F.col("vec_id").alias("query_id"), "embedding")
    exact = set(rows(dense.search(queries, docs, 10), "query_id", "doc_id"))
    found = rows(ann.search_hashes(queries, docs, ann.train_hashes(docs, 0.1, 4), 10), "query_id", "doc_id")
    assert len(found) == len(set(found))
    assert len(set(found) & exact) / len(exact) > 0.6


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01", "sf0.1"])
@pytest.mark.parametrize("name", ["knn_lsh"])
def test_recall_of_registered_searches(spark, sf, rows, name, scale):
    folder = sf.replace("sf0.001", scale)
    exact = set(rows(registry.QUERIES["knn_l2_score"](spark, folder), "query_id", "doc_id"))
    found = rows(registry.QUERIES[name](spark, folder), "query_id", "doc_id")
    assert len(found) == len(set(found))
    assert len(set(found) & exact) / len(exact) >= 0.9


def bm25(docs, query):
    """The public BM25 formula, restated."""
    tokens = {i: text.lower().split() for i, text in docs.items()}
    counts = {i: Counter(t) for i, t in tokens.items()}
    df = Counter(t for c in counts.values() for t in c)
    n, avgdl = len(docs), sum(map(len, tokens.values())) / len(docs)
    idf = {t: math.log(n - f + 0.5) - math.log(f + 0.5) for t, f in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {t: floor if v < 0 else v for t, v in idf.items()}
    return {i: sum(idf.get(t, 0) * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * len(tokens[i]) / avgdl))
                   for t in query.lower().split()) for i, c in counts.items()}


@pytest.mark.parametrize("limits", [BlockLimits(), BLOCKS], ids=["broadcast", "blocks"])
def test_bm25_by_hand(spark, rows, limits):
    docs = {1: "red fox red", 2: "red dog and cat", 3: "a quick bird", 4: ""}
    index = sparse.build_index(spark.createDataFrame(list(docs.items()), "doc_id long, content string"))
    queries = {"a": "Red fox red unknown", "b": "bird", "c": "nothing here", "d": "RED cat"}
    hits = sparse.search(spark.createDataFrame(list(queries.items()), "query_id string, query string"), index, 3, limits=limits)
    want = []
    for q, text in queries.items():
        ranked = sorted(((round(s, 6), d) for d, s in bm25(docs, text).items() if round(s, 6) > 0), key=lambda p: (-p[0], p[1]))
        want += [(q, d, rank, s) for rank, (s, d) in enumerate(ranked[:3], 1)]
    assert rows(hits, "query_id", "doc_id", "rank", "score") == sorted(want, key=repr)


def test_bm25_on_tables(spark, sf, rows):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.col("text").alias("content"))
    queries = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    texts = dict(rows(docs, "doc_id", "content"))
    want = []
    for q, text in rows(queries, "query_id", "query"):
        best = sorted(((-round(s, 6), d) for d, s in bm25(texts, text).items() if round(s, 6) > 0))[:20]
        want += [(q, d) for _, d in best]
    hits = sparse.search(queries, sparse.build_index(docs), 20)
    assert rows(hits, "query_id", "doc_id") == sorted(want, key=repr)


def test_bm25_index_can_be_stored(spark, tmp_path, rows):
    docs = spark.createDataFrame([(1, "red fox"), (2, "blue fox"), (3, "green bird")], "doc_id long, content string")
    index = sparse.build_index(docs)
    index.save(str(tmp_path / "index"))
    again = sparse.SparseIndex.load(spark, str(tmp_path / "index"))
    query = spark.createDataFrame([(0, "red fox")], "query_id long, query string")
    assert rows(sparse.search(query, again, 2), "doc_id", "score") == rows(sparse.search(query, index, 2), "doc_id", "score")


def test_term_vectors(spark):
    docs = spark.createDataFrame([(1, "b a\tb"), (2, ""), (3, "x")], "doc_id long, content string")
    found = {r.doc_id: (r.dl, r.terms, r.tfs) for r in sparse.term_vectors(docs).collect()}
    assert found == {1: (3, ["a", "b"], [1, 2]), 2: (0, [], []), 3: (1, ["x"], [1])}


def test_ignores_filter_unless_asked(spark, rows):
    docs = spark.createDataFrame([(1, "red", {"k": "a"}), (2, "red fox", {"k": "b"}), (3, "sky", {}), (4, "sea", None), (5, "sun", {"k": "b"})],
                                 "doc_id long, content string, metadata map<string,string>")
    index = sparse.build_index(docs)
    query = spark.createDataFrame([(0, "red")], "query_id long, query string")
    assert rows(sparse.search(query, index, 5), "doc_id") == [(1,), (2,)]
    keep = lambda metadata: F.try_element_at(metadata, F.lit("k")) == "b"
    for limits in (BlockLimits(), BLOCKS):
        assert rows(sparse.search(query, index, 5, keep, limits), "doc_id") == [(2,)]
    with pytest.raises(ValueError):
        sparse.search(query, sparse.build_index(docs.drop("metadata")), 5, keep)


def skewed_texts(n, seed=4):
    """Texts of common words, with rare ones that crowd in some of them."""
    rng = np.random.default_rng(seed)
    return {i: " ".join(["the"] * int(rng.integers(1, 9)) + [f"c{rng.integers(20)}" for _ in range(rng.integers(5, 60))] + (["rare"] * int(rng.integers(1, 6)) if 300 < i < 340 else []) + [f"u{i}"]) for i in range(n)}


def part_of(index):
    return index.postings.drop("metadata").toArrow().combine_chunks().to_batches()


def test_ranges_below_the_kth_score_are_skipped(spark):
    """Over one large part most blocks of postings are passed over, and the scores are those of all documents."""
    texts = skewed_texts(3000)
    index = sparse.build_index(spark.createDataFrame(list(texts.items()), "doc_id long, content string").coalesce(1))
    assert index.n_parts > 1
    sparse.SMALL_PART, before = 10_000, sparse.SMALL_PART
    try:
        index = sparse.build_index(spark.createDataFrame(list(texts.items()), "doc_id long, content string").coalesce(1))
    finally:
        sparse.SMALL_PART = before
    assert index.n_parts == 1
    queries = spark.createDataFrame([(0, "the rare"), (1, "rare"), (2, "the c1 c2"), (3, "nothing")], "query_id long, query string")
    weighted = sparse.query_vectors(queries, index).orderBy("query_id").toArrow()
    kernel = sparse.TermKernel(index.avgdl)
    kernel.hold(part_of(index))
    kernel.best(weighted.slice(0, 2), 10)
    assert kernel.n_skipped > kernel.n_read
    found, cost, ids = kernel.best(weighted, 10).merge()
    for at, query_id in enumerate(weighted.column("query_id").to_pylist()):
        text = {0: "the rare", 1: "rare", 2: "the c1 c2"}[query_id]
        want = sorted(((-round(s, 6), d) for d, s in bm25(texts, text).items() if round(s, 6) > 0))[:10]
        assert list(zip(cost[found == at].tolist(), ids[found == at].tolist(), strict=True)) == want


def test_only_asked_tokens_are_read(spark):
    index = sparse.build_index(spark.createDataFrame(list(skewed_texts(200).items()), "doc_id long, content string"))
    query = spark.createDataFrame([(0, "rare c3")], "query_id long, query string")
    plan = sparse.search(query, index, 3)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(token" in plan and "terms" not in plan


def test_more_tokens_than_are_listed(spark, rows, monkeypatch):
    index = sparse.build_index(spark.createDataFrame(list(skewed_texts(300).items()), "doc_id long, content string"))
    queries = spark.createDataFrame([(i, f"the c{i} rare") for i in range(20)], "query_id long, query string")
    want = rows(sparse.search(queries, index, 5), "query_id", "doc_id", "rank", "score")
    monkeypatch.setattr(sparse, "LISTED_TOKENS", 3)
    assert rows(sparse.search(queries, index, 5), "query_id", "doc_id", "rank", "score") == want
    assert rows(sparse.search(queries, index, 5, limits=BLOCKS), "query_id", "doc_id", "rank", "score") == want


def test_an_index_follows_changes(spark, rows):
    """After insertions, replacements and deletions, some of them twice, statistics and hits are those of a new index."""
    kind = "doc_id string, content string"
    texts = {f"d{i}": t for i, t in skewed_texts(400).items()}
    table = lambda some: spark.createDataFrame(list(some.items()), kind)
    index = sparse.build_index(table(texts))
    for step in range(3):
        gone = {i: texts[i] for i in list(texts)[step * 7:step * 7 + 60]}
        new = {i: f"rare changed{step} the c1" for i in list(gone)[::2]} | {f"n{step}-{i}": f"the rare c{i} new{step}" for i in range(30)}
        gone |= {i: texts[i] for i in new if i in texts}
        index = sparse.update_index(index, table(gone), table(new))
        texts = {i: t for i, t in texts.items() if i not in gone} | new
    again = sparse.build_index(table(texts))
    assert (index.n_docs, index.n_tokens, round(index.avg_idf, 9)) == (again.n_docs, again.n_tokens, round(again.avg_idf, 9))
    assert rows(index.frequencies, "token", "df") == rows(again.frequencies, "token", "df")
    queries = spark.createDataFrame([(0, "rare"), (1, "the c1 changed1"), (2, "new2 c7")], "query_id long, query string")
    assert rows(sparse.search(queries, index, 20), "query_id", "doc_id", "rank", "score") == rows(sparse.search(queries, again, 20), "query_id", "doc_id", "rank", "score")


def test_empty_keyword_index(spark):
    queries = spark.createDataFrame([(0, "a")], "query_id long, query string")
    empty = spark.createDataFrame([], "doc_id long, content string")
    assert sparse.search(queries, sparse.build_index(empty), 3).count() == 0
    docs = spark.createDataFrame([(1, ""), (2, None), (3, "a")], "doc_id long, content string")
    assert sparse.search(queries.limit(0), sparse.build_index(docs), 3).count() == 0


def test_probed_buckets_by_brute_force(spark, sf, rows):
    """Cells of whole numbers: the nearest neighbours of a bucket, in every table; recall against the exact search."""
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    queries, docs = (table.select(F.col("vec_id").alias(name), "embedding") for name in ("query_id", "doc_id"))
    given = ann.sign_projections(64, 4, 2, 3000)
    found = {}
    for r in ann.search_probes(queries.filter("query_id < 20"), docs, given, 500, 4).collect():
        found.setdefault(r.query_id, set()).add(r.doc_id)
    vectors = {r.vec_id: np.floor(np.array(r.embedding, float) * 4096).astype(int) for r in table.collect()}
    places = {i: given.signs @ v for i, v in vectors.items()}
    for q in range(20):
        met = set()
        for t in range(4):
            own, left = np.divmod(places[q][t], 3000)
            around = sorted((sum(0 if s == 0 else (r if s < 0 else 3000 - r) ** 2 for s, r in zip(step, left.tolist())), step)
                            for step in itertools.product((-1, 0, 1), repeat=2))[:4]
            cells = {tuple((own + step).tolist()) for _, step in around}
            met |= {i for i, place in places.items() if tuple((place[t] // 3000).tolist()) in cells}
        assert found[q] == met
    exact = set(rows(dense.search(queries, docs, 10), "query_id", "doc_id"))
    probed = set(rows(registry.QUERIES["knn_multiprobe"](spark, sf), "query_id", "doc_id"))
    assert len(exact & probed) >= 0.9 * len(exact)


def test_probed_buckets_of_awkward_vectors(spark):
    kind = "doc_id long, embedding array<double>"
    docs = spark.createDataFrame([(1, [0.5, 0.5]), (2, None), (3, [float("nan"), 0.0]), (4, [1e300, 0.0]), (5, [0.5, 0.5])], kind)
    queries = docs.withColumnRenamed("doc_id", "query_id")
    given = ann.sign_projections(2, 3, 1, 100)
    assert sorted((r.query_id, r.doc_id) for r in ann.search_probes(queries, docs, given, 5, 3).collect()) == [(1, 1), (1, 5), (5, 1), (5, 5)]
    assert ann.search_probes(queries.limit(0), docs, given, 5, 2).count() == 0
    with pytest.raises(ValueError):
        ann.probe_cells(docs, given, 4)


def test_only_small_tables_are_dealt_out(spark, sf):
    from corpusloom.sources import tables

    path = f"{sf}/documents.parquet"
    assert "RoundRobinPartitioning" in tables.read_spread(spark, path, "doc_id")._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2kb")
    try:
        assert "RoundRobinPartitioning" not in tables.read_spread(spark, path, "doc_id")._jdf.queryExecution().executedPlan().toString()
        vectors = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), "embedding")
        plan = dense.search(vectors.withColumnRenamed("doc_id", "query_id"), vectors, 3)._jdf.queryExecution().optimizedPlan().toString()
        assert ("spark_partition_id" in plan.lower()) == (session.planned_splits(vectors) >= 64)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("name", ["knn_l2_blocks", "bm25_blocks"])
def test_large_query_tables_stay_off_the_driver(spark, sf, name):
    """One scan of each side, whatever the number of blocks, and no broadcast of queries."""
    plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroupsInArrow" not in plan and "FlatMapCoGroups" not in plan
    assert plan.split("Initial Plan")[-1].count("Scan parquet") <= 3


def test_vectors_of_other_lengths_and_nulls(spark):
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "query_id long, embedding array<float>")
    docs = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (None, [0.0, 1.0])], "doc_id long, embedding array<float>")
    assert [(r.query_id, r.doc_id) for r in dense.search(queries, docs, 3).collect()] == [(1, 1)]
    mixed = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [1.0])], "doc_id long, embedding array<float>").coalesce(1)
    with pytest.raises(Exception, match="one dimension"):
        dense.search(queries, mixed, 3).collect()


def test_no_task_counts_or_numbers_a_whole_table(spark, sf, capsys):
    from corpusloom.operators import mutate

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    mutate.positions(docs, "doc_id").explain()
    plan = capsys.readouterr().out
    for window in plan.split("Window")[1:]:
        assert "SinglePartition" not in window.split("Scan parquet")[0] or "__range" in window


def test_hits_of_many_tasks_are_reduced_in_levels(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet").repartition(12)
    queries, docs = (table.select(F.col("vec_id").alias(name), "embedding") for name in ("query_id", "doc_id"))
    plain, levels = (sorted(map(tuple, dense.search(queries, docs, 5, limits=limits).collect())) for limits in (BlockLimits(), BlockLimits(reduce_groups=3)))
    assert plain == levels


@pytest.mark.parametrize("own", [False, True])
def test_tasks_of_the_exact_search_have_bounded_pairs(spark, own):
    """Queries that are too many for a broadcast are dealt in blocks, so a task makes a bounded number of comparisons, with the same hits."""
    rng = np.random.default_rng(3)
    data = [(i, [float(x) for x in rng.integers(-3, 4, 4)]) for i in range(300)]
    docs = spark.createDataFrame(data + data[:20], "doc_id long, embedding array<float>").withColumn("metadata", F.create_map(F.lit("id"), F.col("doc_id").cast("string")))
    queries = spark.createDataFrame(data, "query_id long, embedding array<float>")
    if own:
        queries = queries.withColumn("filter", F.when(F.col("query_id") % 4 > 0, F.format_string('{"id": {"$lt": %d}}', F.col("query_id"))))
    want = dense.search(queries, docs, 5)
    limits = BlockLimits(broadcast_bytes=0, doc_rows=100, query_rows=7, task_pairs=3_000)
    kernel_hold, kernel_best = dense.VectorKernel.hold, dense.VectorKernel.best

    class Counted(dense.VectorKernel):
        def hold(self, held):
            self.pairs = 0
            kernel_hold(self, held)

        def best(self, asked, k):
            self.pairs += asked.num_rows * sum(b.num_rows for b in self.held)
            if self.pairs > 6_000:
                raise MemoryError(f"{self.pairs} comparisons in one task")
            return kernel_best(self, asked, k)

    dense.VectorKernel, before = Counted, dense.VectorKernel
    try:
        found = dense.search(queries, docs, 5, limits=limits)
    finally:
        dense.VectorKernel = before
    columns = ("query_id", "rank", "distance", "doc_id")
    assert sorted(map(tuple, found.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))


def test_copies_of_queries_do_not_grow_with_the_documents(spark, monkeypatch):
    """Beyond a broadcast, queries go to a fixed number of parts; more parts are made only to keep their bytes."""
    from corpusloom.operators import block_topk

    rng = np.random.default_rng(5)
    data = [(i, [float(x) for x in rng.integers(-3, 4, 4)]) for i in range(900)]
    docs = spark.createDataFrame(data + data[:20], "doc_id long, embedding array<float>")
    queries = spark.createDataFrame(data[:300], "query_id long, embedding array<float>")
    parts, paired = [], block_topk.paired_topk

    def counted(queries, docs, n_parts, *rest):
        parts.append(n_parts)
        return paired(queries, docs, n_parts, *rest)

    monkeypatch.setattr(block_topk, "paired_topk", counted)
    columns = ("query_id", "rank", "doc_id", "distance")
    want = sorted(map(tuple, dense.search(queries, docs, 5).select(*columns).collect()))
    for limits in (BlockLimits(broadcast_bytes=0, doc_rows=10, query_rows=7), BlockLimits(broadcast_bytes=0, doc_rows=10, query_rows=7, doc_bytes=920 * 32 // 40)):
        assert sorted(map(tuple, dense.search(queries, docs, 5, limits=limits).select(*columns).collect())) == want
    assert parts == [24, 40]


@pytest.mark.parametrize("own", [False, True])
def test_a_broadcast_meets_the_documents_in_blocks(spark, monkeypatch, own):
    """Queries that fit a broadcast are searched in blocks of bounded size, against a bounded number of documents at a time."""
    rng = np.random.default_rng(4)
    data = [(i, [float(x) for x in rng.integers(-3, 4, 4)]) for i in range(300)]
    docs = spark.createDataFrame(data + data[:20], "doc_id long, embedding array<float>").withColumn("metadata", F.create_map(F.lit("id"), F.col("doc_id").cast("string"))).coalesce(1)
    queries = spark.createDataFrame(data, "query_id long, embedding array<float>")
    if own:
        queries = queries.withColumn("filter", F.when(F.col("query_id") % 4 > 0, F.format_string('{"id": {"$lt": %d}}', F.col("query_id"))))
    columns = ("query_id", "rank", "doc_id", "distance")
    want = sorted(map(tuple, dense.search(queries, docs, 5).select(*columns).collect()))
    kernel_load, kernel_hold = dense.VectorKernel.load, dense.VectorKernel.hold

    class Bounded(dense.VectorKernel):
        def load(self, asked):
            if asked.num_rows > 40:
                raise MemoryError(f"{asked.num_rows} queries at once")
            kernel_load(self, asked)

        def hold(self, held):
            if not 0 < sum(b.num_rows for b in held) <= 100:
                raise MemoryError("too many documents at once")
            kernel_hold(self, held)

    monkeypatch.setattr(dense, "VectorKernel", Bounded)
    found = dense.search(queries, docs, 5, limits=BlockLimits(doc_rows=100, query_rows=40))
    assert sorted(map(tuple, found.select(*columns).collect())) == want
