"""Collections, keyed changes, rank fusion, reranking and retrieval."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import hooks
from corpusloom.operators import fusion, mutate, rerank, sparse
from corpusloom.plans.retrieve import Corpus, retrieve
from corpusloom.schemas import RetrievalParams
from corpusloom.sources import collection

EMBED = hooks.hashed_tokens(8)


def docs(spark, *rows):
    return spark.createDataFrame(list(rows), "doc_id string, content string, pos long")


def test_a_batch_meets_buckets_without_moving_them(spark, tmp_path, rows):
    stored = docs(spark, *[(f"d{i}", f"old {i}", i) for i in range(60)], ("d3", "copy", 60), (None, "no id", 61))
    current = collection.save_buckets(stored.drop("pos"), str(tmp_path / "v0"), 4)
    batch = docs(spark, ("d3", "first", 0), ("d3", "last", 1), ("new", "added", 2), ("d59", "", 3))
    merged = collection.merge_buckets(current, batch, str(tmp_path / "v1"), 4, "pos")
    wanted = sorted([(f"d{i}", f"old {i}") for i in range(59) if i != 3] + [("d3", "last"), ("new", "added"), ("d59", ""), (None, "no id")], key=repr)
    assert rows(merged, "doc_id", "content") == wanted
    again = collection.load_buckets(spark, str(tmp_path / "v1"), 4)
    assert rows(again, "doc_id", "content") == wanted
    assert rows(collection.merge_buckets(again, batch.limit(0), str(tmp_path / "v2"), 4, "pos"), "doc_id", "content") == wanted
    kept = again.join(batch.select("doc_id").hint("merge"), "doc_id", "left_anti")
    plan = kept._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    stored_side = plan[:plan.index("Scan ExistingRDD")] if plan.index("Bucketed: true") < plan.index("Scan ExistingRDD") else plan[plan.index("Scan ExistingRDD"):]
    assert plan.count("Exchange") == 1 and "Exchange" not in stored_side.split("Bucketed: true")[0]


def test_positions_without_one_big_sort(spark, rows):
    df = spark.range(0, 1000).select((F.col("id") * 7 - 300).alias("key"))
    found = rows(mutate.positions(df, "key", range_rows=90), "key", "position")
    assert sorted(found) == [(i * 7 - 300, i) for i in range(1000)]


@pytest.mark.parametrize("key", ["cast(1000 - id as string)", "timestamp_seconds(5000 - id)", "cast(id * id as decimal(12, 2))", "cast(id / 3 as double)",
                                 "cast(id as int)", "make_dt_interval(0, 0, 0, id)"])
def test_positions_of_any_order(spark, key):
    """Keys of other types, a null key, a map beside them; no join, and rows move once."""
    df = spark.range(400).repartition(5).select(F.expr(f"if(id = 7, null, {key})").alias("key"), F.create_map(F.lit("a"), F.col("id")).alias("metadata"))
    placed = mutate.positions(df, "key", range_rows=30)
    wanted = [r.key for r in df.filter("key is not null").orderBy("key").collect()]
    assert [r.key for r in placed.filter("position is not null").orderBy("position").collect()] == wanted
    assert sorted(r.position for r in placed.filter("key is not null").collect()) == list(range(399))
    assert [r.metadata["a"] for r in placed.filter("position is null").collect()] == [7]
    plan = placed._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert "Join" not in plan and plan.count("hashpartitioning") == 1


def test_positions_of_few_and_of_no_rows(spark):
    for n in (0, 1, 3):
        found = mutate.positions(spark.range(n).withColumnRenamed("id", "key"), "key").collect()
        assert sorted(r.position for r in found) == list(range(n))


def test_id_policies(spark, rows):
    batch = docs(spark, (None, "a", 0), ("mine", "b", 1), ("", "a", 2))
    named = lambda *a, **k: [r.doc_id for r in mutate.assign_ids(batch, *a, **k).orderBy("pos").collect()]
    assert named("batch", "pos") == ["doc_0", "mine", "doc_2"]
    assert named("counter", "pos", next_id=10) == ["doc_10", "mine", "doc_12"]
    hashed = named("hash")
    assert hashed[0] == hashed[2] and len(hashed[0]) == 64 and hashed == named("hash")
    made = named("uuid")
    assert made[1] == "mine" and len({*made}) == 3
    with pytest.raises(ValueError):
        mutate.assign_ids(batch, "other")


def test_embedding_fill(spark):
    df = spark.createDataFrame([("a", "x", [9.0]), ("b", "x", []), ("c", "x", None), ("d", "", None)],
                               "doc_id string, content string, embedding array<float>")
    found = {r.doc_id: r.embedding for r in mutate.fill_embeddings(df, EMBED).collect()}
    assert found["a"] == [9.0]
    assert found["b"] == found["c"] and sum(v * v for v in found["b"]) == pytest.approx(1)
    assert found["d"] == [0.0] * 8


def test_insert_upsert_delete(spark, rows):
    current = docs(spark, ("a", "1", 0), ("b", "2", 0)).drop("pos")
    batch = docs(spark, ("b", "new", 0), ("c", "first", 1), ("c", "last", 2))
    assert rows(mutate.insert_if_absent(current, batch, "pos"), "doc_id", "content") == [("a", "1"), ("b", "2"), ("c", "first")]
    after = mutate.upsert(current, batch, "pos")
    assert rows(after, "doc_id", "content") == [("a", "1"), ("b", "new"), ("c", "last")]
    assert rows(mutate.upsert(after, batch, "pos"), "doc_id", "content") == rows(after, "doc_id", "content")
    assert len(rows(mutate.append(current, batch.drop("pos")), "doc_id")) == 5
    ids = mutate.parse_ids(spark.createDataFrame([("a, zz , a",)], "ids string"), "ids")
    assert rows(mutate.delete(current, ids), "doc_id") == [("b",)]
    assert tuple(mutate.delete_report(current, ids).first()) == (3, 1)


def test_update_modes(spark, rows):
    current = spark.createDataFrame([("a", "old", {"k": "1"}, [1.0])], "doc_id string, content string, metadata map<string,string>, embedding array<float>")
    changes = spark.createDataFrame([("a", "new", {"k": "2"}, None), ("z", "more", {}, None)], current.schema)
    found = lambda mode: rows(mutate.update(current, changes, mode, EMBED), "doc_id", "content", F.size("embedding"))
    assert found("existing") == [("a", "new", 8)]
    assert found("upsert") == [("a", "new", 8), ("z", "more", 8)]
    assert found("payload_only") == [("a", "new", 1)]
    assert rows(mutate.update_report(current, changes, "existing"), "doc_id", "updated") == [("a", True), ("z", False)]
    assert rows(mutate.update_report(current, changes, "upsert"), "doc_id", "updated") == [("a", True), ("z", True)]
    with pytest.raises(ValueError):
        mutate.update(current, changes, "other")


def test_payload_clash(spark):
    meta = F.create_map(F.lit("content"), F.lit("meta"), F.lit("k"), F.lit("v"))
    columns = []
    for wins in ("metadata", "content"):
        columns += mutate.from_payload(mutate.to_payload(F.lit("text"), meta, wins))
    row = spark.range(1).select(*columns).first()
    assert tuple(row) == ("meta", {"k": "v"}, "text", {"k": "v"})
    content, rest = mutate.from_payload(F.create_map(F.lit("k"), F.lit("v")))
    assert tuple(spark.range(1).select(content, rest).first()) == ("", {"k": "v"})


def test_dimension_and_stats(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0]), ("c", None)], "doc_id string, embedding array<float>")
    good, bad = mutate.split_by_dimension(df, 2)
    assert ([r.doc_id for r in good.collect()], sorted(r.doc_id for r in bad.collect())) == (["a"], ["b", "c"])
    assert tuple(mutate.stats(df, "n").first()) == ("n", 3, 2, 2, "flat", "parquet")


def test_collection_versions(spark, tmp_path, rows):
    """Each change is a version of its own; a reader keeps the one it reads."""
    new = lambda *data: collection.complete(docs(spark, *data), "pos")
    assert collection.load(spark, None).count() == 0
    one = collection.save(mutate.upsert(collection.load(spark, None), new(("a", "1", 0), ("b", "2", 1)), "pos"), str(tmp_path / "1"))
    two = collection.save(mutate.delete(one, spark.createDataFrame([("a",), ("unknown",)], "doc_id string")), str(tmp_path / "2"))
    three = collection.save(mutate.insert_if_absent(two, new(("b", "ignored", 0), ("c", "3", 1)), "pos"), str(tmp_path / "3"))
    four = collection.save(mutate.upsert(three, new(("a", "again", 0), ("b", "4", 1)), "pos"), str(tmp_path / "4"))
    assert [rows(v, "doc_id", "content") for v in (one, two, three, four)] == [
        [("a", "1"), ("b", "2")], [("b", "2")], [("b", "2"), ("c", "3")], [("a", "again"), ("b", "4"), ("c", "3")]]
    assert rows(collection.load(spark, str(tmp_path / "2")), "doc_id") == [("b",)]
    assert mutate.stats(four, "c").first()["document_count"] == 3


def test_batches_get_ids_and_keep_every_row(spark, tmp_path, rows):
    batch = docs(spark, (None, "x", 0), (None, "y", 1), ("mine", "old", 2), ("mine", "new", 3), (None, "x", 4))
    first = collection.complete(batch, "pos", EMBED, ids="counter", dimension=8)
    assert rows(first, "pos", "doc_id") == [(0, "doc_0"), (1, "doc_1"), (2, "mine"), (3, "mine"), (4, "doc_4")]
    stored = collection.save(mutate.one_per_id(first, "pos"), str(tmp_path / "1"))
    assert rows(stored, "doc_id", "content") == [("doc_0", "x"), ("doc_1", "y"), ("doc_4", "x"), ("mine", "new")]
    assert rows(collection.complete(batch.limit(1).drop("doc_id"), "pos", EMBED, ids="counter", next_id=5), "doc_id") == [("doc_5",)]
    hashed = collection.complete(batch.filter("doc_id is null"), "pos", EMBED)
    assert mutate.upsert(stored, hashed, "pos").count() == 6, "the same text has the same hashed id"


def test_appended_and_updated_versions(spark, tmp_path, rows):
    new = lambda *data: collection.complete(docs(spark, *data), "pos")
    both = mutate.append(collection.save(new(("a", "1", 0), ("b", "2", 1)), str(tmp_path / "1")), new(("a", "again", 0)).drop("pos"))
    assert rows(both, "doc_id", "content") == [("a", "1"), ("a", "again"), ("b", "2")]
    changed = mutate.update(both, new(("a", "x", 0), ("a", "y", 1), ("z", "none", 0)), "existing", EMBED, order="pos")
    assert rows(changed, "doc_id", "content", F.size("embedding")) == [("a", "y", 8), ("b", "2", None)]
    kept = mutate.update(changed, new(("a", "p", 0)), "payload_only", order="pos")
    assert rows(kept.filter("doc_id = 'a'"), "content", F.size("embedding"), "content_key") == [("p", 8, new(("a", "p", 0)).first().content_key)]
    with pytest.raises(ValueError):
        mutate.update(both, new(("a", "p", 0)), "other")


def test_batches_are_checked_for_their_dimension(spark, tmp_path):
    bad = spark.createDataFrame([("a", "1", [1.0], 0)], "doc_id string, content string, embedding array<float>, pos long")
    with pytest.raises(Exception, match="expected 2 values"):
        collection.save(collection.complete(bad, "pos", dimension=2), str(tmp_path / "1"))


def test_rows_without_id_and_repeated_changes(spark):
    current = docs(spark, ("a", "1", 0)).drop("pos")
    with pytest.raises(Exception, match="without doc_id"):
        mutate.upsert(current, docs(spark, (None, "x", 0)), "pos").collect()
    changes = docs(spark, ("a", "x", 0), ("a", "y", 1))
    with pytest.raises(ValueError, match="repeat an id"):
        mutate.update(current, changes.drop("pos"), "existing")
    assert [tuple(r) for r in mutate.update(current, changes, "existing", order="pos").collect()] == [("a", "y")]


HITS = "query_id long, list_idx int, rank long, doc_id long, content_key string, distance double"


def test_fusion_by_hand(spark):
    lists = spark.createDataFrame([(1, 0, 1, 10, "x", 0.1), (1, 0, 2, 11, "y", 0.2), (1, 1, 1, 21, "y", 0.3), (1, 1, 2, 22, "z", 0.4)], HITS)
    found = [(r.content_key, r.doc_id, r.score, r.distance) for r in fusion.fuse(lists).orderBy("rank").collect()]
    assert found == [("y", 11, 1 / 62 + 1 / 61, 0.2), ("x", 10, 1 / 61, 0.1), ("z", 22, 1 / 62, 0.4)]


def test_fusion_duplicates_and_ties(spark):
    twice = spark.createDataFrame([(1, 0, 1, 10, "x", None), (1, 0, 2, 12, "x", None), (1, 0, 3, 11, "y", None)], HITS)
    found = [(r.content_key, r.doc_id, r.score) for r in fusion.fuse(twice).orderBy("rank").collect()]
    assert found == [("x", 10, 1 / 61 + 1 / 62), ("y", 11, 1 / 63)]
    tie = spark.createDataFrame([(1, 1, 1, 2, "y", None), (1, 0, 1, 1, "x", None)], HITS)
    assert [r.content_key for r in fusion.fuse(tie).orderBy("rank").collect()] == ["x", "y"]


def test_single_list_passes_through(spark, rows):
    one = spark.createDataFrame([(1, 0, 1, 10, "x", 0.5), (1, 0, 2, 11, "x", 0.6)], HITS).withColumn("score", F.col("distance"))
    assert rows(fusion.fuse_or_pass(one, 1), "doc_id", "rank", "score") == [(10, 1, 0.5), (11, 2, 0.6)]


def rrf(lists, k=60):
    """Restated on plain lists of (content, doc_id)."""
    total, first = {}, {}
    for ranked in lists:
        for rank, (content, doc) in enumerate(ranked, 1):
            total[content] = total.get(content, 0.0) + 1.0 / (k + rank)
            first.setdefault(content, doc)
    return [(first[c], total[c]) for c in sorted(total, key=lambda c: -total[c])]


def test_fusion_of_random_lists_in_any_row_order(spark):
    rng = random.Random(7)
    lists = [[(f"c{rng.randrange(30)}", 100 * i + j) for j in range(40)] for i in range(3)]
    table = [(1, i, j + 1, doc, content, None) for i, ranked in enumerate(lists) for j, (content, doc) in enumerate(ranked)]
    for seed in range(2):
        random.Random(seed).shuffle(table)
        found = fusion.fuse(spark.createDataFrame(table, HITS)).orderBy("rank").collect()
        assert [(r.doc_id, r.score) for r in found] == rrf(lists)


def test_rerank_is_stable_and_cuts(spark):
    data = [(1, 1, 10, 0.1, "q", "aa"), (1, 2, 11, 0.2, "q", "bbb"), (1, 3, 12, 0.3, "q", "cc")]
    pairs = spark.createDataFrame(data, "query_id long, rank long, doc_id long, score double, query string, content string")
    longest = lambda: lambda queries, texts: [len(t) for t in texts]
    found = [(r.doc_id, r.rank, r.score) for r in rerank.rerank(pairs, 2, longest).orderBy("rank").collect()]
    assert found == [(11, 1, 3.0), (10, 2, 2.0)]
    assert [r.doc_id for r in rerank.rerank(pairs, 2).orderBy("rank").collect()] == [10, 11]


KNOWLEDGE = [
    (1, "Transformers use self-attention mechanisms"), (2, "BERT uses masked language modeling for pre-training"),
    (3, "GPT predicts the next token with a decoder"), (4, "Vision models treat image patches as tokens"),
    (5, "BERT uses masked language modeling for pre-training"),
]


def corpus(spark, keywords=True, secondary=False):
    table = spark.createDataFrame(KNOWLEDGE, "doc_id long, content string").withColumn(
        "metadata", F.create_map(F.lit("kind"), F.when(F.col("doc_id") > 3, "b").otherwise("a")))
    vectors = hooks.embed_column(table, hooks.hashed_tokens(64)).drop("content")
    return Corpus(table, vectors, vectors if secondary else None, sparse.build_index(table) if keywords else None)


def ask(spark, *queries):
    df = spark.createDataFrame(list(enumerate(queries)), "query_id long, query string")
    return hooks.embed_column(df, hooks.hashed_tokens(64), "query")


def test_plain_path_uses_the_threshold(spark, rows):
    question = ask(spark, "masked language modeling", "zzz")
    plain = corpus(spark, keywords=False)
    loose = retrieve(question, plain, RetrievalParams(top_k=2, threshold=-9.0))
    assert rows(loose.filter("query_id = 0"), "rank", "doc_id") == [(1, 2), (2, 5)]
    strict = retrieve(question, plain, RetrievalParams(top_k=2, threshold=0.1))
    assert rows(strict, "query_id") == [(0,), (0,)]


def test_hybrid_merges_equal_contents(spark, rows):
    hits = retrieve(ask(spark, "masked language modeling"), corpus(spark, secondary=True), RetrievalParams(top_k=3))
    found = rows(hits, "rank", "doc_id", "content")
    assert found[0] == (1, 2, KNOWLEDGE[1][1])
    assert len({content for _, _, content in found}) == len(found) == 3


def test_keyword_hits_pass_the_filter(spark, rows):
    params = RetrievalParams(top_k=5)
    keep = lambda metadata: metadata["kind"] == "b"
    question, full = ask(spark, "decoder token"), corpus(spark)
    assert (3,) in rows(retrieve(question, full, params, keep=keep), "doc_id")
    strict = RetrievalParams(top_k=5, bm25_respects_filter=True)
    assert rows(retrieve(question, full, strict, keep=keep), "doc_id") == [(4,), (5,)]
