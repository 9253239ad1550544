"""Workflows, evaluation, streams, and every registered query against its SQL."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import hooks
from corpusloom.operators import evaluate, sparse
from corpusloom.plans import evaluation, registry, workflow
from corpusloom.plans.oracle import ORACLE
from corpusloom.plans.retrieve import Corpus
from corpusloom.schemas import ModelSpec, RetrievalParams
from corpusloom.sources import tables
from corpusloom.streaming import jobs


def step(agent, fails=False):
    return workflow.column_step(agent, "do", lambda task, _: F.concat(task, F.lit(f">{agent}")),
                                (lambda task, _: F.lit(f"{agent} broke")) if fails else None)


def requests(spark, *texts):
    return workflow.requests(spark.createDataFrame(list(enumerate(texts)), "id long, t string"), "id", "t")


def test_sequential_failure(spark):
    row = workflow.sequential(requests(spark, "in"), [step("a"), step("b", True), step("c")]).first()
    assert (row.success, row.error, row.outputs) == (False, "b broke", {"a": "in>a"})
    assert [tuple(s) for s in row.step_results] == [("a", "do", True, "in>a"), ("b", "do", False, "")]


def test_sequential_chains_outputs(spark):
    row = workflow.sequential(requests(spark, "in"), [step("a"), step("b"), step("a")]).first()
    assert (row.success, row.error) == (True, None)
    assert row.outputs == {"a": "in>a>b>a", "b": "in>a>b"}


def test_parallel_failure(spark):
    row = workflow.parallel(requests(spark, "in"), [step("a", True), step("b"), step("c", True)]).first()
    assert (row.success, row.error, row.outputs) == (False, "a broke", {"b": "in>b"})
    assert [(s.agent, s.success) for s in row.step_results] == [("a", False), ("b", True), ("c", False)]


def test_invalid_input_is_an_error_row(spark):
    found = {r.request_id: (r.success, r.error) for r in workflow.sequential(requests(spark, "", " "), [step("a")]).collect()}
    assert found == {0: (False, "Invalid input message"), 1: (True, None)}


def test_steps_are_required(spark):
    for run in (workflow.sequential, workflow.parallel):
        with pytest.raises(ValueError):
            run(requests(spark, "x"), [])


def test_no_shuffle_in_step_workflows(spark):
    plan = workflow.sequential(requests(spark, "x"), [step("a"), step("b")])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_model_step(spark):
    def factory(spec):
        def model(prompt):
            if "fail" in prompt:
                raise ValueError("no")
            return f"[{spec.system_prompt}] {prompt}"
        return model

    steps = [workflow.model_step("m", "ask", factory, ModelSpec(system_prompt="S"))]
    found = {r.request_id: r for r in workflow.sequential(requests(spark, "hi", "fail"), steps).collect()}
    assert found[0].outputs == {"m": "[S] User: hi"}
    assert (found[1].success, found[1].error) == (False, "no")
    repeated = [workflow.model_step("m", "ask", factory, ModelSpec(system_prompt="S"), compat=True)]
    assert workflow.parallel(requests(spark, "hi"), repeated).first().outputs == {"m": "[S] System: S\n\nUser: hi"}


def rag(spark, *questions):
    docs = spark.createDataFrame([(1, "Cats purr. They sleep."), (2, "Dogs bark loudly."), (3, "Fish swim in water.")],
                                 "doc_id long, content string").withColumn("metadata", F.create_map(F.lit("k"), F.lit("v")))
    vectors = hooks.embed_column(docs, hooks.hashed_tokens(64)).select("doc_id", "embedding")
    full = Corpus(docs, vectors, None, sparse.build_index(docs))
    return workflow.retrieve_then_generate(requests(spark, *questions), full, hooks.hashed_tokens(64), hooks.first_hit(),
                                           RetrievalParams(top_k=1))


def test_retrieve_then_generate(spark):
    found = {r.request_id: r for r in tables.answers(rag(spark, "do cats purr.", "")).collect()}
    assert found[0].answer == "Cats purr. They sleep."
    assert found[0].retrieved_context.startswith("Retrieved Information:\n\n1. [Score: 0.03]\n   Cats purr.")
    assert [(s.agent, s.action, s.success) for s in found[0].step_results] == [("retriever", "retrieve", True), ("generator", "generate", True)]
    assert (found[1].success, found[1].answer, found[1].retrieved_context, found[1].error) == (False, "", "", "Invalid input message")
    assert len(found[1].step_results) == 1


def test_failed_generation_keeps_the_retrieval(spark):
    docs = spark.createDataFrame([(1, "text")], "doc_id long, content string").withColumn("metadata", F.create_map().cast("map<string,string>"))
    vectors = hooks.embed_column(docs, hooks.hashed_tokens(8)).select("doc_id", "embedding")

    def broken(spec):
        def model(prompt):
            raise RuntimeError("down")
        return model

    row = workflow.retrieve_then_generate(requests(spark, "q"), Corpus(docs, vectors), hooks.hashed_tokens(8), broken,
                                          RetrievalParams(top_k=1, threshold=-9.0)).first()
    assert (row.success, row.error, sorted(row.outputs)) == (False, "down", ["retrieval"])


def test_golden_rows_skip_failures(spark, rows):
    results = rag(spark, "do cats purr.", "")
    golden = spark.createDataFrame([(0, "do cats purr.", "Cats purr."), (1, "", "none")], "question_id long, question string, ground_truth string")
    assert rows(evaluation.golden_rows(golden, results), "question_id", "contexts") == [(0, ["Cats purr. They sleep."])]
    counts = evaluation.run_counts(results)
    assert tuple(counts.first()) == (1, 1)
    evaluation.require_success(counts)
    with pytest.raises(ValueError):
        evaluation.require_success(evaluation.run_counts(results.filter("not success")))


def test_context_precision(spark):
    verdicts = spark.createDataFrame([(1, 3, 1), (1, 1, 1), (1, 2, 0), (2, 1, 0)], "question_id long, rank long, relevant int")
    found = {r[0]: r[1] for r in evaluate.context_precision(verdicts).collect()}
    assert found[1] == pytest.approx((1 + 2 / 3) / 2)
    assert found[2] == 0.0


def test_means_skip_gaps(spark):
    data = [(1, 1.0, None, 0.0, 0.0), (2, math.nan, None, 0.0, 0.0), (3, None, None, 0.0, 0.0), (4, 3.0, None, 0.0, 0.0)]
    scores = spark.createDataFrame(data, "question_id long, faithfulness double, answer_relevancy double, context_precision double, context_recall double")
    row = evaluate.means(scores).first()
    assert (row.faithfulness, row.answer_relevancy, row.n_questions) == (2.0, None, 4)


def test_lexical_judge(spark):
    data = [(1, "do cats purr", "Cats purr. Zebras fly high!", ["Cats purr at night.", "Other"], "Cats purr"),
            (2, "what", "No relevant information found.", [""], "Something")]
    rows = spark.createDataFrame(data, "question_id long, question string, answer string, contexts array<string>, ground_truth string")
    found = {r.question_id: r for r in evaluate.lexical_metrics(rows, hooks.hashed_tokens(64)).collect()}
    assert (found[1].faithfulness, found[1].context_precision, found[1].context_recall) == (0.5, 1.0, 1.0)
    assert 0 < found[1].answer_relevancy < 1
    assert (found[2].faithfulness, found[2].answer_relevancy, found[2].context_precision, found[2].context_recall) == (0.0, 0.0, 0.0, 0.0)


def test_judge_hook(spark):
    """Verdicts of every kind become rows, failures too, and a failed kind gives no metric."""
    data = [(1, "do cats purr", "Cats purr. Zebras fly high!", ["Cats purr at night.", "Other"], "Cats purr"),
            (2, "boom", "a b", ["a"], "a"), (3, "odd", "a", ["a"], "a"), (4, "nothing", "", [""], "")]
    rows = spark.createDataFrame(data, "question_id long, question string, answer string, contexts array<string>, ground_truth string").repartition(2)

    def factory(spec):
        ask = evaluate.token_judge()(spec)

        def judge(kind, row):
            if row["question"] == "boom" and kind != "context":
                raise RuntimeError(f"no {kind}")
            return [("a", 7)] if row["question"] == "odd" and kind == "sentence" else ask(kind, row)

        return judge

    verdicts = evaluate.judge(rows, factory)
    found = {(r.question_id, r.kind, r.idx): (r.text, r.verdict, r.error) for r in verdicts.collect()}
    assert found[1, "statement", 0] == ("Cats purr", 1, None) and found[1, "statement", 1] == ("Zebras fly high", 0, None)
    assert found[2, "statement", None] == (None, None, "no statement") and found[3, "sentence", None][2] == "a verdict is 0 or 1"
    scores = {r.question_id: r for r in evaluate.judged_metrics(rows, verdicts, hooks.hashed_tokens(64)).collect()}
    lexical = {r.question_id: r for r in evaluate.lexical_metrics(rows, hooks.hashed_tokens(64)).collect()}
    assert scores[1] == lexical[1]
    assert (scores[2].faithfulness, scores[2].answer_relevancy, scores[2].context_recall, scores[2].context_precision) == (None, None, None, 1.0)
    assert (scores[3].context_recall, scores[3].faithfulness, scores[4].faithfulness) == (None, 1.0, None)


def test_stream_replaces_and_resumes(spark, tmp_path, rows):
    part = lambda *data: spark.createDataFrame(list(data), "doc_id string, content string, metadata map<string,string>, embedding array<float>, content_key string")
    inbox, out, state = (str(tmp_path / name) for name in ("in", "out", "state"))
    for wave in (part(("a", "one", None, None, "1"), ("b", "two", None, [], "2")), part(("a", "three", None, [1.0] * 8, "3"))):
        jobs.write_part(wave.coalesce(1), inbox)
        jobs.run(jobs.ingest(jobs.file_stream(spark, inbox, wave), out, state, "s", hooks.hashed_tokens(8), 8))
    assert rows(jobs.latest(spark, out), "doc_id", "content", F.size("embedding")) == [("a", "three", 8), ("b", "two", 8)]
    assert rows(spark.read.parquet(jobs.version(out, 0)), "doc_id", "content") == [("a", "one"), ("b", "two")]


@pytest.mark.parametrize("bound", [64 << 20, 0])
def test_a_batch_stores_its_own_rows_only(spark, tmp_path, rows, monkeypatch, bound):
    """What a stream keeps grows with what arrives, not with the collection in each batch; every state can still be read."""
    monkeypatch.setattr(jobs, "BROADCAST_KEY_BYTES", bound, raising=False)
    kind = "doc_id string, content string, metadata map<string,string>, embedding array<float>"
    inbox, out, state = (str(tmp_path / name) for name in ("in", "out", "state"))
    waves = [[(str(i), f"text {i}") for i in range(100)], [("5", "changed"), ("100", "new")], [("5", "again")], [(None, "no id")]]
    for wave in waves:
        part = spark.createDataFrame([(i, text, {"a": "b"}, None) for i, text in wave], kind)
        jobs.write_part(part.coalesce(1), inbox)
        jobs.run(jobs.ingest(jobs.file_stream(spark, inbox, part), out, state, "s", hooks.hashed_tokens(8), 8))
    assert spark.read.parquet(out).count() == sum(map(len, waves))
    found = {r.doc_id: r.content for r in jobs.latest(spark, out).collect()}
    assert len(found) == 102 and jobs.latest(spark, out).count() == 102
    assert (found["5"], found["6"], found["100"]) == ("again", "text 6", "new") and "no id" in found.values()
    assert {r.content for r in jobs.latest(spark, out, 1).filter("doc_id in (5, 6, 100)").collect()} == {"changed", "text 6", "new"}
    assert jobs.latest(spark, out, 0).count() == 100
    assert jobs.latest(spark, out).schema == spark.read.parquet(jobs.version(out, 0)).schema


def test_stream_totals_over_batches(spark, tmp_path, rows):
    inbox, out, state = (str(tmp_path / name) for name in ("in", "out", "state"))
    for conv, text in ((1, "abc"), (2, "x"), (1, "defgh")):
        wave = spark.createDataFrame([(conv, 0, "user", text)], "conv_id long, turn long, role string, text string")
        jobs.write_part(wave.coalesce(1), inbox)
        jobs.run(jobs.stream_token_totals(jobs.file_stream(spark, inbox, wave), out, state))
    assert rows(jobs.latest_totals(spark, out), "conv_id", "n_messages", "n_chars", "est_tokens") == [(1, 2, 8, 2), (2, 1, 1, 0)]
    plan = jobs.latest_totals(spark, out)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(version" in plan, "earlier versions are not read"


@pytest.fixture(scope="module")
def duck(sf):
    connection = duckdb.connect()
    for file in os.listdir(sf):
        connection.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{file}'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, sf, duck, name):
    found = registry.QUERIES[name](spark, sf)
    columns = sorted(found.columns)
    cursor = duck.execute(ORACLE[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    want = [tuple(row[names.index(c)] for c in columns) for row in cursor.fetchall()]
    assert sorted(map(tuple, found.select(*columns).collect()), key=repr) == sorted(want, key=repr)


def test_vectors_become_cells_after_the_join(spark, sf):
    """The join of stored rows with their batches moves a vector once, not a row for each of its cells."""
    plan = registry.QUERIES["collection_add"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate posexplode") < plan.index("Join ")


def test_a_task_numbers_one_range(spark):
    """Ranges are dealt one to a task: no task has several while others have none."""
    from corpusloom.operators import mutate

    df = spark.range(16_000).withColumn("key", F.col("id") * 7 % 16_001)
    found = mutate.positions(df, "key").withColumn("task", F.spark_partition_id())
    sizes = [r["count"] for r in found.groupBy("task").count().collect()]
    assert len(sizes) == spark.sparkContext.defaultParallelism and max(sizes) <= 1.5 * 16_000 / len(sizes)
    assert [r.key for r in found.orderBy("position").collect()] == sorted(r.key for r in df.collect())
