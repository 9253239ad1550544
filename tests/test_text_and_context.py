"""Text functions, filters, contexts, prompts and conversations."""

import json

import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from corpusloom.functions import filters, hooks, text
from corpusloom.operators import chat, context, evaluate
from corpusloom.plans import registry
from corpusloom.schemas import ModelSpec
from corpusloom.sources import tables


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize("value", ["", "  ", "Hello World", "\xa0a\xa0b\x1cc\t d\n", "a,b  C. ", " x y　z", "\x85q\x0bz"])
def test_tokens_split_as_python_does(spark, value):
    df = spark.createDataFrame([(value,)], "t string").select(text.tokens(F.col("t")), text.strip(F.col("t")))
    row = df.first()
    assert row[0] == value.lower().split()
    assert row[1] == value.strip()


def test_two_decimals(spark):
    values = [0.125, 2.675, 1234567.891, -0.5, 0.0, 12.345]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", text.two_decimals(F.col("v")).alias("s"))
    assert all(r.s == f"{r.v:.2f}" for r in df.collect())


def test_valid_input(spark):
    df = spark.createDataFrame([(None,), ("",), (" ",), ("Test",)], "t string").select(text.is_valid_input(F.col("t")).alias("v"))
    assert [r.v for r in df.collect()] == [False, False, True, True]


def test_missing_key_in_filters(spark):
    df = spark.createDataFrame([(1, {"topic": "ai"}), (2, {"other": "x"})], "id long, m map<string,string>")
    look = filters.map_lookup("m")
    ids = lambda condition: [r.id for r in df.filter(condition).orderBy("id").collect()]
    assert ids(filters.equals_all_null_safe({"topic": None}, look)) == [2]
    assert ids(filters.equals_all({"topic": None}, look)) == []
    assert ids(filters.equals_all({"topic": "ai"}, look)) == [1]
    assert ids(filters.equals_all({}, look)) == [1, 2]


def test_filter_operators(spark):
    df = spark.createDataFrame([(1, '{"n": 1, "s": "a"}'), (2, '{"n": 5, "s": "b", "f": true}'), (3, '{"s": "c"}')], "id long, j string")
    df = df.withColumn("v", F.try_parse_json("j"))
    look = filters.variant_lookup("v")
    ids = lambda f: [r.id for r in df.filter(filters.translate(f, look)).orderBy("id").collect()]
    assert ids({"n": {"$gte": 1, "$lt": 5}}) == [1]
    assert ids({"n": {"$ne": 1}}) == [2, 3]
    assert ids({"n": {"$nin": [5]}}) == [1, 3]
    assert ids({"$or": [{"s": "c"}, {"n": {"$gt": 4.5}}]}) == [2, 3]
    assert ids({"$and": [{"s": {"$in": ["a", "b"]}}, {"n": {"$lte": 1}}]}) == [1]
    assert ids({"f": True}) == [2]
    for wrong in ({"n": {"$near": 1}}, {"$not": []}):
        with pytest.raises(ValueError):
            filters.translate(wrong, look)


def test_typed_filters(spark):
    data = [(1, '{"k": 10, "a.b": 1}', "10"), (2, '{"k": 10.5, "a": {"b": 1}}', "10.5"), (3, '{"k": "10", "it\'s": 2}', "yes"), (4, '{"k": true}', "true")]
    df = spark.createDataFrame(data, "id long, j string, t string").select("id", F.try_parse_json("j").alias("v"), F.create_map(F.lit("k"), "t").alias("m"))
    variant, strings = filters.variant_lookup("v"), filters.map_lookup("m")
    ids = lambda f, look=variant: [r.id for r in df.filter(filters.translate(f, look)).orderBy("id").collect()]
    assert (ids({"k": 10}), ids({"k": {"$gt": 10}}), ids({"k": "10"}), ids({"k": True})) == ([1], [2], [3], [4])
    assert (ids({"k": {"$in": [10, "10"]}}), ids({"k": {"$nin": [10.5, True]}}), ids({"a.b": 1}), ids({"it's": 2})) == ([1, 3], [1, 3], [1], [3])
    assert (ids({"k": {"$gt": 10}}, strings), ids({"k": True}, strings), ids({"k": "10"}, strings)) == ([2], [4], [1])


def test_a_model_is_made_once_per_worker(spark):
    def factory():
        import os
        import uuid

        made = uuid.uuid4().int % 2 ** 20

        def predict(queries, texts):
            return [os.getpid() * 2.0 ** 20 + made] * len(texts)

        return predict

    df = spark.range(64).repartition(32).select(F.lit("q").alias("query"), F.lit("t").alias("content"))
    made = {r.score for r in hooks.score_pairs(df, factory).collect()}
    # Spark may start more workers than it has threads; each of them makes one.
    assert len({int(score // 2 ** 20) for score in made}) == len(made)


def test_null_score_keeps_its_line(spark):
    hit = spark.createDataFrame([(1, 1, 10, None, "first", {})], hits_table(spark).schema)
    block = context.context_blocks(spark.createDataFrame([(1,)], "query_id long"), hit).first().retrieved_info
    assert "1. [Score: 0.00]\n   first" in block


def hits_table(spark):
    data = [(1, 2, 11, 0.5, "second", {}), (1, 1, 10, 0.125, "first", {"topic": "x"})]
    return spark.createDataFrame(data, "query_id long, rank long, doc_id long, score double, content string, metadata map<string,string>")


def test_context_block(spark):
    queries = spark.createDataFrame([(1,), (2,)], "query_id long")
    blocks = {r.query_id: r for r in context.context_blocks(queries, hits_table(spark)).collect()}
    assert blocks[1].retrieved_info == ('Retrieved Information:\n\n1. [Score: 0.12]\n   first\n   Metadata: {"topic":"x"}\n\n'
                                        '2. [Score: 0.50]\n   second\n')
    assert (blocks[1].num_results, blocks[2].num_results) == (2, 0)
    assert blocks[2].retrieved_info == "No relevant information found."


def test_contexts(spark):
    queries = spark.createDataFrame([(1,), (2,)], "query_id long")
    arrays = context.hit_arrays(queries, hits_table(spark))
    found = {r[0]: r[1] for r in arrays.select("query_id", context.contexts(F.col("hits"))).collect()}
    assert found == {1: ["first", "second"], 2: [""]}
    blocks = context.context_blocks(queries, hits_table(spark)).select("query_id", context.split_block(F.col("retrieved_info")))
    split = {r[0]: r[1] for r in blocks.collect()}
    assert split[1][1:] == ['first\n   Metadata: {"topic":"x"}', "second"]
    assert split[2] == [""]


def test_augment_keeps_placeholders_of_documents(spark):
    row = one(spark, context.augment(F.lit("text with {query} and {retrieved_info}"), F.lit("q?")),
              context.augment(F.lit("info"), F.lit("q"), "{query}/{retrieved_info}/{query}"),
              context.augment(F.lit(None).cast("string"), F.lit("q")))
    assert row[0] == ("Based on the following retrieved information:\n\ntext with {query} and {retrieved_info}\n\nQuery: q?")
    assert row[1] == "q/info/q"
    assert row[2] == ""


def test_prompt_parts(spark):
    empty = F.create_map().cast("map<string,string>")
    given = F.create_map(F.lit("retrieved_info"), F.lit("old"), F.lit("k"), F.lit("v"))
    row = one(spark, context.prompt(F.lit("hi"), empty), context.prompt(F.lit("hi"), context.merge_context(given, F.lit("new")), "Be kind."))
    assert row[0] == "User: hi"
    assert row[1] == 'System: Be kind.\n\nContext: {"k":"v","retrieved_info":"new"}\n\nUser: hi'


def messages(spark):
    data = [(1, 0, "system", "s"), (1, 1, "user", "hello"), (1, 2, "assistant", "hi there"), (1, 3, "tool", "x"), (2, 0, "user", "abc")]
    return spark.createDataFrame(data, "conv_id long, turn long, role string, text string")


def test_chat_messages(spark, rows):
    chatted = chat.chat_messages(messages(spark), "Be kind.")
    assert rows(chatted, "conv_id", "position", "kind", "text") == [
        (1, 0, "system", "Be kind."), (1, 1, "human", "hello"), (1, 2, "ai", "hi there"), (1, 3, "human", "x"),
        (2, 0, "system", "Be kind."), (2, 1, "human", "abc")]
    assert chat.chat_messages(messages(spark)).filter("kind = 'system'").count() == 0


def test_history_append_and_clear(spark, rows):
    history = chat.history_asof(messages(spark))
    assert rows(history, "conv_id", "turn", "n_messages", "n_chars") == [(1, 0, 1, 1), (1, 1, 2, 6), (1, 2, 3, 14), (1, 3, 4, 15), (2, 0, 1, 3)]
    clears = spark.createDataFrame([(1, 0), (1, 2)], "conv_id long, cleared_at long")
    kept = chat.since_clear(messages(spark), clears)
    assert rows(chat.history_asof(kept), "conv_id", "turn", "n_messages") == [(1, 3, 1), (2, 0, 1)]
    everything = spark.createDataFrame([(1, 9)], "conv_id long, cleared_at long")
    assert chat.since_clear(messages(spark), everything).filter("conv_id = 1").count() == 0
    calls = spark.createDataFrame([(1, 1)], "conv_id long, as_of long")
    assert rows(chat.history_of(calls, messages(spark)), "turn", "text") == [(0, "s"), (1, "hello")]


def test_running_totals_across_parts(spark, monkeypatch):
    """One conversation holds most of the rows and spans many parts."""
    monkeypatch.setattr(chat, "PART_TURNS", 10)
    long = spark.range(0, 200).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"),
                                      F.repeat(F.lit("a"), (F.col("id") % 5).cast("int")).alias("text"))
    short = spark.range(0, 30).select(F.col("id").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.lit("b").alias("text")).filter("conv_id > 1")
    found = {(r.conv_id, r.turn): (r.n_messages, r.n_chars) for r in chat.history_asof(long.unionByName(short)).collect()}
    total = 0
    for turn in range(200):
        total += turn % 5
        assert found[(1, turn)] == (turn + 1, total)
    assert found[(29, 29)] == (1, 1)


def by_hand(messages, epoch=lambda conv, turn: 0, bound=None):
    """(conv, as_of, turn) of all that every turn sees."""
    out = []
    for conv, as_of, *_ in messages:
        own = sorted(m for m in messages if m[0] == conv and m[1] <= as_of and epoch(conv, m[1]) == epoch(conv, as_of))
        left = bound
        for _, turn, _, text in reversed(own):
            if bound is not None:
                left -= max(len(text), 1)
                if left < 0 and turn != as_of:
                    break
            out.append((conv, as_of, turn))
    return sorted(out)


@pytest.mark.parametrize("bound", [None, 1, 12, 40, 10_000])
def test_what_every_call_sees(spark, rows, monkeypatch, bound):
    """A long conversation over many parts, a short one, empty texts, and one text that alone is above the bound."""
    monkeypatch.setattr(chat, "PART_TURNS", 6)
    data = [(1, t, "user" if t % 2 else "assistant", "a" * (t * 7 % 11)) for t in range(45)] + [(2, 3, "user", "b" * 60), (2, 9, "user", ""), (3, 100, "user", "c")]
    table = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").repartition(3)
    calls = chat.all_calls(table)
    assert calls.select("call_id").distinct().count() == len(data)
    found = chat.history_of(calls, table, context_chars=bound)
    assert rows(found, "conv_id", "as_of", "turn") == sorted(by_hand(data, bound=bound), key=repr)
    assert chat.all_calls(table, "user").count() == sum(m[2] == "user" for m in data)


def test_calls_see_their_own_epoch(spark, rows, monkeypatch):
    monkeypatch.setattr(chat, "PART_TURNS", 5)
    data = [(c, t, "user", f"{t}") for c in (1, 2) for t in range(30)]
    table = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    marks = {(1, 4), (1, 4), (1, 11), (1, 29), (2, -1), (9, 3)}
    clears = spark.createDataFrame([*marks, (1, 4)], "conv_id long, cleared_at long")
    epoch = lambda conv, turn: sum(c == conv and at < turn for c, at in marks)
    told = chat.epochs(table, clears)
    assert rows(told, "conv_id", "turn", "epoch") == sorted(((c, t, epoch(c, t)) for c, t, *_ in data), key=repr)
    seen = chat.history_of(chat.all_calls(told, conversation=("conv_id", "epoch")), told, ("conv_id", "epoch"))
    assert rows(seen, "conv_id", "as_of", "turn") == sorted(by_hand(data, epoch), key=repr)


def test_histories_do_not_meet_by_conversation_alone(spark):
    table = messages(spark)
    for bound in (None, 20):
        plan = chat.history_of(chat.all_calls(table), table, context_chars=bound)._jdf.queryExecution().optimizedPlan().toString()
        joins = [line for line in plan.split("\n") if "Join " in line]
        assert joins and all("__part" in line or "__place" in line or "as_of" in line for line in joins)


def test_a_model_with_a_short_context(spark):
    data = [(1, t, "user" if t % 2 == 0 else "assistant", f"message {t:03d}") for t in range(21)]
    table = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    found = {r.call_id: r.content for r in chat.replies(chat.all_calls(table, "user"), table, lambda spec: lambda history: " ".join(t for _, t in history),
                                                         ModelSpec(system_prompt="S", context_tokens=9)).collect()}
    assert found["1-20"] == "S message 018 message 019 message 020" and found["1-0"] == "S message 000" and len(found) == 11


FILTERS = [{"n": 5}, {"n": {"$gt": 4.5, "$lte": "9"}}, {"n": {"$ne": 5}}, {"n": {"$in": [1, "5", 7.5, True]}}, {"n": {"$nin": [1, "5"]}}, {"s": "a"}, {"s": {"$gte": "a", "$lt": "c"}},
           {"f": True}, {"f": {"$ne": False}}, {"$or": [{"n": {"$lt": 2}}, {"$and": [{"s": "b"}, {"f": False}]}]}, {"$or": []}, {"$and": []}, {}, {"absent": {"$ne": 1}}, {"absent": 1},
           {"n": {"$eq": None}}, {"n": {"$ne": None}}, {"n": 9007199254740993}, {"n": {"$gt": -1e3}}, {"s": {"$nin": []}}]


def test_batch_filters_mean_what_columns_mean(spark):
    """Every filter, tested on Arrow batches and translated to a column."""
    maps = [{"n": n, "s": s, "f": f} for n, s, f in [("5", "a", "true"), ("5.0", "b", "false"), ("1", "c", "x"), (" 7.5 ", "", "true"), ("abc", "a", ""), ("9007199254740993", "b", "false"),
                                                     ("9007199254740992", "z", "true"), ("-2e2", "a", "TRUE")]] + [{}, None, {"s": "b"}]
    df = spark.createDataFrame([(i, m) for i, m in enumerate(maps)], "id long, m map<string,string>").coalesce(1)
    matcher = filters.Matcher([json.dumps(f) for f in FILTERS] + [None, ""])
    table = df.orderBy("id").toArrow()
    masks = matcher.masks(table.column("m").combine_chunks())
    assert matcher.place[-2:].tolist() == [-1, -1]
    for i, f in enumerate(FILTERS):
        want = [r.id for r in df.filter(filters.translate(f, filters.map_lookup("m"))).orderBy("id").collect()]
        assert np.flatnonzero(masks[matcher.place[i]]).tolist() == want, f
    for wrong in ({"n": {"$near": 1}}, {"$not": []}):
        with pytest.raises(ValueError):
            filters.Matcher([json.dumps(wrong)]).masks(table.column("m").combine_chunks())


def test_token_estimate_rounds_after_the_sum(spark, rows):
    data = [(1, 0, "user", "abc"), (1, 1, "user", "abc"), (1, 2, "user", "abc")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    assert rows(chat.token_estimates(df), "turn", "est_tokens") == [(0, 0), (1, 1), (2, 2)]
    assert rows(chat.token_totals(df), "n_chars", "est_tokens") == [(9, 2)]


def test_read_documents_from_json(spark, tmp_path, rows):
    (tmp_path / "d.json").write_text('{"id": "a", "body": "text", "topic": "x"}\n')
    table = tables.read_documents(spark, str(tmp_path / "d.json"), "json", "id string, body string, topic string")
    docs = tables.documents(table, "id", "body", ["topic"])
    assert rows(docs, "doc_id", "content", F.col("metadata")["topic"]) == [("a", "text", "x")]


def test_lines(spark, tmp_path, rows):
    df = spark.createDataFrame([(1, " one \n\n \ntwo")], "doc_id long, t string")
    assert rows(tables.lines(df, "t", "src", "doc_id"), "line_no", "content") == [(0, "one"), (3, "two")]
    (tmp_path / "in.txt").write_text(" one \n\n \ntwo\n")
    read = tables.read_lines(spark, str(tmp_path / "in.txt"), "src")
    assert rows(read, "content", F.col("metadata")["source"]) == [("one", "src"), ("two", "src")]


def test_generation_turns_failures_into_rows(spark):
    def factory(spec):
        def model(prompt):
            if "bad" in prompt:
                raise RuntimeError("refused")
            return f"{spec.model_name}: {prompt}"
        return model

    df = spark.createDataFrame([(1, "fine"), (2, "bad"), (3, ""), (4, None)], "id long, prompt string")
    found = {r.id: (r.content, r.success, r.error) for r in hooks.generate(df, factory).collect()}
    assert found == {1: (": fine", True, None), 2: ("", False, "refused"),
                     3: ("", False, "Invalid input message"), 4: ("", False, "Invalid input message")}


def test_chat_generation(spark, rows):
    def factory(spec):
        def model(history):
            if history[-1][1] == "boom":
                raise RuntimeError("refused")
            return " | ".join(f"{kind}={text}" for kind, text in history)
        return model

    data = [(i, turn, role, text) for i in range(40) for turn, (role, text) in enumerate(
        [("user", f"q{i}"), ("system", "s"), ("assistant", "a"), ("user", "boom" if i == 7 else "" if i == 8 else "next")])]
    table = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    calls = chat.last_calls(table).withColumn("call_id", F.col("conv_id").cast("string"))
    found = {r.call_id: (r.content, r.success, r.error) for r in hooks.generate_chat(chat.call_messages(calls, table, "S"), factory).collect()}
    assert len(found) == 40
    assert found["3"] == ("system=S | human=q3 | ai=a | human=next", True, None)
    assert found["7"] == ("", False, "refused")
    assert found["8"] == ("", False, "Invalid input message")
    earlier = spark.createDataFrame([("x", 3, 0)], "call_id string, conv_id long, as_of long")
    assert hooks.generate_chat(chat.call_messages(earlier, table), factory).first().content == "human=q3"


def test_generation_skips_inactive_rows(spark):
    df = spark.createDataFrame([(1, "a", False)], "id long, prompt string, wanted boolean")
    row = hooks.generate(df, lambda spec: lambda prompt: "x", active=F.col("wanted")).first()
    assert (row.content, row.success, row.error) == (None, None, None)


def test_raise_error_reaches_the_driver(spark):
    from corpusloom.operators import mutate
    df = spark.createDataFrame([(1, [1.0])], "doc_id long, embedding array<float>")
    with pytest.raises(PySparkException):
        mutate.require_dimension(df, 2).collect()


def test_registry_and_oracle_agree_on_names():
    from corpusloom.plans.oracle import ORACLE
    assert set(ORACLE) == set(registry.QUERIES) - {"knn_lsh"}


def test_many_different_filters():
    """Filters that differ in their operands only are tested together, exactly, and in any stretches of a batch."""
    import time

    n, m = 4_000, 3_000
    asked = ['{"$or": [{"label": {"$gt": %d}}, {"id": {"$lt": %d}}], "id": {"$ne": %d}}' % (i % 7 + 2, i, i) for i in range(n)]
    maps = pa.array([[("label", str(i % 10)), ("id", str(i))] for i in range(m)], pa.map_(pa.string(), pa.string()))
    start = time.process_time()
    matcher = filters.Matcher(asked)
    matcher.bind(maps)
    masks = np.concatenate([matcher.rows(a, min(a + 700, m)) for a in range(0, m, 700)], 1)[matcher.place]
    assert time.process_time() - start < 20
    i, d = np.arange(n)[:, None], np.arange(m)[None, :]
    assert (masks == (((d % 10 > i % 7 + 2) | (d < i)) & (d != i))).all()
    big = filters.Matcher([json.dumps({"id": {"$gt": 2**53}}), json.dumps({"id": 2**53 + 1})])
    assert big.masks(pa.array([[("id", str(2**53 + 1))], [("id", str(2**53))], None], maps.type))[big.place].tolist() == [[True, False, False], [True, False, False]]


def test_embedding_batches_are_bounded(spark):
    """An embedder never gets more than a bounded amount of text at once, and the stand-in keeps a bounded number of tokens."""
    def factory():
        return lambda texts: np.array([[len(texts), sum(map(len, texts))] for _ in texts])

    df = spark.range(0, 3_000, 1, 1).select("id", F.repeat(F.lit("word "), 400).alias("content"))
    df = df.unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "x" * (3 << 20))], "id long, content string")).coalesce(1)
    found = {r.id: r.embedding for r in hooks.embed_column(df, factory).collect()}
    assert len(found) == 3_003
    assert all(size <= hooks.BATCH_BYTES or n == 1 for n, size in found.values())
    embed = hooks.hashed_tokens(8)()
    for part in range(3):
        embed([" ".join(f"t{part}x{i}" for i in range(hooks.KNOWN_TOKENS // 2 + 10)) + " " + "y" * 100])
    known = next(c.cell_contents for f in (embed,) for c in f.__closure__ if callable(c.cell_contents)).__closure__
    known = next(c.cell_contents for c in known if isinstance(c.cell_contents, dict))
    assert len(known) <= hooks.KNOWN_TOKENS and "y" * 100 not in known


def test_index_parts_hold_bounded_text(spark):
    from corpusloom.operators import sparse

    df = spark.range(0, 40, 1, 2).select(F.col("id").alias("doc_id"), F.concat(F.repeat(F.lit("some words "), 100_000), F.col("id").cast("string")).alias("content"))
    index = sparse.build_index(df)
    assert index.n_parts >= 40 * 1_100_000 // sparse.PART_BYTES and index.n_docs == 40
    assert {r.token: r.df for r in index.frequencies.collect()} == {"some": 40, "words": 40} | {str(i): 1 for i in range(40)}


def _step(spark, monkeypatch, call):
    """The function that ``call`` gives to the tasks, to be run on batches of the test's own."""
    found = []
    with monkeypatch.context() as patch:
        patch.setattr(type(spark.range(0)), "mapInArrow", lambda self, run, schema: found.append(run) or self)
        call()
    return found[0]


def test_generator_batches_are_bounded(spark, monkeypatch):
    """Prompts repeat several texts each: the generator's rows are taken in batches of bounded text, in their order, none lost."""
    prompts = [None, "", "x" * (3 << 20), *(f"{i} " + "word " * 4_000 for i in range(500))]
    df = spark.createDataFrame([], "id long, prompt string")
    run = _step(spark, monkeypatch, lambda: hooks.generate(df, lambda spec: lambda text: text[:5]))
    batch = pa.RecordBatch.from_pydict({"id": list(range(len(prompts))), "prompt": prompts, "__active": [True] * len(prompts)})
    done = list(run(iter([batch, batch.slice(0, 0)])))
    assert all(b.num_rows == 1 or sum(len(p or "") for p in b.column("prompt").to_pylist()) <= hooks.BATCH_BYTES for b in done)
    rows = pa.Table.from_batches(done).to_pylist()
    assert [r["id"] for r in rows] == list(range(len(prompts)))
    assert [(r["content"], r["success"], r["error"]) for r in rows] == [
        (p[:5], True, None) if p else ("", False, "Invalid input message") for p in prompts]


def test_judge_batches_are_bounded(spark, monkeypatch):
    """A judge's rows hold whole texts as contexts: they are taken in batches of bounded text, lists of texts counted, none lost."""
    schema = pa.schema({"question_id": pa.int64(), "question": pa.string(), "answer": pa.string(), "contexts": pa.list_(pa.string()), "ground_truth": pa.string()})
    rows = [{"question_id": i, "question": "q", "answer": "a", "contexts": ["word " * 2_000] * 4 + [None], "ground_truth": None} for i in range(300)]
    rows += [{"question_id": 300, "question": "q", "answer": "y" * (2 << 20), "contexts": [], "ground_truth": "g"},
             {"question_id": 301, "question": None, "answer": None, "contexts": None, "ground_truth": None}]
    df = spark.createDataFrame([], "question_id long, question string, answer string, contexts array<string>, ground_truth string")
    run = _step(spark, monkeypatch, lambda: evaluate.judge(df, lambda spec: lambda kind, row: [(kind, 1)]))
    batch = pa.RecordBatch.from_pylist([rows[0], *rows], schema=schema).slice(1)
    done = list(run(iter([batch])))
    size = {r["question_id"]: sum(len(t or "") for t in (r["question"], r["answer"], r["ground_truth"], *(r["contexts"] or []))) for r in rows}
    asked = [list(dict.fromkeys(b.column("question_id").to_pylist())) for b in done]
    assert all(len(ids) == 1 or sum(size[i] for i in ids) <= hooks.BATCH_BYTES for ids in asked)
    assert [i for ids in asked for i in ids] == list(range(302))
    assert all(b.num_rows == len(ids) * len(evaluate.KINDS) for b, ids in zip(done, asked, strict=True))
