"""Workflows over a table of requests. One row is one request; a step adds columns to it.

Steps are narrow: they add ``content, success, error`` to the rows they are given and never need a
join, so a sequential or parallel workflow is a single stage without a shuffle, however many requests
there are. Only the retrieval inside the retrieve-then-generate workflow shuffles.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.functions import hooks, text
from corpusloom.operators import context
from corpusloom.plans.retrieve import Corpus, retrieve
from corpusloom.schemas import BlockLimits, ModelSpec, RetrievalParams
from corpusloom.session import written

# Fixed value: the error of an empty request.
INVALID_INPUT = "Invalid input message"

OUTCOME = ("content", "success", "error")


@dataclass(frozen=True)
class Step:
    """``run`` gets rows with ``task``, ``context`` and ``active`` and returns them with ``content``,
    ``success`` and ``error``; rows that are not active should cost nothing."""

    agent: str
    action: str
    run: Callable[[DataFrame], DataFrame]


def column_step(agent: str, action: str, content: Callable[[Column, Column], Column],
                error: Callable[[Column, Column], Column] | None = None) -> Step:
    """A step made of column expressions of (task, context). Where ``error`` is not null it fails."""

    def run(df: DataFrame) -> DataFrame:
        task, ctx = F.col("task"), F.col("context")
        problem = F.lit(None).cast("string") if error is None else error(task, ctx)
        problem = F.when(~text.is_valid_input(task), F.lit(INVALID_INPUT)).otherwise(problem)
        return (df.withColumn("error", problem)
                .withColumn("success", F.col("error").isNull())
                .withColumn("content", F.when(F.col("success"), content(task, ctx)).otherwise(F.lit(""))))

    return Step(agent, action, run)


def model_step(agent: str, action: str, factory, spec: ModelSpec = ModelSpec(), compat: bool = False) -> Step:
    """A step that asks a generator hook with a prompt of context and task.

    The system prompt goes to the model through ``spec``; ``compat`` repeats it inside the prompt.
    """

    def run(df: DataFrame) -> DataFrame:
        shown = spec.system_prompt if compat else ""
        asked = df.withColumn("prompt", context.prompt(F.col("task"), F.col("context"), shown))
        return hooks.generate(asked, factory, spec, active=F.col("active")).drop("prompt")

    return Step(agent, action, run)


def requests(df: DataFrame, request_id: str, text_column: str, context_column: str | None = None) -> DataFrame:
    fields = F.col(context_column) if context_column else F.create_map().cast("map<string,string>")
    return df.select(F.col(request_id).alias("request_id"), F.col(text_column).alias("initial_input"),
                     F.coalesce(fields, F.create_map().cast("map<string,string>")).alias("context"))


def sequential(df: DataFrame, steps: list[Step]) -> DataFrame:
    """Each step reads the output of the one before. After a failure the rest is skipped."""
    _check(steps, 1, "a sequential workflow needs at least 1 step")
    state = df.withColumn("current_input", F.col("initial_input")).withColumn("active", F.lit(True))
    for i, step in enumerate(steps):
        state = _run(state, step, i, F.col("current_input"))
        succeeded = F.coalesce(F.col(f"success_{i}"), F.lit(False))
        state = (state.withColumn("current_input", F.when(succeeded, F.col(f"content_{i}")).otherwise(F.col("current_input")))
                 .withColumn("active", succeeded))
    return _result(state, steps)


def parallel(df: DataFrame, steps: list[Step]) -> DataFrame:
    """Every step reads the initial input; a failure does not stop the others."""
    _check(steps, 1, "a parallel workflow needs at least 1 step")
    state = df.withColumn("active", F.lit(True))
    for i, step in enumerate(steps):
        state = _run(state, step, i, F.col("initial_input"))
    return _result(state, steps)


def _check(steps: list, at_least: int, message: str) -> None:
    if len(steps) < at_least:
        raise ValueError(message)


def _run(state: DataFrame, step: Step, i: int, task: Column) -> DataFrame:
    done = step.run(state.withColumn("task", task))
    outcome = {name: F.when(F.col("active"), F.col(name)).alias(f"{name}_{i}") for name in OUTCOME}
    return done.select(*[c for c in state.columns], *outcome.values())


def _result(state: DataFrame, steps: list[Step]) -> DataFrame:
    """Fan-in: the log in step order, outputs by agent (the last success wins), the first error."""
    log = F.filter(F.array(*[
        F.when(F.col(f"success_{i}").isNotNull(), F.struct(
            F.lit(step.agent).alias("agent"), F.lit(step.action).alias("action"),
            F.col(f"success_{i}").alias("success"), F.col(f"content_{i}").alias("output")))
        for i, step in enumerate(steps)]), lambda entry: entry.isNotNull())
    by_agent: dict[str, list[int]] = {}
    for i, step in enumerate(steps):
        by_agent.setdefault(step.agent, []).append(i)
    entries = [part for agent, places in by_agent.items() for part in (
        F.lit(agent), F.coalesce(*[F.when(F.col(f"success_{i}"), F.col(f"content_{i}")) for i in reversed(places)]))]
    outputs = F.map_filter(F.create_map(*entries), lambda _, value: value.isNotNull())
    failures = [F.col(f"success_{i}") == F.lit(False) for i in range(len(steps))]
    failed = F.greatest(*[F.coalesce(f, F.lit(False)) for f in failures], F.lit(False))
    error = F.coalesce(*[F.when(f, F.col(f"error_{i}")) for i, f in enumerate(failures)])
    return state.select("request_id", "initial_input", (~failed).alias("success"), outputs.alias("outputs"),
                        log.alias("step_results"), error.alias("error"))


def step_log(results: DataFrame) -> DataFrame:
    """The step logs as a long table: ``request_id, step_idx, agent, action, success, output``."""
    return results.select("request_id", F.posexplode("step_results").alias("step_idx", "entry")).select(
        "request_id", F.col("step_idx").cast("bigint").alias("step_idx"), "entry.*")


def retrieve_then_generate(df: DataFrame, corpus: Corpus, embedder, generator, params: RetrievalParams = RetrievalParams(),
                           spec: ModelSpec = ModelSpec(), scorer=None, lexical: bool = False,
                           keep: Callable[[Column], Column] | None = None, agents: tuple[str, str] = ("retriever", "generator"),
                           compat: bool = False, limits: BlockLimits = BlockLimits()) -> DataFrame:
    """Retrieval, then generation with the retrieved text in the context.

    A column ``filter`` (a string map) restricts the vector search of its request.

    Outputs have the fixed keys ``retrieval`` and ``generation``; ``hits`` are kept beside them for
    the evaluation. The generator runs once per request: its result is written before it is used.
    """
    valid = text.is_valid_input(F.col("initial_input"))
    questions = df.filter(valid).select(F.col("request_id").alias("query_id"), F.col("initial_input").alias("query"),
                                        *["filter"] * ("filter" in df.columns))
    queries = written(hooks.embed_column(questions, embedder, "query"), "queries")
    hits = retrieve(queries, corpus, params, scorer, lexical, keep, limits)
    arrays = context.hit_arrays(queries.select("query_id"), hits).select(
        F.col("query_id").alias("request_id"), "hits", context.context_block(F.col("hits")).alias("retrieval"))
    found = F.col("retrieval").isNotNull()
    state = df.join(arrays, "request_id", "left").withColumn(
        "prompt", context.prompt(F.col("initial_input"), context.merge_context(F.col("context"), F.col("retrieval")),
                                 spec.system_prompt if compat else ""))
    answered = written(hooks.generate(state, generator, spec, active=found), "answers")
    generated = F.coalesce(F.col("success"), F.lit(False))
    log = F.when(found, F.array(
        _entry(agents[0], "retrieve", F.lit(True), F.col("retrieval")),
        _entry(agents[1], "generate", generated, F.col("content")))).otherwise(F.array(
            _entry(agents[0], "retrieve", F.lit(False), F.lit(""))))
    outputs = F.map_filter(F.create_map(
        F.lit("retrieval"), F.col("retrieval"), F.lit("generation"), F.when(generated, F.col("content"))),
        lambda _, value: value.isNotNull())
    error = F.when(found, F.col("error")).otherwise(F.lit(INVALID_INPUT))
    return answered.select("request_id", "initial_input", (found & generated).alias("success"),
                           outputs.alias("outputs"), log.alias("step_results"), error.alias("error"), "hits")


def _entry(agent: str, action: str, success: Column, output: Column) -> Column:
    return F.struct(F.lit(agent).alias("agent"), F.lit(action).alias("action"), success.alias("success"),
                    output.alias("output"))
