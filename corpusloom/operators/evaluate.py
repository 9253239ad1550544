"""Evaluation metrics over verdict tables, a hook for the judge, and a lexical stand-in for it.

A judge writes verdicts (0 or 1) per statement, context or sentence; the arithmetic on them follows
the RAGAS paper (Es et al., 2023). A judge's *factory* gets the model settings and returns a function of a kind of verdict and an evaluation
row; like other hooks it is called once in each Python worker. The lexical judge accepts what shares enough tokens.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.functions import hooks, text
from corpusloom.operators.context import NO_RESULTS
from corpusloom.schemas import ModelSpec

# The names of the four metrics.
METRICS = ("faithfulness", "answer_relevancy", "context_precision", "context_recall")
#: What a judge is asked for: verdicts on statements of the answer, on the contexts in rank order, on sentences of the ground truth, and questions made
#: from the answer (verdict 1: the answer is noncommittal).
KINDS = ("statement", "context", "sentence", "question")
VERDICTS = "question_id {id}, kind string, idx long, text string, verdict int, error string"


def faithfulness(statements: DataFrame) -> DataFrame:
    """Share of supported statements of the answer: ``question_id, supported``."""
    return statements.groupBy("question_id").agg(F.avg("supported").alias("faithfulness"))


def context_recall(sentences: DataFrame) -> DataFrame:
    """Share of ground-truth sentences the contexts account for: ``question_id, attributed``."""
    return sentences.groupBy("question_id").agg(F.avg("attributed").alias("context_recall"))


def context_precision(verdicts: DataFrame) -> DataFrame:
    """Mean precision at the ranks of the relevant contexts, 0 without any: ``question_id, rank, relevant``."""
    so_far = Window.partitionBy("question_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    at_rank = verdicts.withColumn("precision", F.avg("relevant").over(so_far))
    mean = F.try_divide(F.sum(F.col("precision") * F.col("relevant")), F.sum("relevant"))
    return at_rank.groupBy("question_id").agg(F.coalesce(mean, F.lit(0.0)).alias("context_precision"))


def cosine(a: Column, b: Column) -> Column:
    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda total, value: total + value)

    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def answer_relevancy(generated: DataFrame) -> DataFrame:
    """Mean cosine of the question and the questions made from the answer, 0 for a noncommittal one:
    ``question_id, question_embedding, embedding, noncommittal``."""
    similarity = F.when(F.col("noncommittal"), F.lit(0.0)).otherwise(cosine(F.col("question_embedding"), F.col("embedding")))
    return generated.groupBy("question_id").agg(F.avg(similarity).alias("answer_relevancy"))


def metrics(rows: DataFrame, *tables: DataFrame) -> DataFrame:
    """All metrics per question; a question without verdicts of a kind has null there."""
    scored = rows.select("question_id")
    for table in tables:
        scored = scored.join(table, "question_id", "left")
    return scored.select("question_id", *METRICS)


def means(scores: DataFrame) -> DataFrame:
    """Mean per metric over the questions; null and NaN are skipped."""
    return scores.agg(*[F.avg(F.nanvl(name, F.lit(None).cast("double"))).alias(name) for name in METRICS],
                      F.count("*").alias("n_questions"))


def judge(rows: DataFrame, factory, spec: ModelSpec = ModelSpec()) -> DataFrame:
    """Verdicts on ``question_id, question, answer, contexts, ground_truth``: ``question_id, kind, idx, text, verdict, error``.

    The function from ``factory`` is given a kind (see ``KINDS``) and the row as a dictionary, and returns ``[(text, verdict), ...]``. What it raises becomes a row of that
    kind with ``error`` and without a verdict, and the job goes on; so does a verdict that is neither 0 nor 1. Rows are taken in batches of bounded text.
    """
    token = uuid.uuid4().hex
    names = ["question_id", "question", "answer", "contexts", "ground_truth"]
    rows = rows.select(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = hooks.here().made_once(token, factory, spec)
        for batch in hooks.bounded(batches, *names[1:]):
            out = []
            for row in batch.to_pylist():
                for kind in KINDS:
                    try:
                        found = [(t, int(v)) for t, v in ask(kind, {n: row[n] for n in names[1:]})]
                        if any(v not in (0, 1) for _, v in found):
                            raise ValueError("a verdict is 0 or 1")
                        out += [(row["question_id"], kind, i, t, v, None) for i, (t, v) in enumerate(found)]
                    except Exception as problem:  # a failed call must not end the job
                        out.append((row["question_id"], kind, None, None, None, str(problem)))
            columns = list(zip(*out, strict=True)) or [[]] * 6
            kinds = [batch.schema.field(0).type, pa.string(), pa.int64(), pa.string(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["question_id", "kind", "idx", "text", "verdict", "error"])

    return rows.mapInArrow(run, VERDICTS.format(id=rows.schema["question_id"].dataType.simpleString()))


def judged_metrics(rows: DataFrame, verdicts: DataFrame, embedder) -> DataFrame:
    """The four metrics from a judge's verdicts; one whose judgement failed is null. ``rows`` and ``verdicts`` are read several times: pass written tables."""
    given = verdicts.filter("error is null")

    def of(kind: str, verdict: str) -> DataFrame:
        return given.filter(F.col("kind") == kind).select("question_id", F.col("verdict").alias(verdict), (F.col("idx") + 1).alias("rank"))

    asked = hooks.embed_column(rows.select("question_id", "question"), embedder, "question", "question_embedding").drop("question")
    made = hooks.embed_column(given.filter("kind = 'question'").select("question_id", "text", (F.col("verdict") == 1).alias("noncommittal")), embedder, "text")
    return metrics(rows, faithfulness(of("statement", "supported")), answer_relevancy(made.join(asked, "question_id")),
                   context_precision(of("context", "relevant")), context_recall(of("sentence", "attributed")))


def token_judge(at_least: float = 0.5):
    """A judge factory that accepts what shares enough distinct tokens, as the stand-ins below do."""
    def factory(spec: ModelSpec):
        def tokens(value: str) -> list[str]:
            return list(dict.fromkeys(value.lower().split()))

        def sentences(value: str) -> list[str]:
            return [p.strip() for p in re.split(r"[.!?\n]+", value) if p.strip()]

        def accepted(wanted: list[str], known: set[str]) -> int:
            return int(bool(wanted) and sum(t in known for t in wanted) / len(wanted) >= at_least)

        def ask(kind: str, row: dict) -> list[tuple[str, int]]:
            if kind == "context":
                return [(c, accepted(tokens(row["ground_truth"]), set(tokens(c)))) for c in row["contexts"]]
            if kind == "question":
                return [(s, int(row["answer"] == NO_RESULTS)) for s in sentences(row["answer"])]
            known = {t for c in row["contexts"] for t in tokens(c)}
            return [(s, accepted(tokens(s), known)) for s in sentences(row["answer" if kind == "statement" else "ground_truth"])]

        return ask

    return factory


def lexical_statements(rows: DataFrame, column: str, verdict: str, at_least: float = 0.5) -> DataFrame:
    """A sentence of ``column`` is accepted when enough of its distinct tokens occur in the contexts."""
    sentences = rows.select("question_id", F.posexplode(text.sentences(F.col(column))).alias("idx", "sentence"))
    wanted = sentences.select("question_id", "idx", F.explode(F.array_distinct(text.tokens(F.col("sentence")))).alias("token"))
    known = rows.select("question_id", F.explode(F.array_distinct(F.flatten(F.transform("contexts", text.tokens)))).alias("token"),
                        F.lit(1).alias("found"))
    found = wanted.join(known, ["question_id", "token"], "left").groupBy("question_id", "idx")
    share = F.count("found") / F.count("*")
    return found.agg((share >= at_least).cast("int").alias(verdict)).withColumn("idx", F.col("idx").cast("bigint"))


def lexical_contexts(rows: DataFrame, at_least: float = 0.5) -> DataFrame:
    """A context is relevant when it holds enough of the ground-truth tokens."""
    wanted = rows.select("question_id", text.tokens(F.col("ground_truth")).alias("wanted"),
                         F.posexplode("contexts").alias("idx", "context"))
    share = text.covered_share(F.col("wanted"), text.tokens(F.col("context")))
    return wanted.select("question_id", (F.col("idx") + 1).cast("bigint").alias("rank"),
                         F.coalesce((share >= at_least).cast("int"), F.lit(0)).alias("relevant"))


def generated_questions(rows: DataFrame, embedder) -> DataFrame:
    """Stand-in for questions made from the answer: its sentences."""
    asked = hooks.embed_column(rows.select("question_id", "question", "answer"), embedder, "question", "question_embedding")
    made = asked.select("question_id", "question_embedding", F.explode(text.sentences(F.col("answer"))).alias("made"),
                        (F.col("answer") == NO_RESULTS).alias("noncommittal"))
    return hooks.embed_column(made, embedder, "made").drop("made")


def lexical_metrics(rows: DataFrame, embedder) -> DataFrame:
    """The four metrics of ``question_id, question, answer, contexts, ground_truth`` by the stand-ins.

    ``rows`` is read several times: pass a written table.
    """
    return metrics(rows, faithfulness(lexical_statements(rows, "answer", "supported")),
                   answer_relevancy(generated_questions(rows, embedder)),
                   context_precision(lexical_contexts(rows)),
                   context_recall(lexical_statements(rows, "ground_truth", "attributed")))
