"""The evaluation job: golden questions through retrieval and generation, then the metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpusloom.operators import context
from corpusloom.sources import tables


def golden_rows(golden: DataFrame, results: DataFrame) -> DataFrame:
    """Evaluation rows of the successful runs: ``question_id, question, answer, contexts, ground_truth``."""
    done = results.filter("success").select(
        F.col("request_id").alias("question_id"), tables.output("outputs", "generation").alias("answer"),
        context.contexts(F.col("hits")).alias("contexts"))
    return golden.join(done, "question_id").select("question_id", "question", "answer", "contexts", "ground_truth")


def run_counts(results: DataFrame) -> DataFrame:
    """Runs evaluated and runs skipped because they failed."""
    return results.agg(F.count_if("success").alias("n_evaluated"), F.count_if(~F.col("success")).alias("n_skipped"))


def require_success(counts: DataFrame) -> None:
    if counts.first()["n_evaluated"] == 0:
        raise ValueError("every run failed, so there is nothing to score")
