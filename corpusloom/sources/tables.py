"""Readers and writers for the tables of a job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpusloom.functions import text
from corpusloom.session import planned_splits


def read_spread(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Read Parquet; a table too small to give every core one split of its own is dealt out evenly over the cores.

    Such a table may be a single row group, which one task would process alone, and has at most ``spark.sql.files.maxPartitionBytes`` to move
    for each core. A larger one is split by the scan, however few its files are, and not shuffled. No
    key decides where a row goes, so one long conversation or one frequent id doesn't fill one task.
    """
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    return df if planned_splits(df) > cores else df.repartition(cores)


def read_documents(spark: SparkSession, path: str, kind: str = "parquet", schema=None, **options: str) -> DataFrame:
    """A document table in any file format Spark reads; give text formats a schema."""
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def documents(df: DataFrame, doc_id: str = "doc_id", content: str = "text",
              metadata: list[str] | None = None) -> DataFrame:
    """Any table as ``doc_id, content, metadata``; the named columns become the metadata map."""
    pairs = [part for name in metadata or [] for part in (F.lit(name), F.col(name).cast("string"))]
    fields = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return df.select(F.col(doc_id).alias("doc_id"), F.col(content).alias("content"), fields.alias("metadata"))


def lines(df: DataFrame, column: str, source: str, *keep: str) -> DataFrame:
    """One document per non-blank line: the kept columns, ``line_no``, ``content``, ``metadata``."""
    split = df.select(*keep, F.posexplode(F.split(column, "\n")).alias("line_no", "line"))
    return _lines(split.withColumn("line_no", F.col("line_no").cast("bigint")), source, *keep, "line_no")


def read_lines(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Text files with one document per line."""
    return _lines(spark.read.text(path).withColumnRenamed("value", "line"), source)


def _lines(df: DataFrame, source: str, *keep: str) -> DataFrame:
    return (df.select(*keep, text.strip(F.col("line")).alias("content"))
            .filter(F.col("content") != "")
            .withColumn("metadata", F.create_map(F.lit("source"), F.lit(source))))


def messages(df: DataFrame) -> DataFrame:
    return df.select("conv_id", "turn", "role", "text")


def golden(df: DataFrame, question: str, ground_truth: str, key: str) -> DataFrame:
    return df.select(F.col(key).alias("question_id"), F.col(question).alias("question"),
                     F.col(ground_truth).alias("ground_truth"))


def output(outputs: str, name: str) -> Column:
    """A named workflow output, an empty string when it is missing."""
    return F.coalesce(F.try_element_at(F.col(outputs), F.lit(name)), F.lit(""))


def write_answers(results: DataFrame, path: str) -> None:
    answers(results).write.parquet(path)


def answers(results: DataFrame) -> DataFrame:
    """Workflow results as flat answer rows."""
    return results.select("request_id", "success", output("outputs", "generation").alias("answer"),
                          output("outputs", "retrieval").alias("retrieved_context"), "step_results", "error")
