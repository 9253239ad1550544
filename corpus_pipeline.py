"""The training-data pipeline: stages applied to the table of documents, one after the other.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before has kept; all but the last return the columns of
``documents``. ``n_chars`` follows the text where a stage changes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusloom.llm import bpe, decontaminate, neardup, suffix_array, toxicity
from corpusloom.llm.queries import tokenizer_path
from corpusloom.session import new_folder, written

#: Documents from this score on are rejected.
TOXIC = 0.5
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity: rejects documents that the classifier, fitted on the labelled rows outside the held-out fold, finds toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    model = toxicity.fit(docs, labels)
    return toxicity.scored(docs.select(*COLUMNS), model).filter(F.col("toxicity_score") < TOXIC).select(*COLUMNS)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: of each group of documents linked by a similarity of 0.8 of their five-word shingles, the smallest id stays."""
    groups = neardup.near_duplicates(docs, shingle=5, percent=80)
    # Only ids travel: the rejected ones are far fewer than the documents, which are not shuffled while these can be broadcast.
    rejected = written(groups.filter(~F.col("kept")).select("doc_id").distinct(), "rejected")
    few = F.broadcast(rejected) if rejected.count() <= neardup.BROADCAST_IDS else rejected
    return docs.select(*COLUMNS).join(few, "doc_id", "left_anti").select(*COLUMNS)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Suffix-array dedup: cuts the characters of 50-byte strings that also start in a document with a smaller id.

    Documents of which nothing is left stay as empty ones: all rows are kept.
    """
    cut = suffix_array.cut_repeated_bytes(docs, window=50, characters=True, keep=("lang", "source"))
    return cut.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: rejects documents that hold a ten-word passage of a benchmark item."""
    found = decontaminate.find_passages(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10, keep=COLUMNS[1:])
    return found.filter(F.size("spans") == 0).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE encoding and decoding: the ids of every text, and whether they decode to it."""
    tokens = bpe.round_trip(docs, tokenizer_path())
    return tokens.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("decoded").alias("text"))


STAGES = [("toxicity", without_toxic), ("near_duplicates", without_near_duplicates), ("suffix_array", without_repeats),
          ("decontamination", without_benchmark), ("bpe", encoded)]
#: The classifier, the suffix array and BPE have no SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
