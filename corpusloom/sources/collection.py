"""Document collections as plain Parquet folders, one for each version.

A caller names the folders: it loads one version, changes it with ``operators.mutate`` and saves the result under another name, so a reader never
loses the version it reads. Ids, content keys and vectors are completed by ``complete`` before a batch is merged.

A version may lie in buckets by id (``save_buckets``). Then a batch of any size is dealt to the buckets and meets the stored rows there: only the batch is shuffled.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusloom.functions import text
from corpusloom.operators import mutate
from corpusloom.schemas import DOCUMENT_SCHEMA
from corpusloom.session import written


def save(docs: DataFrame, path: str) -> DataFrame:
    """Write one version and read it back."""
    named = [(F.col(f.name) if f.name in docs.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in DOCUMENT_SCHEMA.fields]
    docs.select(*named).write.parquet(path)
    return load(docs.sparkSession, path)


def load(spark: SparkSession, path: str | None) -> DataFrame:
    """One version of a collection; without a folder an empty one."""
    return spark.read.schema(DOCUMENT_SCHEMA).parquet(path) if path else spark.createDataFrame([], DOCUMENT_SCHEMA)


def save_buckets(docs: DataFrame, path: str, buckets: int) -> DataFrame:
    """Write one version with its rows in ``buckets`` by id, and read it back. Choose buckets that a task can sort, some 256 MB; copies of one id share a bucket."""
    return _write_buckets(docs.repartition(buckets, "doc_id"), path, buckets)


def load_buckets(spark: SparkSession, path: str, buckets: int) -> DataFrame:
    """One version that ``save_buckets`` or ``merge_buckets`` has written, with as many buckets as it was written with."""
    name = f"version_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in DOCUMENT_SCHEMA.fields)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (doc_id) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def merge_buckets(current: DataFrame, new: DataFrame, path: str, buckets: int, order: str) -> DataFrame:
    """``mutate.upsert`` on a version in buckets, written as another: the stored rows are read, joined and written without a shuffle.

    Of a repeated id in the batch the last row by ``order`` counts; stored copies of one id are all replaced, and stored rows without an id stay.
    """
    latest = written(mutate.one_per_id(new, order).drop(order), "batch")
    kept = current.join(latest.select("doc_id").hint("merge"), "doc_id", "left_anti")
    return _write_buckets(kept.unionByName(latest.repartition(buckets, "doc_id"), allowMissingColumns=True), path, buckets)


def _write_buckets(docs: DataFrame, path: str, buckets: int) -> DataFrame:
    named = [(F.col(f.name) if f.name in docs.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in DOCUMENT_SCHEMA.fields]
    name = f"version_{uuid.uuid4().hex}"
    docs.select(*named).write.format("parquet").bucketBy(buckets, "doc_id").option("path", path).saveAsTable(name)
    return docs.sparkSession.table(name)


def complete(docs: DataFrame, order: str, embedder=None, ids: str = "hash", next_id: int = 0, dimension: int | None = None) -> DataFrame:
    """A batch in the columns of a collection, and ``order``: ids by a policy (see ``mutate.assign_ids``), content keys, vectors for rows without one.

    With ``dimension`` a vector of another length is an error.
    """
    filled = docs if "doc_id" in docs.columns else docs.withColumn("doc_id", F.lit(None).cast("string"))
    filled = mutate.assign_ids(filled, ids, order, next_id).withColumn("content_key", text.content_key(F.col("content")))
    for field in DOCUMENT_SCHEMA.fields:
        value = F.col(field.name) if field.name in filled.columns else F.lit(None)
        filled = filled.withColumn(field.name, value.cast(field.dataType))
    if embedder is not None:
        filled = mutate.fill_embeddings(filled, embedder)
    if dimension is not None:
        filled = mutate.require_dimension(filled, dimension)
    return filled.select(*dict.fromkeys([*DOCUMENT_SCHEMA.fieldNames(), order]))
