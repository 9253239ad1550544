"""Keyed changes to a document table: ids, embeddings, insert, upsert, delete, update, checks.

Each function takes and returns DataFrames; ``sources.collection`` stores the result. A batch of
changes is usually small beside the collection, and its ids are broadcast only when counted to be so
(``session.join_keys``); otherwise the join shuffles both sides on the id.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from corpusloom.functions import hooks, text
from corpusloom.session import join_keys, match_few, written

RANGE_ROWS = 1_000_000


def partition_keys(spark: SparkSession, n: int) -> np.ndarray:
    """For each of ``n`` partitions a number that a hash partitioning sends there (numbers are spread at random; one that is not found stands for itself)."""
    ids = spark.range(32 * n).select(F.col("id").cast("int").alias("id"))
    found = ids.groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("part")).agg(F.min("id").alias("id")).collect()
    keys = np.arange(n, dtype=np.int32)
    for row in found:
        keys[row["part"]] = row["id"]
    return keys


def positions(df: DataFrame, order: str, out: str = "position", range_rows: int = RANGE_ROWS) -> DataFrame:
    """Add the place of each row, from 0, in the order of a unique column of any type that sorts.

    Two passes: the keys alone give the bounds of ranges of about ``range_rows`` rows and the sizes of these (one number for each range on
    the driver); then the rows go to their ranges, are sorted there and numbered as they pass. Rows move once and nothing is joined. ``df`` is read three
    times, so pass a written table or a plain scan. Rows whose order is null get no place and do not move.
    """
    keys = df.select(F.col(order).alias("key")).filter(F.col("key").isNotNull())
    n_ranges = max(ceil(keys.count() / range_rows), keys.sparkSession.sparkContext.defaultParallelism, 2)
    sampled = keys.repartitionByRange(n_ranges, "key").groupBy(F.spark_partition_id().alias("part")).agg(F.min("key").alias("key"))
    # One key per range; the first range is open below.
    bounds = sampled.select("key").distinct().orderBy("key").toArrow().column("key").to_numpy()[1:]

    tasks = partition_keys(df.sparkSession, n_ranges)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(batch.schema.get_field_index(order)).to_numpy(zero_copy_only=False)
            found = np.searchsorted(bounds, key, side="right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found), pa.array(tasks[found])], names=[*batch.schema.names, "__range", "__task"])

    def ranged(rows: DataFrame) -> DataFrame:
        schema = T.StructType([*rows.schema.fields, T.StructField("__range", T.IntegerType()), T.StructField("__task", T.IntegerType())])
        return rows.filter(F.col(order).isNotNull()).mapInArrow(place, schema)

    sizes = np.zeros(len(bounds) + 1, np.int64)
    for row in ranged(df.select(order)).groupBy("__range").count().collect():
        sizes[row["__range"]] = row["count"]
    offsets = np.cumsum(sizes) - sizes

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for batch in batches:
            own = batch.column(batch.schema.get_field_index("__range")).to_numpy()
            first = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.empty(0, int)
            numbers = np.empty(len(own), np.int64)
            for a, b in zip(first.tolist(), [*first[1:].tolist(), len(own)], strict=False):
                start = seen.get(int(own[a]), int(offsets[own[a]]))
                numbers[a:b] = np.arange(start, start + b - a)
                seen[int(own[a])] = start + b - a
            yield batch.drop_columns(["__range", "__task"]).append_column(out, pa.array(numbers))

    # A range is a task: by the hash of its own number several ranges would share one, and others stay empty.
    sorted_rows = ranged(df).repartition(n_ranges, "__task").sortWithinPartitions("__range", order)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.LongType())])
    numbered = sorted_rows.mapInArrow(number, schema)
    return numbered.unionByName(df.filter(F.col(order).isNull()).withColumn(out, F.lit(None).cast("long")))


def assign_ids(docs: DataFrame, policy: str = "hash", order: str | None = None, next_id: int = 0) -> DataFrame:
    """Fill missing or empty ``doc_id`` values.

    ``batch``: ``doc_0, doc_1, ...`` by place in the batch, again from 0 in every batch.
    ``counter``: the same, going on from ``next_id``. ``uuid``: random. ``hash``: from the content,
    hence the same again on a second run.
    """
    if policy in ("batch", "counter"):
        start = next_id if policy == "counter" else 0
        numbered = positions(docs, order, "__position")
        made = F.concat(F.lit("doc_"), (F.col("__position") + start).cast("string"))
    elif policy == "uuid":
        numbered, made = docs, F.uuid()
    elif policy == "hash":
        numbered, made = docs, text.content_key(F.col("content"))
    else:
        raise ValueError(f"unknown id policy {policy!r}")
    given = F.nullif(F.col("doc_id").cast("string"), F.lit(""))
    return numbered.withColumn("doc_id", F.coalesce(given, made)).drop("__position")


def fill_embeddings(docs: DataFrame, embedder) -> DataFrame:
    """Embed the rows without a vector (null or empty); given vectors are kept."""
    missing = F.col("embedding").isNull() | (F.size("embedding") == 0)
    kept, absent = docs.filter(~missing), docs.filter(missing)
    return kept.unionByName(hooks.embed_column(absent, embedder))


def split_by_dimension(docs: DataFrame, dimension: int) -> tuple[DataFrame, DataFrame]:
    """Rows whose vector fits the collection, and the rejected ones."""
    fits = F.coalesce(F.size("embedding") == dimension, F.lit(False))
    return docs.filter(fits), docs.filter(~fits)


def require_dimension(docs: DataFrame, dimension: int) -> DataFrame:
    """Strict form: the job fails on the first vector that does not fit."""
    message = F.concat(F.lit(f"expected {dimension} values, found "), F.size("embedding").cast("string"))
    checked = F.when(F.size("embedding") == dimension, F.col("embedding")).otherwise(F.raise_error(message))
    return docs.withColumn("embedding", checked)


def append(current: DataFrame, new: DataFrame) -> DataFrame:
    """Add rows; a repeated id stays searchable twice."""
    return current.unionByName(new)


def one_per_id(batch: DataFrame, order: str, keep: str = "last") -> DataFrame:
    """The last (or first) row of each id in a batch. Pre-aggregated before the shuffle. A row without id is an error: see ``assign_ids``."""
    pick = F.max_by if keep == "last" else F.min_by
    given = F.coalesce("doc_id", F.raise_error(F.lit("a row without doc_id; assign ids first")).cast(batch.schema["doc_id"].dataType))
    batch = batch.withColumn("doc_id", given)
    row = F.struct(*batch.columns)
    return batch.groupBy("doc_id").agg(pick(row, F.col(order)).alias("row")).select("row.*")


def insert_if_absent(current: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """Rows of the batch whose id is new, added; of a repeated id in the batch the first row counts."""
    first = written(one_per_id(new, order, "first").drop(order), "batch")
    return current.unionByName(match_few(first, current, "doc_id", "left_anti"))


def upsert(current: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """Rows of the batch replace rows of the same id; of a repeated id in the batch the last row counts."""
    latest = written(one_per_id(new, order, "last").drop(order), "batch")
    return join_keys(current, latest.select("doc_id"), "doc_id", "left_anti").unionByName(latest)


def delete(current: DataFrame, ids: DataFrame) -> DataFrame:
    """Drop rows by id; unknown ids do nothing."""
    return join_keys(current, ids.select("doc_id"), "doc_id", "left_anti")


def parse_ids(df: DataFrame, column: str) -> DataFrame:
    """Ids from comma-separated strings."""
    return df.select(F.explode(F.split(column, ",")).alias("doc_id")).select(text.strip(F.col("doc_id")).alias("doc_id"))


def delete_report(current: DataFrame, ids: DataFrame) -> DataFrame:
    """One row: ids requested (repeats and unknown ones counted), rows deleted."""
    requested = ids.agg(F.count("*").alias("num_requested"))
    deleted = join_keys(current, ids.select("doc_id"), "doc_id", "left_semi").agg(F.count("*").alias("num_deleted"))
    return requested.select("num_requested", deleted.scalar().alias("num_deleted"))


def update(current: DataFrame, changes: DataFrame, mode: str, embedder=None, order: str | None = None) -> DataFrame:
    """Update by id. ``changes`` has ``content``, ``metadata`` and ``embedding``; of a repeated id the last row by ``order`` counts,
    and without ``order`` a repeated id is an error.

    ``existing``: replace rows that exist and embed them again. ``upsert``: the same, and add the
    others. ``payload_only``: replace text and metadata and keep the old vector.
    """
    if mode not in ("existing", "upsert", "payload_only"):
        raise ValueError(f"unknown update mode {mode!r}")
    changes = written(one_per_id(changes, order).drop(order) if order else changes, "batch")
    ids = changes.select("doc_id")
    if not order and not ids.groupBy("doc_id").count().filter("count > 1").isEmpty():
        raise ValueError("the changes repeat an id: name the column that orders them")
    untouched = join_keys(current, ids, "doc_id", "left_anti")
    if mode == "payload_only":
        touched = join_keys(current, ids, "doc_id", "left_semi").drop("content", "metadata")
        fresh = touched.join(changes.select("doc_id", "content", "metadata"), "doc_id")
        if "content_key" in current.columns:
            fresh = fresh.withColumn("content_key", text.content_key(F.col("content")))
    else:
        if mode == "existing":
            changes = match_few(changes, current, "doc_id", "left_semi")
        fresh = fill_embeddings(changes, embedder) if embedder else changes
    return untouched.unionByName(fresh.select(*current.columns))


def update_report(current: DataFrame, changes: DataFrame, mode: str) -> DataFrame:
    """``doc_id, updated`` for each requested change."""
    if mode == "upsert":
        return changes.select("doc_id", F.lit(True).alias("updated"))
    known = join_keys(current.select("doc_id"), changes.select("doc_id"), "doc_id", "left_semi").distinct()
    return changes.join(known.withColumn("found", F.lit(True)), "doc_id", "left").select(
        "doc_id", F.coalesce("found", F.lit(False)).alias("updated"))


def to_payload(content: Column, metadata: Column, wins: str = "metadata") -> Column:
    """Fold the content into the metadata map; on a clash the metadata or the content wins."""
    if wins not in ("metadata", "content"):
        raise ValueError(f"unknown policy {wins!r}")
    clash = F.try_element_at(metadata, F.lit("content"))
    value = F.coalesce(clash, content) if wins == "metadata" else content
    rest = F.map_filter(metadata, lambda key, _: key != "content")
    return F.map_concat(rest, F.create_map(F.lit("content"), value))


def from_payload(payload: Column) -> tuple[Column, Column]:
    """Content (an empty string when there is none) and the remaining metadata."""
    content = F.coalesce(F.try_element_at(payload, F.lit("content")), F.lit(""))
    return content, F.map_filter(payload, lambda key, _: key != "content")


def stats(docs: DataFrame, name: str, index_type: str = "flat", backend: str = "parquet") -> DataFrame:
    """One row about a collection."""
    size = F.when(F.col("embedding").isNotNull(), F.size("embedding"))
    return docs.agg(F.lit(name).alias("name"), F.count("*").alias("document_count"),
                    F.count("embedding").alias("vector_count"), F.max(size).cast("bigint").alias("dimension"),
                    F.lit(index_type).alias("index_type"), F.lit(backend).alias("backend"))
