"""Incremental jobs: documents into a collection, messages into running totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.functions import text
from corpusloom.operators import mutate
from corpusloom.session import BROADCAST_KEY_BYTES, join_keys, key_bytes, released, written
from corpusloom.sources import collection


def ingest(source: DataFrame, path: str, checkpoint: str, name: str, embedder,
           dimension: int | None = None, order: str = "arrival") -> StreamingQuery:
    """Upsert a stream of ``doc_id, content, metadata, embedding`` into a collection: one folder below ``path`` for each micro-batch, named by its number.

    A folder holds the rows that its micro-batch adds or replaces, so the folders together are as large as what has arrived, however many there are;
    ``latest`` merges them. The column ``order`` decides between versions of one id that fall into one micro-batch: an event time, or the
    ``arrival`` that ``file_stream`` gives. A batch that is replayed after a failure writes its own folder again.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        rows = collection.complete(batch, order, embedder, dimension=dimension)
        with released(batch.sparkSession):
            mutate.one_per_id(rows, order).drop(order).write.mode("overwrite").parquet(version(path, batch_id))

    return (source.writeStream.foreachBatch(apply).queryName(name)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def version(path: str, batch_id: int) -> str:
    return f"{path}/version={batch_id}"


def latest(spark: SparkSession, path: str, until: int | None = None) -> DataFrame:
    """The collection below ``path`` after its last micro-batch, or after the one with the number ``until``: each id with its row of the last batch that holds it.

    Only ids and numbers are shuffled to find the rows that later ones replace; the others move only if more ids have been replaced than may be broadcast.
    """
    versions = spark.read.parquet(path)
    if until is not None:
        versions = versions.filter(F.col("version") <= until)
    repeated = versions.groupBy("doc_id").agg(F.max("version").alias("last"), F.count("*").alias("n")).filter("n > 1")
    with released(spark):
        repeated = written(repeated.select(F.col("doc_id").alias("id"), "last"), "replaced-ids")
    few = F.broadcast(repeated) if key_bytes(repeated) <= BROADCAST_KEY_BYTES else repeated
    return versions.join(few, (F.col("doc_id") == F.col("id")) & (F.col("version") < F.col("last")), "left_anti").drop("version")


def token_totals(messages: DataFrame) -> DataFrame:
    """Running totals per conversation. The state keeps one row per conversation for ever."""
    return messages.groupBy("conv_id").agg(F.count("*").alias("n_messages"), F.sum(F.length("text")).alias("n_chars"))


def stream_token_totals(messages: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Current totals of all conversations, one version for each micro-batch: the totals that have changed replace those of the version before, which is all that is read.

    A replayed batch writes its own version again.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        changed = written(batch, "changed-totals")
        if batch_id:
            before = batch.sparkSession.read.schema(batch.schema).parquet(version(path, batch_id - 1))
            changed = join_keys(before, changed.select("conv_id"), "conv_id", "left_anti").unionByName(changed)
        changed.write.mode("overwrite").parquet(version(path, batch_id))

    return (token_totals(messages).writeStream.outputMode("update").foreachBatch(apply)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def latest_totals(spark: SparkSession, path: str) -> DataFrame:
    """The totals of the last version below ``path``; the others are partitions that are not read."""
    versions = spark.read.parquet(path)
    last = versions.agg(F.max("version")).first()[0]
    return versions.filter(F.col("version") == last).drop("version").withColumn("est_tokens", text.token_estimate(F.col("n_chars")))


def run(query: StreamingQuery) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def file_stream(spark: SparkSession, path: str, like: DataFrame, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files as a stream, with ``arrival``: time and name of the file, and the row's place in it."""
    reader = spark.readStream.schema(like.schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    arrival = F.struct(F.col("_metadata.file_modification_time").alias("file_time"), F.col("_metadata.file_path").alias("file"),
                       F.col("_metadata.row_index").alias("row"))
    return reader.parquet(path).withColumn("arrival", arrival)


def write_part(df: DataFrame, path: str) -> None:
    """Add files to a folder that a stream reads."""
    df.write.mode("append").parquet(path)
