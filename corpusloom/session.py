"""Session helpers: the shared scratch folder, written tables, size checks."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession, functions as F

# Bytes of keys (each with 16 more for its row) up to which an id table may be broadcast.
BROADCAST_KEY_BYTES = 64 << 20
KEY_OVERHEAD = 16
# Rows of one task where each row means costly work.
SPREAD_ROWS = 10_000


_local_folders: WeakKeyDictionary = WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local session without that setting falls back to a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    if spark.sparkContext not in _local_folders:
        _local_folders[spark.sparkContext] = tempfile.mkdtemp(prefix="corpusloom-")
    return _local_folders[spark.sparkContext]


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def planned_splits(df: DataFrame) -> int:
    """About how many tasks a scan of ``df`` has, by the planner's own estimate of its size; no data and no list of files is read for it."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    most = df.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return max(1, -(-size // most))


def spread(df: DataFrame, n_rows: int, *keys: str) -> DataFrame:
    """Repartition narrow rows before costly work on each of them.

    Adaptive execution sizes partitions by bytes, so a few narrow rows would end up in one task even
    if each of them is about to be joined with a long text or sent to a model.
    """
    tasks = max(-(-n_rows // SPREAD_ROWS), df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(tasks, *keys)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage, keeps costly or unrepeatable hooks from running twice, survives the loss of
    executors, and gives Catalyst the true size of the table for its choice of join.
    """
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of a write go as soon as it is done; later steps read the written tables."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def key_bytes(keys: DataFrame) -> int:
    """Size of a table of keys, added up in the tasks that read it."""
    size = sum((F.coalesce(F.octet_length(F.col(name).cast("string")), F.lit(0)) for name in keys.columns), F.lit(KEY_OVERHEAD))
    return keys.agg(F.coalesce(F.sum(size.cast("bigint")), F.lit(0))).first()[0]


def join_keys(df: DataFrame, keys: DataFrame, on: str, how: str, bound: int = BROADCAST_KEY_BYTES) -> DataFrame:
    """Join with a key table: broadcast it when its measured bytes are within the bound, shuffle otherwise.

    ``keys`` is read twice (measure, join), so pass a written table or a plain scan.
    """
    if key_bytes(keys) <= bound:
        keys = F.broadcast(keys)
    return df.join(keys, on, how)


def match_few(few: DataFrame, many: DataFrame, on: str, how: str) -> DataFrame:
    """Semi or anti join of a short table with a long key table, without shuffling the long one.

    The long table is first cut to the keys of the short one, which is read several times and
    therefore a written table or a plain scan.
    """
    present = join_keys(many.select(on), few.select(on).distinct(), on, "left_semi")
    return few.join(present, on, how)
