"""Connected components of a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusloom.session import written


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each id of a task's links with the smallest id that these links lead to."""
    root: dict[int, int] = {}

    def find(i: int) -> int:
        while root.setdefault(i, i) != i:
            root[i] = i = root[root[i]]
        return i

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    pairs = [(i, find(i)) for i in list(root)]
    pairs = [(i, r) for i, r in pairs if i != r]
    yield pa.RecordBatch.from_arrays([pa.array([p[n] for p in pairs], pa.int64()) for n in (0, 1)], ["u", "v"])


def components(links: DataFrame, task_links: int = 200_000) -> DataFrame:
    """``id``, ``component`` (smallest id that links lead to) of every id in ``links`` (``a``, ``b``); links of an id with itself say nothing.

    ``links`` is read twice, so pass a written table. Links are first contracted in tasks of about ``task_links`` rows. Unless one task held them all, two steps
    then alternate over the whole table: every id joins its larger neighbours to its smallest one, then its smaller ones. The number
    of rounds grows with the logarithm of the longest chain, and no group is held in one place.
    """
    links = links.filter("a <> b").select("a", "b")
    tasks = max(1, -(-links.count() // task_links))
    edges = written(links.repartition(tasks).mapInArrow(_contracted, "u long, v long"), "links")
    state = None
    while tasks > 1:
        now = edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if now == state:
            break
        state = now
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "links")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select("v", "m").filter("v <> m").union(least.select("u", "m")).toDF("u", "v").distinct()
        edges = written(small, "links")
    found = edges.groupBy("u").agg(F.min("v").alias("v"))
    return found.union(found.select("v", "v").distinct()).toDF("id", "component")
