"""Top-k of a query table against a document table, without forming the pairs as rows.

Exact search compares every query with every document of its cell. As a join that would emit all
pairs; here a task scores one block of documents against one block of queries as a matrix and emits
the block's best k per query only:

* ``broadcast_topk``: queries whose measured bytes are within the bound go to every executor. Documents are scanned where they lie; a task
  takes in a bounded number of them and then meets the queries block by block.
* ``paired_topk``: a larger query table is dealt to bounded parts of the documents as rows of one plan: a task takes in the
  documents of a part and then its queries, batch by batch. No query passes through the driver, and each table is scanned once. Queries are
  copied to a fixed number of parts, whatever the size of the table, until parts are as large as a task may hold.

``cell_topk`` is the same for sides that carry a cell (an inverted list, a hash bucket): only rows of
one cell meet, and cells above the block bound, on either side, are split into such blocks, so a cell
that holds a third of all rows becomes many tasks of bounded size.

A final window keeps k rows per query; its input is k rows per query and block.

A *kernel* turns Arrow data into costs (smaller is better, infinity is last, NaN is excluded):
``load(queries)`` takes the query block, ``costs(documents)`` yields ``(ids, matrix)``; see ``Kernel``.
"""

from __future__ import annotations

from collections.abc import Iterator
from copy import copy
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from corpusloom.schemas import BlockLimits
from corpusloom.session import planned_splits, written

HIT_FIELDS = ("query_id", "doc_id", "cost")
# Splits of the documents from which hits are reduced in levels.
LEVELLED_SPLITS = 64


class BestK:
    """Running best k per query row; ties go to the smaller document id."""

    def __init__(self, n_rows: int, k: int):
        self.n_rows, self.k = n_rows, k
        self.bar = np.full(n_rows, np.inf)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.pending = 0

    def offer(self, ids: np.ndarray, cost: np.ndarray) -> None:
        near = cost <= self.bar[:, None]
        if cost.shape[1] > self.k and np.count_nonzero(near) > self.n_rows * self.k:
            # The k-th cost of any block is a bound of the k-th of all.
            self.bar = np.fmin(self.bar, np.partition(cost, self.k - 1, axis=1)[:, self.k - 1])
            near = cost <= self.bar[:, None]
        rows, cols = np.nonzero(near)
        if len(rows):
            self.parts.append((rows, cost[rows, cols], ids[cols]))
            self.pending += len(rows)
            if self.pending > max(1 << 18, 2 * self.n_rows * self.k):
                self.merge()

    def take(self, row: int, ids: np.ndarray, cost: np.ndarray) -> None:
        """Candidates of one query."""
        self.parts.append((np.full(len(ids), row), cost, ids))
        self.pending += len(ids)

    def merge(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.parts:
            return np.empty(0, int), np.empty(0), np.empty(0, int)
        rows, cost, ids = (np.concatenate(column) for column in zip(*self.parts))
        order = np.lexsort((ids, cost, rows))
        rows, cost, ids = rows[order], cost[order], ids[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        keep = place < self.k
        self.bar[rows[place == self.k - 1]] = cost[place == self.k - 1]
        rows, cost, ids = rows[keep], cost[keep], ids[keep]
        self.parts, self.pending = [(rows, cost, ids)], 0
        return rows, cost, ids


class Kernel:
    """Best k of a block of queries over documents that are held in memory."""

    def hold(self, docs: list[pa.RecordBatch]) -> None:
        self.held = docs

    def best(self, queries: pa.Table, k: int) -> BestK:
        self.load(queries)
        best = BestK(queries.num_rows, k)
        for batch in self.held:
            for ids, cost in self.costs(batch):
                best.offer(ids, cost)
        return best


def id_array(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    values = column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()
    return values.astype("U") if values.dtype == object else values


def hit_table(best: BestK, query_ids: pa.Array, doc_type: pa.DataType) -> pa.Table:
    rows, cost, ids = best.merge()
    doc_ids = pa.array(ids.tolist() if ids.dtype.kind == "U" else ids, type=doc_type)
    cost = pa.array(cost, mask=np.isinf(cost))
    return pa.table([query_ids.take(pa.array(rows)), doc_ids, cost], names=list(HIT_FIELDS))


def hit_schema(queries: DataFrame, docs: DataFrame) -> T.StructType:
    return T.StructType([
        T.StructField("query_id", queries.schema["query_id"].dataType),
        T.StructField("doc_id", docs.schema["doc_id"].dataType if "doc_id" in docs.columns else docs.schema["ids"].dataType.elementType),
        T.StructField("cost", T.DoubleType()),
    ])


def block_topk(queries: DataFrame, docs: DataFrame, query_bytes: Column, doc_bytes: Column, kernel: Kernel, k: int,
               limits: BlockLimits = BlockLimits()) -> DataFrame:
    """Best k documents per query over the whole document table: ``query_id, doc_id, rank, cost``.

    ``query_bytes`` and ``doc_bytes`` are the sizes of one row of each side. The query table is read twice (measure, ship), and so are
    the documents if the queries are too many for a broadcast: pass written tables when they are costly or not repeatable.
    """
    n_queries, size = queries.agg(F.count("*"), F.coalesce(F.sum(query_bytes), F.lit(0))).first()
    if size <= limits.broadcast_bytes:
        hits = broadcast_topk(queries, docs, kernel, k, limits)
    else:
        n_docs, size = docs.agg(F.count("*"), F.coalesce(F.sum(doc_bytes), F.lit(0))).first()
        # Every query goes to every part: with parts of a fixed number of rows the copies would grow with the square of the input.
        n_parts = max(1, min(-(-n_docs // limits.doc_rows), limits.query_copies), -(-size // limits.doc_bytes))
        # No key decides the part, so copies of one id don't fill one task.
        parts = docs.withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(n_parts)))
        # Comparisons grow with the square of the input; the number of tasks grows with them, so that each one's share stays bounded.
        n_blocks = max(1, -(-n_queries * -(-n_docs // n_parts) // limits.task_pairs))
        hits = paired_topk(queries, parts, n_parts, kernel, k, limits, n_blocks)
    groups = limits.reduce_groups
    if groups is None:
        splits = planned_splits(docs)
        groups = ceil(splits ** 0.5) if splits >= LEVELLED_SPLITS else 1
    if groups > 1:
        # Tasks x queries x k rows would meet in the final cut: groups of tasks are cut first.
        group = F.pmod(F.spark_partition_id(), F.lit(groups))
        window = Window.partitionBy("query_id", "group").orderBy(F.col("cost").asc_nulls_last(), "doc_id")
        hits = hits.withColumn("group", group).withColumn("place", F.row_number().over(window))
        hits = hits.filter(F.col("place") <= k).drop("group", "place")
    return best_per_query(hits, k)


def best_per_query(hits: DataFrame, k: int) -> DataFrame:
    """The final cut. ``row_number() <= k`` is planned as a partial limit before its shuffle."""
    window = Window.partitionBy("query_id").orderBy(F.col("cost").asc_nulls_last(), "doc_id")
    return (hits.withColumn("rank", F.row_number().over(window).cast("bigint"))
            .filter(F.col("rank") <= k)
            .select("query_id", "doc_id", "rank", "cost"))


def paired_topk(queries: DataFrame, docs: DataFrame, n_parts: int, kernel: Kernel, k: int, limits: BlockLimits, n_blocks: int = 1) -> DataFrame:
    """Every query against every ``part`` (0 to ``n_parts`` - 1) of the documents, which a task must be able to hold.

    With ``n_blocks`` a part meets the queries in so many tasks, each of which has a block of them. Returns up to k rows per query and part.
    """
    parts = F.sequence(F.lit(0).cast("long"), F.lit(n_parts - 1).cast("long"))
    asked = queries.withColumn("part", F.explode(parts)).withColumn("__asked", F.lit(True))
    docs_in = docs.withColumn("__asked", F.lit(False))
    if n_blocks > 1:
        blocks = F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))
        docs_in = docs_in.withColumn("__block", F.explode(blocks)).withColumn("part", F.col("part") * n_blocks + F.col("__block")).drop("__block")
        # No key decides the block, so copies of one id don't fill one task.
        asked = (queries.withColumn("__block", F.pmod(F.monotonically_increasing_id(), F.lit(n_blocks))).withColumn("part", F.explode(parts))
                 .withColumn("part", F.col("part") * n_blocks + F.col("__block")).drop("__block").withColumn("__asked", F.lit(True)))
    both = docs_in.unionByName(asked, allowMissingColumns=True)
    both = both.repartition(n_parts * n_blocks, "part").sortWithinPartitions("part", "__asked")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, docs, ready = None, [], False
        for batch in batches:
            for at, asking, rows in _stretches(batch, limits.query_rows):
                if at != part:
                    part, docs, ready = at, [], False
                if not asking:
                    docs.append(rows)
                    continue
                if not ready:
                    kernel.hold(docs)
                    ready = True
                if docs:
                    table = pa.Table.from_batches([rows])
                    yield from hit_table(kernel.best(table, k), table.column("query_id").combine_chunks(), doc_type).to_batches()

    doc_type = to_arrow_type(docs.schema["doc_id"].dataType) if "doc_id" in docs.columns else to_arrow_type(docs.schema["ids"].dataType.elementType)
    return both.mapInArrow(search, hit_schema(queries, docs))


def _stretches(batch: pa.RecordBatch, most: int) -> Iterator[tuple[int, bool, pa.RecordBatch]]:
    """Consecutive rows of one part that are all documents, or up to ``most`` queries."""
    asked = batch.column(batch.schema.get_field_index("__asked")).to_numpy(zero_copy_only=False)
    key = batch.column(batch.schema.get_field_index("part")).to_numpy() * 2 + asked
    cuts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(key)], strict=True):
        step = most if asked[a] else b - a
        for start in range(a, b, max(step, 1)):
            yield int(key[a]) // 2, bool(asked[a]), batch.slice(start, min(step, b - start))


def broadcast_topk(queries: DataFrame, docs: DataFrame, kernel: Kernel, k: int, limits: BlockLimits = BlockLimits()) -> DataFrame:
    """Map-side form. The caller has checked that the query block is small. Returns up to k rows per query and stretch of documents that a task holds."""
    shared = queries.sparkSession.sparkContext.broadcast(queries.toArrow().combine_chunks())

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for held in _held(batches, limits):
            doc_type = held[0].schema.field("doc_id").type
            kernel.hold(held)
            for start in range(0, block.num_rows, limits.query_rows):
                asked = block.slice(start, limits.query_rows)
                yield from hit_table(kernel.best(asked, k), asked.column("query_id").combine_chunks(), doc_type).to_batches()

    return docs.mapInArrow(search, hit_schema(queries, docs))


def _held(batches: Iterator[pa.RecordBatch], limits: BlockLimits) -> Iterator[list[pa.RecordBatch]]:
    """Consecutive documents that a task may hold; as doubles their vectors take twice the bytes that they have here."""
    held, n_rows, size = [], 0, 0
    for batch in batches:
        step = max(1, min(limits.doc_rows, limits.doc_bytes // 2 * batch.num_rows // max(batch.nbytes, 1)))
        for start in range(0, batch.num_rows, step):
            rows = batch.slice(start, step)
            if held and (n_rows + rows.num_rows > limits.doc_rows or 2 * (size + rows.nbytes) > limits.doc_bytes):
                yield held
                held, n_rows, size = [], 0, 0
            held.append(rows)
            n_rows, size = n_rows + rows.num_rows, size + rows.nbytes
    if held:
        yield held


def cell_topk(queries: DataFrame, docs: DataFrame, kernel, k: int, payload_bytes: Column | None = None,
              limits: BlockLimits = BlockLimits()) -> DataFrame:
    """Search inside each shared ``cell``. Returns up to k rows per query and task or block; finish with ``best_per_query``.

    Queries whose bytes are within the bound go to every executor, with the cells that each of them visits, and documents stay where they lie. Otherwise both
    sides are shuffled by cell, large cells split into bounded blocks. ``queries`` is read twice: pass a written table.
    """
    if payload_bytes is not None and queries.agg(F.coalesce(F.sum(payload_bytes), F.lit(0))).first()[0] <= limits.broadcast_bytes:
        return broadcast_cells(queries, docs, kernel, k)
    # At most one row per doc_rows documents, and per query_rows queries.
    large_docs = F.broadcast(_large_cells(docs, limits.doc_rows, "n_doc_parts"))
    large_queries = F.broadcast(_large_cells(queries, limits.query_rows, "n_query_parts"))
    split = [side.join(large_docs, "cell", "left").join(large_queries, "cell", "left")
             .fillna(1, ["n_doc_parts", "n_query_parts"]) for side in (queries, docs)]
    return _search_blocks(["cell"], *split, kernel, k)


def broadcast_cells(queries: DataFrame, docs: DataFrame, kernel, k: int) -> DataFrame:
    """Map-side form for a query block that is small, with one row for each cell that a query visits."""
    shared = queries.sparkSession.sparkContext.broadcast(queries.toArrow())

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value.combine_chunks()
        own = block.column("cell").to_numpy()
        found: dict[int, tuple] = {}
        doc_type = None
        for batch in batches:
            doc_type = batch.schema.field("doc_id").type
            cells = batch.column(batch.schema.get_field_index("cell")).to_numpy()
            for cell in np.unique(cells).tolist():
                if cell not in found:
                    asked = block.take(pa.array(np.flatnonzero(own == cell)))
                    found[cell] = (copy(kernel), BestK(asked.num_rows, k), asked)
                    if asked.num_rows:
                        found[cell][0].load(asked)
                held, best, asked = found[cell]
                if asked.num_rows:
                    for ids, cost in held.costs(batch.take(pa.array(np.flatnonzero(cells == cell)))):
                        best.offer(ids, cost)
        for _, best, asked in found.values():
            yield from hit_table(best, asked.column("query_id").combine_chunks(), doc_type).to_batches()

    return docs.mapInArrow(search, hit_schema(queries, docs))


def _search_blocks(cell: list[str], queries: DataFrame, docs: DataFrame, kernel, k: int) -> DataFrame:
    """Cut both sides into their parts, repeat each row for the parts of the other side, and search
    the blocks."""
    queries = queries.toDF(*queries.columns)  # the sides may come from one table

    def blocks(side: DataFrame, key: str, own: str, other: str) -> DataFrame:
        mine = F.pmod(F.xxhash64(key), F.col(f"n_{own}_parts"))
        return (side.withColumn(f"{own}_part", mine)
                .withColumn(f"{other}_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(f"n_{other}_parts") - 1)))
                .drop("n_doc_parts", "n_query_parts"))

    doc_blocks, query_blocks = blocks(docs, "doc_id", "doc", "query"), blocks(queries, "query_id", "query", "doc")

    def search(doc_table: pa.Table, query_table: pa.Table) -> pa.Table:
        doc_type = doc_table.schema.field("doc_id").type
        query_ids = query_table.column("query_id").combine_chunks()
        best = BestK(query_table.num_rows, k)
        if query_table.num_rows and doc_table.num_rows:
            kernel.load(query_table.combine_chunks())
            for batch in doc_table.combine_chunks().to_batches():
                for ids, cost in kernel.costs(batch):
                    best.offer(ids, cost)
        return hit_table(best, query_ids, doc_type)

    keys = [*cell, "doc_part", "query_part"]
    return (doc_blocks.groupBy(*keys).cogroup(query_blocks.groupBy(*keys))
            .applyInArrow(search, hit_schema(queries, docs)))


def _large_cells(side: DataFrame, bound: int, name: str) -> DataFrame:
    parts = F.ceil(F.col("count") / bound)
    large = (side.groupBy("cell").count().filter(F.col("count") > bound)
             .select("cell", parts.cast("bigint").alias(name)))
    return written(large, "large-cells")
