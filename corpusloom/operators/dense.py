"""Exact vector search, and the embedding of tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from corpusloom.functions import filters, scores
from corpusloom.operators.block_topk import Kernel, block_topk, id_array
from corpusloom.schemas import BlockLimits
from corpusloom.session import join_keys, match_few, written

# Scores that are computed at once, in the processor's cache.
CACHED_CELLS = 1 << 17


def vector_matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column of equal-length vectors as a double matrix; vectors of other lengths are an error."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pc.unique(pc.list_value_length(column)).to_pylist()
    if len(lengths) > 1 or None in lengths:
        raise ValueError(f"vectors of one dimension are needed, found lengths {sorted(lengths, key=str)}")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


class VectorKernel(Kernel):
    """Costs of one query block against document vectors, rounded to six decimals.

    Copies of a vector tie exactly after rounding, so the cut at k does not depend on how the rows
    are spread over tasks.
    """

    def __init__(self, metric: str, matrix_cells: int):
        self.metric, self.matrix_cells = metric, matrix_cells
        self.known: dict[int, tuple] | None = None

    def hold(self, docs: list[pa.RecordBatch]) -> None:
        super().hold(docs)
        self.known = {}

    def _read(self, docs: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, vectors and their squares; of documents that are held they are kept for the next block of queries."""
        if self.known is not None and id(docs) in self.known:
            return self.known[id(docs)]
        vectors = self._unit(vector_matrix(docs.column(docs.schema.get_field_index("embedding"))))
        read = id_array(docs.column(docs.schema.get_field_index("doc_id"))), vectors, (vectors ** 2).sum(axis=1)
        if self.known is not None:
            self.known[id(docs)] = read
        return read

    def load(self, queries: pa.Table) -> None:
        self.queries = self._unit(vector_matrix(queries.column("embedding")))
        self.squares = (self.queries ** 2).sum(axis=1)
        asked = queries.column("filter").to_pylist() if "filter" in queries.column_names else []
        self.matcher = filters.Matcher(asked) if asked and pa.types.is_string(queries.schema.field("filter").type) else None
        asked = [] if self.matcher else [dict(pairs or ()) for pairs in asked]
        # Per key: the values asked for, and each query's place among them (-1: no condition).
        self.conditions = {}
        for key in sorted({key for pairs in asked for key in pairs}):
            values = sorted({pairs[key] for pairs in asked if pairs.get(key) is not None})
            place = {value: i for i, value in enumerate(values)} | {None: len(values)}
            wanted = np.array([place[pairs[key]] if key in pairs else -1 for pairs in asked])
            self.conditions[key] = (pa.array(values, pa.string()), wanted)

    def costs(self, docs: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if not docs.num_rows or not len(self.queries):
            return
        ids, vectors, squares = self._read(docs)
        if vectors.shape[1] != self.queries.shape[1]:
            raise ValueError(f"vectors of one dimension are needed, found lengths {self.queries.shape[1]} and {vectors.shape[1]}")
        step = max(1, self.matrix_cells // len(self.queries))
        found = self._found(docs)
        if self.matcher:
            self.matcher.bind(docs.column(docs.schema.get_field_index("metadata")))
        for start in range(0, len(ids), step):
            cost = self._cost(vectors[start:start + step], squares[start:start + step])
            if self.matcher:
                # The last row is for queries without a filter. Masks are as many cells as costs, so they are made for the same stretch of documents.
                masks = self.matcher.rows(start, min(start + step, len(ids)))
                cost[np.concatenate([~masks, np.zeros((1, cost.shape[1]), bool)])[self.matcher.place]] = np.nan
            for wanted, given in found:
                cost[(wanted >= 0)[:, None] & (wanted[:, None] != given[None, start:start + step])] = np.nan
            yield ids[start:start + step], cost

    def _found(self, docs: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per key: each query's wanted place, and the place of each document's value (-2: not asked for)."""
        found = []
        for key, (values, wanted) in self.conditions.items():
            given = pc.map_lookup(docs.column(docs.schema.get_field_index("metadata")), pa.scalar(key), "first")
            found.append((wanted, pc.fill_null(pc.index_in(given, value_set=values), -2).to_numpy()))
        return found

    def _unit(self, vectors: np.ndarray) -> np.ndarray:
        if self.metric != "cosine":
            return vectors
        with np.errstate(invalid="ignore", divide="ignore"):
            return vectors / np.sqrt((vectors ** 2).sum(axis=1, keepdims=True))

    def _cost(self, vectors: np.ndarray, own: np.ndarray) -> np.ndarray:
        cost = np.empty((len(self.queries), len(vectors)))
        step = max(1, CACHED_CELLS // max(len(vectors), 1))
        for start in range(0, len(cost), step):
            # In place, a few rows at a time: a matrix is the largest thing that a task makes, and each of these passes would fetch it from memory.
            block, products = cost[start:start + step], self.queries[start:start + step] @ vectors.T
            if self.metric in ("cosine", "dot"):
                np.round(products, 6, out=products)
                np.subtract(0.0, products, out=block)
                block[np.isnan(block)] = np.inf  # a zero vector has no cosine: ranked last
                continue
            products *= 2.0
            np.add(self.squares[start:start + step, None], own[None, :], out=block)
            block -= products
            np.maximum(block, 0.0, out=block)
            if self.metric == "euclid":
                np.sqrt(block, out=block)
            np.round(block, 6, out=block)
        return cost


def search(queries: DataFrame, docs: DataFrame, k: int, metric: str = "l2", score: str = "inverse",
           limits: BlockLimits = BlockLimits()) -> DataFrame:
    """Exact top-k: ``query_id, doc_id, rank, score, distance``.

    ``queries`` has ``query_id, embedding`` and ``docs`` has ``doc_id, embedding``, all vectors of one
    dimension (see ``mutate.split_by_dimension``). A filter for all queries is a plain filter on
    ``docs`` before the search, or on the result after it. When ``queries`` has a column ``filter``,
    each query sees only the documents whose ``metadata`` passes: a string map asks for equality on every key, a JSON object may have operators (see
    ``filters.translate``). All filters are tested in the one scan of the documents. A query without a vector has no hits; documents without a vector or an id are never hits.
    """
    scores.check_metric(metric)
    kernel = VectorKernel(metric, limits.matrix_cells)
    own_filters = "filter" in queries.columns
    docs = docs.filter(F.col("embedding").isNotNull() & F.col("doc_id").isNotNull())
    queries = queries.filter(F.col("embedding").isNotNull())
    hits = block_topk(queries.select("query_id", "embedding", *["filter"] * own_filters),
                      docs.select("doc_id", "embedding", *["metadata"] * own_filters),
                      F.size("embedding") * 8 + (F.coalesce(F.octet_length(_text(queries)), F.lit(0)) if own_filters else 0), F.size("embedding") * 8, kernel, k, limits)
    return as_hits(hits, metric, score)


def _text(queries: DataFrame) -> Column:
    column = F.col("filter")
    return column if isinstance(queries.schema["filter"].dataType, T.StringType) else F.to_json(column)


def as_hits(ranked: DataFrame, metric: str, score: str) -> DataFrame:
    cost = F.col("cost")
    return ranked.select("query_id", "doc_id", "rank", scores.score(metric, score, cost).alias("score"),
                         scores.distance(metric, cost).alias("distance"))


def search_filtered(queries: DataFrame, docs: DataFrame, keep: Column, k: int, mode: str = "pre",
                    metric: str = "l2", score: str = "inverse",
                    limits: BlockLimits = BlockLimits()) -> DataFrame:
    """Search under a metadata condition on ``docs``, applied before the ranking or after it.

    With ``mode="post"`` dropped documents have used up places, so fewer than k rows may come back.
    """
    if mode == "pre":
        return search(queries, docs.filter(keep), k, metric, score, limits)
    if mode != "post":
        raise ValueError(f"unknown filter mode {mode!r}")
    hits = written(search(queries, docs, k, metric, score, limits), "unfiltered-hits")
    return match_few(hits, docs.filter(keep), "doc_id", "left_semi")


def search_without(queries: DataFrame, docs: DataFrame, deleted: DataFrame, k: int, mode: str = "pre",
                   metric: str = "l2", score: str = "inverse",
                   limits: BlockLimits = BlockLimits()) -> DataFrame:
    """Search past deleted ids. ``mode="post"`` lets a deleted row take a place and then drops it."""
    ids = deleted.select("doc_id")
    if mode == "pre":
        return search(queries, join_keys(docs, ids, "doc_id", "left_anti"), k, metric, score, limits)
    if mode != "post":
        raise ValueError(f"unknown filter mode {mode!r}")
    hits = written(search(queries, docs, k, metric, score, limits), "unfiltered-hits")
    return match_few(hits, ids, "doc_id", "left_anti")


def above_threshold(hits: DataFrame, threshold: float) -> DataFrame:
    return hits.filter(F.col("score") >= threshold)
