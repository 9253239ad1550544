"""Approximate vector search: inverted lists around k-means centroids, and random-projection hashing.

Both only choose which cells a query visits. Ranking inside the cells is exact and shared with the
exact search, and cells of any size are split into bounded blocks there. Inverted lists know their radius, so that a search can also go on
until no list that is left can hold a nearer vector. Hashing comes with random projections of Spark's own, one bucket a table, and with given
projections in whole numbers, of which a query probes several neighbouring buckets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import BucketedRandomProjectionLSH, BucketedRandomProjectionLSHModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F, types as T

from corpusloom.operators import dense
from corpusloom.operators.block_topk import best_per_query, cell_topk
from corpusloom.schemas import BlockLimits
from corpusloom.session import join_keys, written

# Fixed value: the usual number of inverted lists.
N_LISTS = 100


# Vectors per list that the centroids are trained on.
SAMPLE = 64


@dataclass(frozen=True)
class InvertedLists:
    """Centroids, one per list: lists x dimension doubles, bounded by the number of lists."""

    centroids: np.ndarray


def train_lists(docs: DataFrame, n_lists: int = N_LISTS, seed: int = 42, max_iter: int = 10) -> InvertedLists:
    """K-means centroids of a sample: the ``SAMPLE`` vectors per list with the smallest hashes of their ids. Let ``n_lists`` grow about as the square root of the table."""
    vectors = docs.filter(F.col("embedding").isNotNull()).select("doc_id", "embedding")
    rows = vectors.orderBy(F.xxhash64(F.col("doc_id"), F.lit(seed)), "doc_id").limit(SAMPLE * n_lists).select("embedding").toArrow()
    x = dense.vector_matrix(rows.column("embedding")) if rows.num_rows else np.zeros((1, 1))
    centroids = x[np.random.default_rng(seed).permutation(len(x))[:n_lists]].copy()
    for _ in range(max_iter):
        nearest = ((centroids ** 2).sum(1) - 2.0 * x @ centroids.T).argmin(1)
        count = np.bincount(nearest, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, x)
        centroids[count > 0] = sums[count > 0] / count[count > 0, None]
    return InvertedLists(centroids)


def mean_lists(docs: DataFrame, by: str) -> InvertedLists:
    """Centroids of given groups: the mean vector of each value of ``by``, in the order of the values."""
    cells = docs.select(by, F.posexplode("embedding").alias("cell", "value"))
    means = cells.groupBy(by, "cell").agg(F.avg(F.col("value").cast("double")).alias("value"))
    # As many rows as there are groups.
    rows = means.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("cell", "value"))).alias("mean")).orderBy(by).collect()
    return InvertedLists(np.array([[cell.value for cell in row["mean"]] for row in rows]))


def nearest_lists(df: DataFrame, lists: InvertedLists, n: int = 1) -> DataFrame:
    """Add ``list_id``, one row for each of the n nearest lists. Map-side only."""
    schema = T.StructType([*df.schema.fields, T.StructField("list_id", T.IntegerType())])
    shared = df.sparkSession.sparkContext.broadcast(lists.centroids)
    n = min(n, len(lists.centroids))
    as_matrix = dense.vector_matrix

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = shared.value
        squares = (centroids ** 2).sum(axis=1)
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = as_matrix(batch.column(batch.schema.get_field_index("embedding")))
            nearest = np.argsort(squares - 2.0 * vectors @ centroids.T, axis=1, kind="stable")[:, :n]
            rows = pa.array(np.repeat(np.arange(batch.num_rows), n))
            repeated = batch.take(rows)
            yield pa.RecordBatch.from_arrays(
                repeated.columns + [pa.array(nearest.ravel().astype(np.int32))],
                names=repeated.schema.names + ["list_id"])

    return df.mapInArrow(run, schema)


def store_lists(docs: DataFrame, lists: InvertedLists, path: str) -> DataFrame:
    """Store ``doc_id, embedding`` by list. A long list is split over several files by size."""
    assigned = nearest_lists(docs.select("doc_id", "embedding"), lists)
    assigned.hint("rebalance", "list_id").write.partitionBy("list_id").parquet(path)
    return docs.sparkSession.read.schema(assigned.schema).parquet(path)


def _payload() -> Column:
    return F.size("embedding") * 8 + 16


def search_lists(queries: DataFrame, docs: DataFrame, lists: InvertedLists, k: int, n_probe: int,
                 metric: str = "l2", score: str = "inverse",
                 limits: BlockLimits = BlockLimits()) -> DataFrame:
    """Top-k among the ``n_probe`` nearest lists. ``docs`` carries ``list_id``.

    Stored lists (``store_lists``) that no query probes are not read: they are pruned partitions.
    """
    probes = written(nearest_lists(queries.select("query_id", "embedding"), lists, n_probe), "probes")
    hits = _search_probed(probes, docs, k, metric, limits)
    return dense.as_hits(best_per_query(hits, k), metric, score)


def _search_probed(probes: DataFrame, docs: DataFrame, k: int, metric: str, limits: BlockLimits) -> DataFrame:
    # At most one number per list, and the centroids of all lists are on the driver already.
    probed = [row.list_id for row in probes.select("list_id").distinct().collect()]
    candidates = docs.select("doc_id", "embedding", "list_id").filter(F.col("list_id").isin(probed))
    return cell_topk(probes.withColumnRenamed("list_id", "cell"), candidates.withColumnRenamed("list_id", "cell"),
                     dense.VectorKernel(metric, limits.matrix_cells), k, _payload(), limits)


def list_radii(docs: DataFrame, lists: InvertedLists) -> np.ndarray:
    """Largest distance of a vector from the centroid of its list; minus infinity for a list without vectors."""
    centroids, as_matrix = lists.centroids, dense.vector_matrix

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        radius = np.full(len(centroids), -np.inf)
        for batch in batches:
            if batch.num_rows:
                x, own = as_matrix(batch.column(0)), batch.column(1).to_numpy()
                np.maximum.at(radius, own, np.sqrt(((x - centroids[own]) ** 2).sum(1)))
        found = np.flatnonzero(radius >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(radius[found])], ["list_id", "radius"])

    rows = docs.select("embedding", F.col("list_id").cast("int")).mapInArrow(run, "list_id int, radius double")
    radii = np.full(len(centroids), -np.inf)
    for row in rows.groupBy("list_id").agg(F.max("radius").alias("radius")).collect():
        radii[row.list_id] = row.radius
    return radii


def search_all_lists(queries: DataFrame, docs: DataFrame, lists: InvertedLists, k: int, metric: str = "l2", score: str = "inverse",
                     limits: BlockLimits = BlockLimits(), first: int = 1, growth: int = 4, log: list[int] | None = None) -> DataFrame:
    """Exact top-k by ``l2`` or ``euclid``: the lists of a query are visited in the order of the least distance that a vector in them can have.

    Rounds of ``first``, then ``growth`` times as many lists go on until the next list's least distance is above the distance of the k-th hit so far; a query that is done drops out.
    ``docs`` carries ``list_id``, as ``store_lists`` leaves it. ``log`` takes the number of (query, list) visits of each round.
    """
    if metric not in ("l2", "euclid"):
        raise ValueError(f"no bound for the metric {metric!r}")
    radii, centroids, as_matrix = list_radii(docs, lists), lists.centroids, dense.vector_matrix
    own = written(queries.filter(F.col("embedding").isNotNull()).select("query_id", "embedding"), "queries")
    kinds = own.schema["query_id"].dataType.simpleString(), own.schema["embedding"].dataType.simpleString()
    state, hits, done, n = own.withColumn("worst", F.lit(float("inf"))), None, 0, first
    while done < len(centroids):
        def visits(batches: Iterator[pa.RecordBatch], done: int = done, n: int = n) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = as_matrix(batch.column(1))
                distance = np.sqrt(np.maximum((x ** 2).sum(1)[:, None] + (centroids ** 2).sum(1) - 2.0 * x @ centroids.T, 0))
                least = np.where(radii >= 0, np.maximum(distance - radii, 0), np.inf)
                # Lists that must hold any nearest vectors first: equal bounds go by the distance of the centroid.
                order = np.lexsort((distance, least))[:, done:done + n]
                bound = np.take_along_axis(least, order, 1)
                worst = batch.column(2).to_numpy()
                worst = np.sqrt(worst + 1e-6) if metric == "l2" else worst + 1e-6
                row, place = np.nonzero(np.isfinite(bound) & (bound <= (worst * (1 + 1e-9) + 1e-9)[:, None]))
                taken = batch.select([0, 1]).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(order[row, place].astype(np.int32))], ["query_id", "embedding", "list_id"])

        probes = written(state.mapInArrow(visits, f"query_id {kinds[0]}, embedding {kinds[1]}, list_id int"), "probes")
        count = probes.count()
        if log is not None:
            log.append(count)
        if not count:
            break
        more = _search_probed(probes, docs, k, metric, limits)
        hits = written(best_per_query(more if hits is None else more.unionByName(hits.drop("rank")), k), "nearest")
        worst = hits.filter(F.col("rank") == k).select("query_id", F.col("cost").alias("worst"))
        state = own.join(worst, "query_id", "left").select("query_id", "embedding", F.coalesce("worst", F.lit(float("inf"))).alias("worst"))
        done, n = done + n, n * growth
    if hits is None:
        hits = best_per_query(_search_probed(probes, docs, k, metric, limits), k)
    return dense.as_hits(hits, metric, score)


def train_hashes(docs: DataFrame, bucket_length: float, n_tables: int,
                 seed: int = 42) -> BucketedRandomProjectionLSHModel:
    vectors = docs.select(array_to_vector("embedding").alias("features"))
    return BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", seed=seed,
                                       bucketLength=bucket_length, numHashTables=n_tables).fit(vectors)


def hash_cells(df: DataFrame, model: BucketedRandomProjectionLSHModel) -> DataFrame:
    """One row per hash table, with the cell (table, bucket)."""
    hashed = model.transform(df.withColumn("features", array_to_vector("embedding")))
    buckets = hashed.select(*df.columns, F.posexplode("hashes").alias("table", "bucket"))
    cell = F.xxhash64("table", vector_to_array("bucket").getItem(0))
    return buckets.select(*df.columns, cell.alias("cell"))


def search_hashes(queries: DataFrame, docs: DataFrame, model: BucketedRandomProjectionLSHModel, k: int,
                  metric: str = "l2", score: str = "inverse",
                  limits: BlockLimits = BlockLimits()) -> DataFrame:
    """Top-k among the documents that share a bucket with the query in some hash table."""
    asked = written(hash_cells(queries.select("query_id", "embedding"), model), "query-cells")
    stored = hash_cells(docs.select("doc_id", "embedding"), model)
    return dense.as_hits(_search_tables(asked, stored, model.getNumHashTables(), k, metric, limits), metric, score)


def _search_tables(asked: DataFrame, stored: DataFrame, n_tables: int, k: int, metric: str, limits: BlockLimits) -> DataFrame:
    # Documents in cells without a query are dropped before anything is shuffled.
    met = join_keys(stored, asked.select("cell").distinct(), "cell", "left_semi")
    hits = cell_topk(asked, met, dense.VectorKernel(metric, limits.matrix_cells), k, _payload(), limits)
    # A document may be met in every table: first the k * tables best rows, a partial limit before the only shuffle, then one row each.
    first = best_per_query(hits, k * n_tables).drop("rank")
    return best_per_query(first.dropDuplicates(["query_id", "doc_id"]), k)


@dataclass(frozen=True)
class Projections:
    """Projections onto vectors of signs, several for each table; a bucket is ``width`` wide.

    A component x counts as floor(``scale`` * x), so buckets are exact whole numbers that any engine can repeat. Sums must stay below 2 ** 53;
    vectors beyond that, and those with components that are not finite, have no cell.
    """

    signs: np.ndarray  # tables x projections x dimension
    width: int
    scale: int = 4096


def sign_projections(dimension: int, n_tables: int, n_projections: int, width: int) -> Projections:
    """The sign of a component is + where the md5 of ``table,projection,component`` (from 0) starts with a hexadecimal digit below 8."""
    def sign(*place: int) -> int:
        return 1 if hashlib.md5(",".join(map(str, place)).encode()).hexdigest()[0] < "8" else -1

    signs = [[[sign(t, p, d) for d in range(dimension)] for p in range(n_projections)] for t in range(n_tables)]
    return Projections(np.array(signs), width)


def probe_cells(df: DataFrame, given: Projections, n_probe: int = 1) -> DataFrame:
    """One row for each table and probe, with the ``cell``: the own bucket and, for ``n_probe`` above 1, the nearest ones around it.

    A neighbour differs by -1, 0 or 1 in each projection; its distance is the sum of the squared distances to the borders that are crossed.
    Ties go to the smaller steps, first projection first.
    """
    n_tables, n_projections, dimension = given.signs.shape
    steps = np.array(list(product((-1, 0, 1), repeat=n_projections)))
    if not 1 <= n_probe <= len(steps):
        raise ValueError(f"between 1 and {len(steps)} probes are possible, not {n_probe}")
    planes, as_matrix = given.signs.reshape(-1, dimension).T.astype(np.float64), dense.vector_matrix
    schema = T.StructType([*df.schema.fields, T.StructField("__table", T.IntegerType()), T.StructField("__bucket", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = np.floor(as_matrix(batch.column(batch.schema.get_field_index("embedding"))) * given.scale)
            taken = np.flatnonzero(np.abs(whole).sum(1) < 2.0 ** 53)
            place = (whole[taken] @ planes).astype(np.int64).reshape(len(taken), n_tables, 1, n_projections)
            bucket = place // given.width
            left = place - bucket * given.width
            if n_probe > 1:
                cost = np.where(steps < 0, left ** 2, np.where(steps > 0, (given.width - left) ** 2, 0)).sum(3)
                bucket = bucket + steps[np.argsort(cost, axis=2, kind="stable")[:, :, :n_probe]]
            repeated = batch.take(pa.array(np.repeat(taken, n_tables * n_probe)))
            tables = np.tile(np.repeat(np.arange(n_tables, dtype=np.int32), n_probe), len(taken))
            flat = bucket.reshape(-1)
            buckets = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, n_projections, dtype=np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*repeated.columns, pa.array(tables), buckets], names=[*repeated.schema.names, "__table", "__bucket"])

    found = df.filter(F.col("embedding").isNotNull()).mapInArrow(run, schema)
    return found.select(*df.columns, F.xxhash64("__table", "__bucket").alias("cell"))


def search_probes(queries: DataFrame, docs: DataFrame, given: Projections, k: int, n_probe: int, metric: str = "l2", score: str = "inverse",
                  limits: BlockLimits = BlockLimits()) -> DataFrame:
    """Top-k among the documents whose bucket is one of the ``n_probe`` that a query probes in each table."""
    asked = written(probe_cells(queries.select("query_id", "embedding"), given, n_probe), "query-cells")
    stored = probe_cells(docs.select("doc_id", "embedding"), given)
    return dense.as_hits(_search_tables(asked, stored, len(given.signs), k, metric, limits), metric, score)
