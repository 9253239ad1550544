"""Reciprocal rank fusion of ranked lists, one long table with a list number and a rank."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

# Fixed value: the usual constant of reciprocal rank fusion.
RRF_K = 60


def union_lists(lists: list[DataFrame]) -> DataFrame:
    """Ranked lists in their order of precedence, as one table with ``list_idx``."""
    numbered = [hits.withColumn("list_idx", F.lit(i)) for i, hits in enumerate(lists)]
    return reduce(DataFrame.unionByName, numbered)


def rrf_score(seen: Column, k: int) -> Column:
    """Sum of 1/(k + rank) in the order of the sorted (list, rank) pairs, so that it is repeatable."""
    return F.aggregate(seen, F.lit(0.0), lambda total, pair: total + F.lit(1.0) / (k + pair["rank"]))


def fuse(hits: DataFrame, k: int = RRF_K) -> DataFrame:
    """Fuse ``query_id, list_idx, rank, doc_id, content_key, distance`` into one list per query.

    Hits of equal content are one result: each adds its share of the score, and the first one in
    (list, rank) order stands for them. Ties keep that order too. The groups are small: a query has
    at most candidates x lists hits.
    """
    place = F.struct("list_idx", "rank")
    merged = hits.groupBy("query_id", "content_key").agg(
        F.sort_array(F.collect_list(place)).alias("seen"),
        F.min_by(F.struct("doc_id", "distance"), place).alias("first"))
    scored = merged.select("query_id", "content_key", F.col("first.doc_id").alias("doc_id"),
                           F.col("first.distance").alias("distance"), rrf_score(F.col("seen"), k).alias("score"),
                           F.col("seen")[0].alias("place"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "place.list_idx", "place.rank")
    return scored.select("query_id", "doc_id", "content_key",
                         F.row_number().over(order).cast("bigint").alias("rank"), "score", "distance")


def fuse_or_pass(hits: DataFrame, n_lists: int, k: int = RRF_K) -> DataFrame:
    """A single list passes through unchanged: raw scores, no merging of equal contents."""
    if n_lists == 1:
        return hits.select("query_id", "doc_id", "content_key", "rank", "score", "distance")
    return fuse(hits, k)
