"""Pairwise reranking of candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from corpusloom.functions import hooks, text
from corpusloom.operators.sparse import SparseIndex


def cut(candidates: DataFrame, top_k: int) -> DataFrame:
    return candidates.filter(F.col("rank") <= top_k)


def rerank_by(scored: DataFrame, top_k: int) -> DataFrame:
    """Order ``query_id, rank, pair_score, ...`` by the pair score, ties by the earlier rank."""
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("pair_score"), "rank")
    return (scored.withColumn("new_rank", F.row_number().over(order).cast("bigint"))
            .filter(F.col("new_rank") <= top_k)
            .drop("rank", "score")
            .withColumnsRenamed({"new_rank": "rank", "pair_score": "score"}))


def rerank(candidates: DataFrame, top_k: int, scorer=None) -> DataFrame:
    """Rerank candidates that carry ``query`` and ``content`` with a pair scorer hook, and cut.

    Without a scorer the candidates are only cut.
    """
    if scorer is None:
        return cut(candidates, top_k)
    return rerank_by(hooks.score_pairs(candidates, scorer, out="pair_score"), top_k)


def query_idf(queries: DataFrame, index: SparseIndex) -> DataFrame:
    """``query_id, idf``: the distinct query tokens known to the corpus with their idf, as a map."""
    distinct = queries.select("query_id", F.explode(F.array_distinct(text.tokens(F.col("query")))).alias("token"))
    known = distinct.join(index.term_stats(), "token")
    return known.groupBy("query_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("token", "idf")))).alias("idf"))


def lexical_scores(candidates: DataFrame, weights: DataFrame) -> DataFrame:
    """Stand-in pair score: idf-weighted share of the query tokens found in the document."""
    idf = F.col("idf")
    found = F.array_intersect(F.map_keys(idf), text.tokens(F.col("content")))
    total = F.aggregate(F.map_values(idf), F.lit(0.0), lambda a, v: a + v)
    matched = F.aggregate(F.array_sort(found), F.lit(0.0), lambda a, t: a + idf[t])
    share = F.coalesce(F.try_divide(matched, total), F.lit(0.0))
    return candidates.join(weights, "query_id", "left").withColumn("pair_score", F.round(share, 6)).drop("idf")


def rerank_lexical(candidates: DataFrame, queries: DataFrame, index: SparseIndex, top_k: int) -> DataFrame:
    return rerank_by(lexical_scores(candidates, query_idf(queries, index)), top_k)
