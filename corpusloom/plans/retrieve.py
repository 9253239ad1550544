"""The retrieval job: gather candidates, fuse, rerank, cut."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.functions import text
from corpusloom.operators import dense, fusion, rerank, sparse
from corpusloom.schemas import BlockLimits, RetrievalParams
from corpusloom.session import join_keys, spread, written


@dataclass(frozen=True)
class Corpus:
    """What is searched.

    ``documents``: ``doc_id, content, metadata``. Read once per job, for the texts of the candidates.
    ``vectors``: ``doc_id, embedding``, with ``metadata`` when searches are filtered.
    ``secondary``: a second table of vectors over the same documents, or none.
    ``keywords``: a BM25 index, or none.
    """

    documents: DataFrame
    vectors: DataFrame
    secondary: DataFrame | None = None
    keywords: sparse.SparseIndex | None = None

    @property
    def hybrid(self) -> bool:
        return self.secondary is not None or self.keywords is not None


def attach_documents(hits: DataFrame, documents: DataFrame, columns: list[str]) -> DataFrame:
    """Columns of the hit documents, taken from one scan of the document table.

    The table of hit ids is counted; when it is small the documents are not shuffled.
    """
    ids = written(hits.select("doc_id").distinct(), "hit-ids")
    found = join_keys(documents.select("doc_id", *columns), ids, "doc_id", "left_semi")
    return written(found, "hit-documents")


def candidates(queries: DataFrame, corpus: Corpus, params: RetrievalParams, keep: Callable[[Column], Column] | None = None,
               k: int | None = None, limits: BlockLimits = BlockLimits()) -> tuple[DataFrame, int]:
    """Hits of every active source with ``list_idx``, and the number of lists.

    The filter is a condition on the metadata map. It applies to vector search; keyword search follows it only when asked to.
    """
    k = k or params.candidate_k

    def allowed(table: DataFrame) -> DataFrame:
        return table if keep is None else table.filter(keep(F.col("metadata")))

    lists = [dense.search(queries, allowed(corpus.vectors), k, params.metric, params.score, limits)]
    if corpus.secondary is not None:
        second = allowed(corpus.secondary)
        lists.append(dense.search(queries, second, k, params.secondary_metric, "identity", limits))
    if corpus.keywords is not None:
        only = keep if params.bm25_respects_filter else None
        lists.append(sparse.search(queries, corpus.keywords, k, only, limits))
    return fusion.union_lists(lists), len(lists)


def retrieve(queries: DataFrame, corpus: Corpus, params: RetrievalParams = RetrievalParams(),
             scorer=None, lexical: bool = False, keep: Callable[[Column], Column] | None = None,
             limits: BlockLimits = BlockLimits()) -> DataFrame:
    """Final hits of ``query_id, query, embedding``: ``query_id, rank, doc_id, score, distance, content,
    metadata``.

    Without a second source and without reranking this is a vector search cut at the threshold.
    ``scorer`` is a pair scorer hook; ``lexical`` uses the stand-in that needs the keyword index.
    """
    reranking = scorer is not None or lexical
    hybrid = corpus.hybrid
    k = params.candidate_k if hybrid or reranking else params.top_k
    found, n_lists = candidates(queries, corpus, params, keep, k, limits)
    # The searches run once; their result is read for the ids, the fusion and the final join.
    found = written(found, "candidates")
    texts = attach_documents(found, corpus.documents, ["content", "metadata"])
    keyed = found.join(texts.select("doc_id", text.content_key(F.col("content")).alias("content_key")), "doc_id")
    fused = fusion.fuse_or_pass(keyed, n_lists, params.rrf_k)
    if not hybrid and not reranking:
        final = dense.above_threshold(fused, params.threshold)
    elif not reranking:
        final = rerank.cut(fused, params.top_k)
    else:
        pairs = (spread(fused, found.count(), "query_id", "doc_id").join(texts.select("doc_id", "content"), "doc_id")
                 .join(queries.select("query_id", "query"), "query_id"))
        final = (rerank.rerank_lexical(pairs, queries, corpus.keywords, params.top_k) if lexical
                 else rerank.rerank(pairs, params.top_k, scorer)).drop("content", "query")
    return final.join(texts, "doc_id").select(
        "query_id", "rank", "doc_id", "score", "distance", "content", "metadata")
