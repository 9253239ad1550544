"""BM25 keyword search over an inverted index in document parts.

A *part* holds a bounded number of documents, dealt without regard to their ids. Its rows are one list of postings for each token
(documents by their number in the part, and counts) and a directory: ids, lengths and metadata of its documents. Files are sorted by token, so a search reads
the row groups of the tokens that are asked for. Lists are cut into ranges of documents, the same for all tokens. In a part, a
query's ranges come in the order of the largest score that their documents can reach (the sum of each token's largest share in the range); once that is
below the running k-th score, all other ranges are passed over. Scores are exact.

Statistics are an aggregation over tokens. Changes of the collection add parts, mark documents of earlier ones as gone, and add signed counts to the statistics.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from corpusloom.functions import text
from corpusloom.operators.block_topk import BestK, Kernel, best_per_query, hit_schema, hit_table, id_array, paired_topk
from corpusloom.schemas import BlockLimits
from corpusloom.session import join_keys, written

# The usual BM25 parameters.
K1 = 1.5
B = 0.75
EPSILON = 0.25

# Documents of a part, their text (a task holds the terms of a part, several times the text), and documents of a range; parts below the first size that still use all cores.
PART_DOCS = 16_384
PART_BYTES = 8 << 20
SMALL_PART = 512
RANGE = 128
# Distinct tokens that a search hands to the scan as a list.
LISTED_TOKENS = 2_000
#: Token of a part's directory; no text holds it.
DIRECTORY = ""


def term_vectors(docs: DataFrame) -> DataFrame:
    """``doc_id, dl, terms, tfs``, and other columns: distinct tokens of each document in order, with their counts. A null text has none.

    Counts are the lengths of runs in the sorted token array, so no aggregation is needed.
    """
    more = [c for c in docs.columns if c not in ("doc_id", "content")]
    sorted_tokens = docs.select("doc_id", *more, F.sort_array(text.tokens(F.coalesce("content", F.lit("")))).alias("tokens"))
    tokens = F.col("tokens")
    runs = sorted_tokens.select(
        "doc_id", *more, F.size(tokens).alias("dl"), F.array_distinct(tokens).alias("terms"), "tokens",
        F.filter(F.transform(tokens, lambda t, i: F.when(
            (i == 0) | (t != F.get(tokens, i - 1)), i)), lambda i: i.isNotNull()).alias("starts"))
    ends = F.concat(F.slice("starts", 2, F.greatest(F.size("starts"), F.lit(1))), F.array("dl"))
    tfs = F.when(F.col("dl") > 0, F.zip_with("starts", ends, lambda s, e: e - s)).otherwise(
        F.array().cast("array<int>"))
    return runs.select("doc_id", "dl", "terms", tfs.alias("tfs"), *more)


def _postings(docs: DataFrame, first_part: int) -> tuple[DataFrame, int]:
    """Rows of new parts from ``first_part`` on (``part, token, df, docs, tfs, ids, metadata``), and the number of parts after them."""
    docs = docs.select("doc_id", "content", *["metadata"] * ("metadata" in docs.columns))
    n_docs, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("content").cast("bigint")), F.lit(0))).first()
    cores = docs.sparkSession.sparkContext.defaultParallelism
    n_parts = max(1, -(-n_docs // PART_DOCS), -(-size // PART_BYTES), min(2 * cores, -(-n_docs // SMALL_PART)))
    part = F.pmod(F.monotonically_increasing_id(), F.lit(n_parts)) + first_part
    vectors = term_vectors(docs.withColumn("part", part))
    ids = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("part", T.LongType()), T.StructField("token", T.StringType()), T.StructField("df", T.IntegerType()),
                           T.StructField("docs", T.ArrayType(T.IntegerType())), T.StructField("tfs", T.ArrayType(T.IntegerType())), T.StructField("ids", T.ArrayType(ids))])
    if "metadata" in docs.columns:
        schema.add("metadata", T.ArrayType(docs.schema["metadata"].dataType))
    rows = vectors.groupBy("part").applyInArrow(_inverted, schema)
    return written(rows.sortWithinPartitions("token"), "postings"), first_part + n_parts


def _inverted(table: pa.Table) -> pa.Table:
    """Term vectors of one part as its directory and a row for each token. Documents are numbered in the order of their ids."""
    table = table.take(pc.sort_indices(table.column("doc_id"))).combine_chunks()
    terms = table.column("terms").combine_chunks()
    lengths = pc.list_value_length(terms).to_numpy()
    coded = terms.flatten().dictionary_encode()
    by_token = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(by_token), np.int64)
    rank[by_token] = np.arange(len(by_token))
    token = rank[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64)
    order = np.argsort(token, kind="stable")
    doc = np.repeat(np.arange(len(terms), dtype=np.int32), lengths)[order]
    counts = np.bincount(token, minlength=len(by_token))
    n_docs = table.num_rows
    # The directory is a first list: its counts are the lengths of the documents.
    ends = np.concatenate([[0, n_docs], n_docs + np.cumsum(counts)]).astype(np.int32)
    tfs = np.concatenate([table.column("dl").to_numpy(), table.column("tfs").combine_chunks().flatten().to_numpy()[order]]).astype(np.int32)

    def first_only(values: pa.Array) -> pa.Array:
        offsets = np.concatenate([[0], np.full(len(counts) + 1, n_docs)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), values, mask=pa.array(np.arange(len(counts) + 1) > 0))

    columns = {
        "part": pa.array(np.full(len(counts) + 1, table.column("part")[0].as_py())),
        "token": pa.concat_arrays([pa.array([DIRECTORY]), coded.dictionary.take(pa.array(by_token)).cast(pa.string())]),
        "df": pa.array(np.concatenate([[n_docs], counts]).astype(np.int32)),
        "docs": pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.arange(n_docs, dtype=np.int32), doc]))),
        "tfs": pa.ListArray.from_arrays(pa.array(ends), pa.array(tfs)),
        "ids": first_only(table.column("doc_id").combine_chunks())}
    if "metadata" in table.column_names:
        columns["metadata"] = first_only(table.column("metadata").combine_chunks())
    return pa.table(columns)


def _frequencies(postings: DataFrame) -> DataFrame:
    return postings.filter(F.col("token") != DIRECTORY).groupBy("token").agg(F.sum("df").alias("df"))


def _totals(postings: DataFrame) -> tuple[int, int]:
    """Documents and tokens."""
    length = F.aggregate("tfs", F.lit(0).cast("long"), lambda n, x: n + x)
    sums = postings.filter(F.col("token") == DIRECTORY).agg(F.sum("df"), F.sum(length)).first()
    return sums[0] or 0, sums[1] or 0


def raw_idf(df: Column, n_docs: int) -> Column:
    return F.log(F.lit(float(n_docs)) - df + 0.5) - F.log(df + 0.5)


@dataclass(frozen=True)
class SparseIndex:
    """Postings in parts, document frequencies and the corpus constants."""

    postings: DataFrame     # part, token, df, docs, tfs, ids, metadata; gone: documents of a part that are no more
    frequencies: DataFrame  # token, df
    n_parts: int
    n_docs: int
    n_tokens: int
    avg_idf: float          # over all tokens, before negative values are replaced

    @property
    def avgdl(self) -> float:
        return self.n_tokens / max(self.n_docs, 1)

    def term_stats(self) -> DataFrame:
        """``token, df, idf``: a negative idf becomes a quarter of the average one."""
        idf = raw_idf(F.col("df"), self.n_docs)
        return self.frequencies.select(
            "token", "df", F.when(idf < 0, F.lit(EPSILON * self.avg_idf)).otherwise(idf).alias("idf"))

    def save(self, path: str) -> None:
        spark = self.postings.sparkSession
        self.postings.sortWithinPartitions("token").write.parquet(f"{path}/postings")
        self.frequencies.write.parquet(f"{path}/frequencies")
        constants = spark.createDataFrame([(self.n_parts, self.n_docs, self.n_tokens, self.avg_idf)],
                                          "n_parts long, n_docs long, n_tokens long, avg_idf double")
        constants.coalesce(1).write.parquet(f"{path}/constants")

    @staticmethod
    def load(spark: SparkSession, path: str) -> SparseIndex:
        constants = spark.read.parquet(f"{path}/constants").first()
        return SparseIndex(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/frequencies"), *constants)


def _index(postings: DataFrame, frequencies: DataFrame, n_parts: int, n_docs: int, n_tokens: int) -> SparseIndex:
    average = frequencies.agg(F.avg(raw_idf(F.col("df"), n_docs))).first()[0]
    return SparseIndex(postings, frequencies, n_parts, n_docs, n_tokens, average or 0.0)


def build_index(docs: DataFrame) -> SparseIndex:
    """Index ``doc_id, content``, and ``metadata`` when it is there. The texts are read once; statistics are added up from the postings."""
    postings, n_parts = _postings(docs, 0)
    return _index(postings, written(_frequencies(postings), "document-frequencies"), n_parts, *_totals(postings))


def update_index(index: SparseIndex, removed: DataFrame, added: DataFrame) -> SparseIndex:
    """The index after a change of the collection: ``removed`` and ``added`` rows (``doc_id, content``, ``metadata``); a replaced document is in both.

    ``removed`` has the indexed content. Only the changed documents are tokenised: their counts go into the statistics with a sign, the added ones become parts of their own, and the
    removed ones are marked in the parts that hold their ids. A rebuilt index gives the same scores.
    """
    new, n_parts = _postings(added, index.n_parts)
    gone = written(removed.select("doc_id").distinct(), "removed-ids")
    directory = index.postings.filter(F.col("token") == DIRECTORY).filter(F.col("ids").isNotNull())
    places = directory.select("part", F.posexplode("ids").alias("place", "doc_id"))
    # At most as many numbers as a part has documents.
    marked = join_keys(places, gone, "doc_id", "left_semi").groupBy("part").agg(F.collect_list("place").alias("gone"))
    marked = written(marked.select("part", F.lit(DIRECTORY).alias("token"), "gone"), "removed-places")
    terms = term_vectors(removed.select("doc_id", "content"))
    less = terms.select(F.explode("terms").alias("token")).groupBy("token").agg((-F.count("*")).alias("df"))
    both = index.frequencies.unionByName(_frequencies(new)).unionByName(less)
    frequencies = written(both.groupBy("token").agg(F.sum("df").alias("df")).filter("df > 0"), "document-frequencies")
    n_gone, tokens_gone = terms.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
    n_new, tokens_new = _totals(new)
    postings = index.postings.unionByName(new, allowMissingColumns=True).unionByName(marked, allowMissingColumns=True)
    return _index(postings, frequencies, n_parts, index.n_docs + n_new - n_gone, index.n_tokens + tokens_new - tokens_gone)


def query_vectors(queries: DataFrame, index: SparseIndex) -> DataFrame:
    """``query_id, terms, weights``: a repeated token weighs as often as it occurs; unknown ones drop out."""
    counted = (queries.select("query_id", F.explode(text.tokens(F.col("query"))).alias("token"))
               .groupBy("query_id", "token").agg(F.count("*").alias("qtf")))
    # Written, so that Catalyst sees how small the table is and does not shuffle the vocabulary.
    weighted = written(counted, "query-tokens").join(index.term_stats(), "token").select(
        "query_id", F.struct("token", (F.col("qtf") * F.col("idf") * (K1 + 1)).alias("weight")).alias("term"))
    return weighted.groupBy("query_id").agg(F.sort_array(F.collect_list("term")).alias("t")).select(
        "query_id", F.col("t.token").alias("terms"), F.col("t.weight").alias("weights"))


class TermKernel(Kernel):
    """BM25 scores of queries over one part, negated and rounded to six decimals; scores of zero or less are excluded."""

    # Ranges that are scored between two looks at the k-th score.
    STEP = 8

    def __init__(self, avgdl: float):
        self.avgdl = avgdl
        self.n_read = self.n_skipped = 0

    def hold(self, docs: list[pa.RecordBatch]) -> None:
        table = pa.Table.from_batches(docs)
        own = np.array(table.column("token").to_pylist(), object) == DIRECTORY
        first = [r for r in table.filter(pa.array(own)).select([n for n in table.column_names if n in ("ids", "tfs", "allowed", "gone")]).to_pylist()]
        entry = next((r for r in first if r.get("ids") is not None), None)
        self.ids = id_array(pa.array(entry["ids"])) if entry and entry["ids"] else np.zeros(0, np.int64)
        length = np.array(entry["tfs"], np.float64) if entry else np.zeros(0)
        self.norm = K1 * (1 - B + B * length / self.avgdl) if self.avgdl else length
        self.allowed = np.ones(len(self.ids), bool)
        if entry and entry.get("allowed") is not None:
            self.allowed &= np.array([bool(x) for x in entry["allowed"]], bool)
        for r in first:
            if r.get("gone"):
                self.allowed[np.array(r["gone"])] = False
        lists = table.filter(pa.array(~own)).combine_chunks()
        self.vocabulary = lists.column("token").combine_chunks() if lists.num_rows else pa.array([], pa.string())
        self.n_ranges = -(-len(self.ids) // RANGE)
        if not lists.num_rows:
            return
        docs_of = lists.column("docs").combine_chunks()
        counts = pc.list_value_length(docs_of).to_numpy()
        self.docs, tf = docs_of.flatten().to_numpy(), lists.column("tfs").combine_chunks().flatten().to_numpy().astype(np.float64)
        self.share = tf / (tf + self.norm[self.docs])
        # A cell holds the postings of one token in one range: token, range, first posting, postings, largest share.
        token = np.repeat(np.arange(len(counts)), counts)
        cell = token * self.n_ranges + self.docs // RANGE
        self.first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        self.count = np.diff(np.append(self.first, len(cell)))
        self.range = self.docs[self.first] // RANGE
        self.most = np.maximum.reduceat(self.share, self.first)
        self.cells = np.searchsorted(token[self.first], np.arange(len(counts) + 1))

    def best(self, queries: pa.Table, k: int) -> BestK:
        best = BestK(queries.num_rows, k)
        terms = queries.column("terms").combine_chunks()
        ends = np.cumsum([0, *pc.list_value_length(terms).to_pylist()])
        known = pc.index_in(terms.flatten(), value_set=self.vocabulary).fill_null(-1).to_numpy() if len(self.vocabulary) else np.full(ends[-1], -1)
        weights = queries.column("weights").combine_chunks().flatten().to_numpy()
        for q in range(queries.num_rows):
            own = slice(int(ends[q]), int(ends[q + 1]))
            there = known[own] >= 0
            if there.any():
                score, doc = self._top(known[own][there], weights[own][there], k)
                best.take(q, self.ids[doc], -score)
        return best

    @staticmethod
    def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """start, start + 1, ... for every count."""
        return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))

    def _top(self, tokens: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores and numbers of the best k documents of one query."""
        n_cells = self.cells[tokens + 1] - self.cells[tokens]
        cells, weight = self._spread(self.cells[tokens], n_cells), np.repeat(weights, n_cells)
        range_of = self.range[cells]
        bound = np.bincount(range_of, np.maximum(weight, 0.0) * self.most[cells], self.n_ranges)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        place = np.full(self.n_ranges, -1)
        score, doc, bar = np.zeros(0), np.zeros(0, np.int64), 0.0
        for at in range(0, len(order), self.STEP):
            # Scores are rounded: a range may still give one that is rounded up to the bar.
            ranges = order[at:at + self.STEP]
            ranges = ranges[bound[ranges] >= bar - 1e-6]
            if not len(ranges):
                self.n_skipped += int(np.isin(range_of, order[at:]).sum())
                break
            place[:] = -1
            place[ranges] = np.arange(len(ranges))
            used = place[range_of] >= 0
            own = cells[used]
            self.n_read += len(own)
            at_posting = self._spread(self.first[own], self.count[own])
            found = self.docs[at_posting]
            total = np.bincount(place[found // RANGE] * RANGE + found % RANGE, np.repeat(weight[used], self.count[own]) * self.share[at_posting], len(ranges) * RANGE)
            total = np.round(total, 6)
            hit = np.flatnonzero(total > 0)
            found = ranges[hit // RANGE] * RANGE + hit % RANGE
            keep = self.allowed[found]
            score, doc = np.concatenate([score, total[hit[keep]]]), np.concatenate([doc, found[keep]])
            top = np.lexsort((doc, -score))[:k]
            score, doc = score[top], doc[top]
            bar = score[-1] if len(score) == k else 0.0
        return score, doc


def search(queries: DataFrame, index: SparseIndex, k: int, keep: Callable[[Column], Column] | None = None,
           limits: BlockLimits = BlockLimits()) -> DataFrame:
    """BM25 top-k of ``query_id, query``: ``query_id, doc_id, rank, score, distance``.

    Ties go to the smaller id. ``keep``, a condition on a metadata map, restricts the candidates, but never
    the statistics; by default keyword search ignores metadata filters. It is evaluated in the parts' directories, beside the postings.
    """
    weighted = written(query_vectors(queries, index), "query-vectors")
    asked = written(weighted.select(F.explode("terms").alias("token")).distinct(), "asked-tokens")
    if asked.count() <= LISTED_TOKENS:
        rows = index.postings.filter(F.col("token").isin([DIRECTORY, *(r.token for r in asked.collect())]))
    else:
        nothing = queries.sparkSession.createDataFrame([(DIRECTORY,)], "token string")
        rows = join_keys(index.postings, asked.unionByName(nothing), "token", "left_semi")
    if keep is not None:
        if "metadata" not in rows.columns:
            raise ValueError("the index has no metadata to filter by")
        rows = rows.withColumn("allowed", F.transform("metadata", keep))
    rows = rows.drop("metadata", "df")
    kernel = TermKernel(index.avgdl)
    size = F.aggregate("terms", F.lit(0).cast("long"), lambda total, term: total + F.octet_length(term) + 24)
    if weighted.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0] <= limits.broadcast_bytes:
        shared = queries.sparkSession.sparkContext.broadcast(weighted.toArrow())

        def in_part(table: pa.Table) -> pa.Table:
            kernel.hold(table.combine_chunks().to_batches())
            asked = shared.value.combine_chunks()
            return hit_table(kernel.best(asked, k), asked.column("query_id").combine_chunks(), table.schema.field("ids").type.value_type)

        hits = rows.groupBy("part").applyInArrow(in_part, hit_schema(weighted, rows))
    else:
        hits = paired_topk(weighted, rows, index.n_parts, kernel, k, limits)
    return best_per_query(hits, k).select("query_id", "doc_id", "rank", (F.lit(0.0) - F.col("cost")).alias("score"),
                                          F.lit(None).cast("double").alias("distance"))
