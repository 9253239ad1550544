"""Every operator as a query over the given tables: name -> (spark, folder) -> DataFrame."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusloom.functions import filters, hooks, text
from corpusloom.operators import ann, chat, context, dense, evaluate, fusion, mutate, sparse
from corpusloom.plans import evaluation, workflow
from corpusloom.plans.retrieve import Corpus, attach_documents, retrieve
from corpusloom.schemas import BlockLimits, ModelSpec, RetrievalParams
from corpusloom.session import new_folder, spread, written
from corpusloom.sources import collection, tables
from corpusloom.streaming import jobs

TOP_K = 10
MULTIPROBE = {"n_tables": 8, "n_projections": 3, "width": 4096}
N_PROBES = 13
N_BUCKETS = 8
KEYWORD_K = 20
EMBED = hooks.hashed_tokens(64)
PARAMS = RetrievalParams(top_k=5)
# Blocks of queries far smaller than a real job would use.
SMALL_BLOCKS = BlockLimits(broadcast_bytes=96 << 10, doc_rows=200, query_rows=30)
SYSTEM_PROMPT = "Answer from the retrieved information only."
CONTEXT_TOKENS = 200


# --- tables -------------------------------------------------------------------------------------

def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return tables.documents(tables.read_spread(spark, f"{sf}/documents.parquet", "doc_id"), metadata=["lang", "source"])


def _questions(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/benchmark.parquet").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """All vectors as queries and as documents."""
    vectors = tables.read_spread(spark, f"{sf}/embeddings.parquet", "vec_id")
    return (vectors.select(F.col("vec_id").alias("query_id"), "embedding"),
            vectors.select(F.col("vec_id").alias("doc_id"), "embedding", "label"))


def _messages(spark: SparkSession, sf: str) -> DataFrame:
    return tables.messages(tables.read_spread(spark, f"{sf}/conversations.parquet", "conv_id"))


def _labels(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/labels.parquet")


def _second_batch(spark: SparkSession, sf: str) -> DataFrame:
    """A batch of changes: new texts for the documents of low quality, and toxic ones under new ids."""
    both = _documents(spark, sf).join(_labels(spark, sf), "doc_id")
    changed = both.filter("quality = 0").select("doc_id", F.concat(F.lit("changed: "), "content").alias("content"), "metadata")
    added = both.filter("toxic = 1").select((F.col("doc_id") + 10_000_000).alias("doc_id"), "content", "metadata")
    return changed.unionByName(added)


def _keys(df: DataFrame) -> DataFrame:
    return df.select("doc_id", text.content_key(F.col("content")).alias("content_key"))


# --- vector search ------------------------------------------------------------------------------

def _knn(metric: str, score: str, limits: BlockLimits = BlockLimits()):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        queries, docs = _vectors(spark, sf)
        return _rounded(dense.search(queries, docs, TOP_K, metric, score, limits))

    return query


def _rounded(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"), "distance")


def knn_prefilter(spark: SparkSession, sf: str) -> DataFrame:
    queries, docs = _vectors(spark, sf)
    keep = filters.equals_all({"label": 3}, filters.column_lookup({"label": "label"}))
    return _rounded(dense.search_filtered(queries, docs, keep, TOP_K, "pre"))


def knn_postfilter(spark: SparkSession, sf: str) -> DataFrame:
    queries, docs = _vectors(spark, sf)
    keep = filters.equals_all_null_safe({"label": 3}, filters.column_lookup({"label": "label"}))
    return _rounded(dense.search_filtered(queries, docs, keep, TOP_K, "post"))


def knn_request_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Every query asks for documents of its own label."""
    vectors = tables.read_spread(spark, f"{sf}/embeddings.parquet", "vec_id")
    own = F.create_map(F.lit("label"), F.col("label").cast("string"))
    return _rounded(dense.search(vectors.select(F.col("vec_id").alias("query_id"), "embedding", own.alias("filter")),
                                 vectors.select(F.col("vec_id").alias("doc_id"), "embedding", own.alias("metadata")), TOP_K))


LABEL_FILTERS = ['{"label": {"$gte": 3, "$lt": 7}}', '{"$or": [{"label": 1}, {"label": {"$gt": 7.5}}]}', '{"label": {"$nin": [0, 2, "4"]}}']


def knn_filter_operators(spark: SparkSession, sf: str) -> DataFrame:
    """Each query has its own filter with operators, and a quarter of them none."""
    vectors = tables.read_spread(spark, f"{sf}/embeddings.parquet", "vec_id")
    own = F.get(F.lit(LABEL_FILTERS), (F.col("vec_id") % 4).cast("int"))
    return _rounded(dense.search(
        vectors.select(F.col("vec_id").alias("query_id"), "embedding", own.alias("filter")),
        vectors.select(F.col("vec_id").alias("doc_id"), "embedding", F.create_map(F.lit("label"), F.col("label").cast("string")).alias("metadata")), TOP_K))


def knn_own_filters(spark: SparkSession, sf: str) -> DataFrame:
    """Every query has a filter that no other one has."""
    vectors = tables.read_spread(spark, f"{sf}/embeddings.parquet", "vec_id")
    own = F.format_string('{"$or": [{"label": {"$gt": %d}}, {"id": {"$lt": %d}}], "id": {"$ne": %d}}', F.col("vec_id") % 7 + 2, F.col("vec_id"), F.col("vec_id"))
    known = F.create_map(F.lit("label"), F.col("label").cast("string"), F.lit("id"), F.col("vec_id").cast("string"))
    return _rounded(dense.search(vectors.select(F.col("vec_id").alias("query_id"), "embedding", own.alias("filter")),
                                 vectors.select(F.col("vec_id").alias("doc_id"), "embedding", known.alias("metadata")), TOP_K))


def knn_threshold(spark: SparkSession, sf: str) -> DataFrame:
    queries, docs = _vectors(spark, sf)
    return _rounded(dense.above_threshold(dense.search(queries, docs, TOP_K, "cosine", "identity"), 0.3))


def _tombstones(mode: str):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        queries, docs = _vectors(spark, sf)
        deleted = _labels(spark, sf).filter("toxic = 1")
        return _rounded(dense.search_without(queries, docs, deleted, TOP_K, mode))

    return query


def _ivf(n_lists: int | None, n_probe: int):
    """Inverted lists from k-means, or around the mean vectors of the labels."""
    def query(spark: SparkSession, sf: str) -> DataFrame:
        queries, docs = _vectors(spark, sf)
        lists = ann.train_lists(docs, n_lists) if n_lists else ann.mean_lists(docs, "label")
        stored = ann.store_lists(docs, lists, new_folder(spark, "lists"))
        return _rounded(ann.search_lists(queries, stored, lists, TOP_K, n_probe))

    return query


def knn_ivf(spark: SparkSession, sf: str) -> DataFrame:
    """Inverted lists, visited until no other list can hold a nearer vector."""
    queries, docs = _vectors(spark, sf)
    lists = ann.train_lists(docs, 16)
    return _rounded(ann.search_all_lists(queries, ann.store_lists(docs, lists, new_folder(spark, "lists")), lists, TOP_K))


def knn_lsh(spark: SparkSession, sf: str) -> DataFrame:
    queries, docs = _vectors(spark, sf)
    return _rounded(ann.search_hashes(queries, docs, ann.train_hashes(docs, 0.2, 4), TOP_K))


def knn_multiprobe(spark: SparkSession, sf: str) -> DataFrame:
    queries, docs = _vectors(spark, sf)
    return _rounded(ann.search_probes(queries, docs, ann.sign_projections(64, **MULTIPROBE), TOP_K, N_PROBES))


# --- filters ------------------------------------------------------------------------------------

EVENT_FILTER = {
    "$and": [{"k": {"$gte": 10}}, {"k": {"$lt": 90}}],
    "$or": [{"event_type": {"$in": ["click", "error"]}}, {"value": {"$gt": 15.0}}],
    "k": {"$nin": [13, 42], "$ne": 77},
    "value": {"$gt": 0.5},
}


def filter_operators(spark: SparkSession, sf: str) -> DataFrame:
    events = tables.read_spread(spark, f"{sf}/events.parquet", "event_id")
    keep = filters.translate_json(EVENT_FILTER, "props", {"event_type": "event_type", "value": "value"})
    number = filters.variant_lookup(F.try_parse_json("props"))("k", 0)
    return events.filter(keep).select("event_id", "event_type", "value", number.cast("bigint").alias("k"))


TYPED = {
    "int_as_double": {"n": {"$gt": 10}}, "in_mixed": {"n": {"$in": [10, "20", 30.5]}}, "text": {"s": {"$eq": "10"}},
    "no_text": {"s": {"$gt": 10}}, "flag": {"f": True}, "dotted": {"a.b": {"$lte": 5}}, "absent": {"zz": {"$ne": 1}},
}


def filter_typed(spark: SparkSession, sf: str) -> DataFrame:
    """Conditions of several types on JSON made of the events: numbers with and without a fraction, text, a flag, and a key with a dot."""
    events = tables.read_spread(spark, f"{sf}/events.parquet", "event_id")
    number = F.col("event_id") % 40
    made = F.concat(F.lit('{"n": '), F.when(F.col("event_id") % 3 == 0, F.concat(number.cast("string"), F.lit(".5")))
                    .when(F.col("event_id") % 3 == 1, number.cast("string")).otherwise(F.concat(F.lit('"'), number.cast("string"), F.lit('"'))),
                    F.lit(', "s": "'), number.cast("string"), F.lit('", "f": '), F.when(F.col("event_id") % 2 == 0, "true").otherwise('"true"'),
                    F.lit(', "a.b": '), (F.col("event_id") % 10).cast("string"), F.lit(', "a": {"b": 1}}'))
    look = filters.variant_lookup(F.col("doc"))
    return events.select("event_id", F.parse_json(made).alias("doc")).select(
        "event_id", *[F.coalesce(filters.translate(f, look), F.lit(False)).alias(name) for name, f in TYPED.items()])


def valid_input(spark: SparkSession, sf: str) -> DataFrame:
    """Requests made of document lines, many of them empty."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    valid = text.is_valid_input(F.col("line"))
    return lines.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), valid.alias("success"),
                        F.when(~valid, workflow.INVALID_INPUT).alias("error"))


# --- keyword search -----------------------------------------------------------------------------

def bm25_term_stats(spark: SparkSession, sf: str) -> DataFrame:
    stats = sparse.build_index(_documents(spark, sf)).term_stats()
    return stats.select("token", "df", F.round("idf", 6).alias("idf"))


def _bm25(limits: BlockLimits = BlockLimits()):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        index = sparse.build_index(_documents(spark, sf))
        return sparse.search(_questions(spark, sf), index, KEYWORD_K, limits=limits).drop("distance")

    return query


def bm25_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return sparse.search(_questions(spark, sf), sparse.build_index(_documents(spark, sf)), KEYWORD_K,
                         lambda metadata: filters.equals_all({"lang": "en"}, filters.map_lookup(metadata))).drop("distance")


def bm25_updated(spark: SparkSession, sf: str) -> DataFrame:
    """An index that follows an upsert of changed and added documents, and then a deletion of the toxic ones."""
    docs, batch = _documents(spark, sf), written(_second_batch(spark, sf), "batch")
    replaced = docs.join(batch.select("doc_id"), "doc_id", "left_semi")
    index = sparse.update_index(sparse.build_index(docs), replaced, batch)
    toxic = _labels(spark, sf).filter("toxic = 1").select("doc_id")
    current = docs.join(batch.select("doc_id"), "doc_id", "left_anti").unionByName(batch)
    index = sparse.update_index(index, current.join(toxic, "doc_id", "left_semi"), docs.limit(0))
    return sparse.search(_questions(spark, sf), index, KEYWORD_K).drop("distance")


# --- fusion, reranking, retrieval ---------------------------------------------------------------

def _embedded(docs: DataFrame) -> DataFrame:
    return written(hooks.embed_column(docs, EMBED).drop("content"), "vectors")


def _corpus(spark: SparkSession, sf: str, two_backends: bool = False, keywords: bool = True) -> Corpus:
    docs = _documents(spark, sf)
    vectors = _embedded(docs)
    return Corpus(docs, vectors, vectors if two_backends else None, sparse.build_index(docs) if keywords else None)


def _embedded_questions(spark: SparkSession, sf: str) -> DataFrame:
    return written(hooks.embed_column(_questions(spark, sf), EMBED, "query"), "questions")


def _flat_hits(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "rank", "doc_id", F.round("score", 9).alias("score"), "distance")


def rrf_fuse(spark: SparkSession, sf: str) -> DataFrame:
    """Two ranked lists per vector: its neighbours, and its neighbours of label 3, merged by the text
    of the documents with these ids."""
    queries, docs = _vectors(spark, sf)
    lists = [dense.search(queries, docs, TOP_K), dense.search(queries, docs.filter("label = 3"), TOP_K)]
    found = written(fusion.union_lists(lists), "candidates")
    texts = attach_documents(found, _documents(spark, sf), ["content"])
    keys = texts.select("doc_id", text.content_key(F.col("content")).alias("content_key"))
    return _flat_hits(fusion.fuse(found.join(keys, "doc_id")))


def dense_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Plain path: one vector source, cut at the threshold."""
    corpus = _corpus(spark, sf, keywords=False)
    params = RetrievalParams(top_k=5, threshold=-0.5)
    return _flat_hits(retrieve(_embedded_questions(spark, sf), corpus, params))


def hybrid_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _flat_hits(retrieve(_embedded_questions(spark, sf), _corpus(spark, sf), PARAMS))


def hybrid_two_backends(spark: SparkSession, sf: str) -> DataFrame:
    return _flat_hits(retrieve(_embedded_questions(spark, sf), _corpus(spark, sf, two_backends=True), PARAMS))


def hybrid_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """The filter holds for the vector source only; keyword hits may bring other documents back."""
    keep = lambda metadata: filters.equals_all({"lang": "de"}, filters.map_lookup(metadata))
    return _flat_hits(retrieve(_embedded_questions(spark, sf), _corpus(spark, sf), PARAMS, keep=keep))


def _reranked(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    questions = _embedded_questions(spark, sf)
    return questions, retrieve(questions, _corpus(spark, sf), PARAMS, lexical=True)


def rerank_lexical(spark: SparkSession, sf: str) -> DataFrame:
    return _flat_hits(_reranked(spark, sf)[1])


def token_overlap():
    """A pair scorer hook: number of distinct shared tokens."""
    def predict(queries: list[str], texts: list[str]) -> list[float]:
        return [float(len(set(q.lower().split()) & set(t.lower().split()))) for q, t in zip(queries, texts)]

    return predict


def rerank_hook(spark: SparkSession, sf: str) -> DataFrame:
    questions = _embedded_questions(spark, sf)
    return _flat_hits(retrieve(questions, _corpus(spark, sf), PARAMS, scorer=token_overlap))


def result_summary(spark: SparkSession, sf: str) -> DataFrame:
    questions, hits = _reranked(spark, sf)
    table = context.summary(questions.select("query_id"), hits, hybrid=True, reranked=True)
    each = table.select("query_id", "num_results", "hybrid", "reranked", F.posexplode_outer("results").alias("place", "hit"))
    return each.select("query_id", "num_results", "hybrid", "reranked", F.col("place").cast("bigint").alias("place"), F.round("hit.score", 6).alias("score"),
                       F.col("hit.content").alias("content"), F.col("hit.metadata")["lang"].alias("lang"))


# --- ingest and collection maintenance ----------------------------------------------------------

def ingest_lines(spark: SparkSession, sf: str) -> DataFrame:
    docs = tables.read_spread(spark, f"{sf}/documents.parquet", "doc_id")
    return tables.lines(docs, "text", "lines", "doc_id").select(
        "doc_id", "line_no", "content", F.col("metadata")["source"].alias("source"))


def assign_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Documents in three languages come without ids; the others keep theirs."""
    docs = _documents(spark, sf)
    given = F.when(F.col("metadata")["lang"] != "en", F.col("doc_id").cast("string"))
    batch = docs.select(F.col("doc_id").alias("input_pos"), given.alias("doc_id"), "content")
    made = {policy: mutate.assign_ids(batch, policy, "input_pos", next_id).select("input_pos", F.col("doc_id").alias(policy))
            for policy, next_id in (("batch", 0), ("counter", 500), ("hash", 0))}
    return made["batch"].join(made["counter"], "input_pos").join(made["hash"], "input_pos").select(
        "input_pos", F.col("batch").alias("batch_id"), F.col("counter").alias("counter_id"), F.col("hash").alias("hash_id"))


def embed_hash(spark: SparkSession, sf: str) -> DataFrame:
    """Non-zero cells of the filled embeddings."""
    docs = _documents(spark, sf).select("doc_id", "content", F.lit(None).cast("array<float>").alias("embedding"))
    cells = mutate.fill_embeddings(docs, EMBED).select("doc_id", F.posexplode("embedding").alias("cell", "value"))
    return cells.filter("value != 0").select("doc_id", F.col("cell").cast("bigint").alias("cell"),
                                             F.round(F.col("value").cast("double"), 6).alias("value"))


def append_rows(spark: SparkSession, sf: str) -> DataFrame:
    both = mutate.append(_documents(spark, sf), _second_batch(spark, sf))
    return _keys(both)


def _twice(batch: DataFrame) -> DataFrame:
    """Every row of a batch twice, with another text and at another place."""
    later = batch.withColumn("content", F.concat(F.lit("again: "), "content")).withColumn("pos", F.col("doc_id") + 100_000_000)
    return batch.withColumn("pos", F.col("doc_id")).unionByName(later)


def upsert(spark: SparkSession, sf: str) -> DataFrame:
    batch = _twice(_second_batch(spark, sf))
    return _keys(mutate.upsert(_documents(spark, sf), batch, "pos"))


def insert_if_absent(spark: SparkSession, sf: str) -> DataFrame:
    batch = _twice(_second_batch(spark, sf))
    return _keys(mutate.insert_if_absent(_documents(spark, sf), batch, "pos"))


def _id_strings(spark: SparkSession, sf: str) -> DataFrame:
    """Comma-separated ids: the toxic documents, each with an id that does not exist."""
    toxic = _labels(spark, sf).filter("toxic = 1")
    return toxic.select(F.concat(F.col("doc_id").cast("string"), F.lit(" , "), (F.col("doc_id") + 10_000_000).cast("string")).alias("ids"))


def _text_ids(spark: SparkSession, sf: str) -> DataFrame:
    return _documents(spark, sf).withColumn("doc_id", F.col("doc_id").cast("string"))


def delete_ids(spark: SparkSession, sf: str) -> DataFrame:
    return _keys(mutate.delete(_text_ids(spark, sf), mutate.parse_ids(_id_strings(spark, sf), "ids")))


def delete_report(spark: SparkSession, sf: str) -> DataFrame:
    return mutate.delete_report(_text_ids(spark, sf), mutate.parse_ids(_id_strings(spark, sf), "ids"))


def _update(mode: str):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        current = _embedded_documents(spark, sf)
        changes = _second_batch(spark, sf).withColumn("embedding", F.lit(None).cast("array<float>"))
        return _cells(mutate.update(current, changes, mode, EMBED))

    return query


def _cells(docs: DataFrame) -> DataFrame:
    """Every non-zero cell of the vectors, beside the key of the text."""
    return _keyed_cells(_keyed_vectors(docs))


def _keyed_vectors(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", text.content_key(F.col("content")).alias("content_key"), "embedding")


def _keyed_cells(vectors: DataFrame, *more: str) -> DataFrame:
    cells = vectors.select("doc_id", "content_key", *more, F.posexplode("embedding").alias("cell", "value"))
    return cells.filter("value != 0").select("doc_id", "content_key", *more, F.col("cell").cast("bigint").alias("cell"),
                                             F.round(F.col("value").cast("double"), 6).alias("value"))


def _embedded_documents(spark: SparkSession, sf: str) -> DataFrame:
    return hooks.embed_column(_documents(spark, sf), EMBED)


def update_report(spark: SparkSession, sf: str) -> DataFrame:
    return mutate.update_report(_documents(spark, sf), _second_batch(spark, sf), "existing")


def payload_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """The metadata carries a key named content: the language."""
    docs = _documents(spark, sf).withColumn("metadata", F.map_concat(
        "metadata", F.create_map(F.lit("content"), F.col("metadata")["lang"])))
    columns = []
    for wins in ("metadata", "content"):
        content, rest = mutate.from_payload(mutate.to_payload(F.col("content"), F.col("metadata"), wins))
        columns += [text.content_key(content).alias(f"key_{wins}_wins"),
                    F.array_join(F.array_sort(F.map_keys(rest)), ",").alias(f"rest_{wins}_wins")]
    return docs.select("doc_id", *columns)


def collection_stats(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id")
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), "embedding")
    return mutate.stats(docs.join(vectors, "doc_id", "left"), "documents")


def dim_check(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of one label have lost a value."""
    docs = spark.read.parquet(f"{sf}/embeddings.parquet").select(
        F.col("vec_id").alias("doc_id"), "label",
        F.when(F.col("label") == 9, F.slice("embedding", 1, 63)).otherwise(F.col("embedding")).alias("embedding"))
    good, bad = mutate.split_by_dimension(docs, 64)
    status = [part.select("doc_id", "label", F.lit(flag).alias("accepted")) for part, flag in ((good, True), (bad, False))]
    return status[0].unionByName(status[1])


def _version(docs: DataFrame) -> DataFrame:
    """Documents stored as a version of a collection."""
    return collection.save(docs, new_folder(docs.sparkSession, "collection"))


def _batch(docs: DataFrame, embedder=None, **options) -> DataFrame:
    """A completed batch, in the order of ``pos``."""
    docs = docs if "pos" in docs.columns else docs.withColumn("pos", F.col("doc_id"))
    return collection.complete(docs, "pos", embedder, **options)


def collection_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Versions of a stored collection: two batches, a deletion, and a third change."""
    again = _batch(_twice(_second_batch(spark, sf)))
    current = _version(_batch(_documents(spark, sf)))
    current = _version(mutate.upsert(current, again, "pos"))
    current = _version(mutate.delete(current, mutate.parse_ids(_id_strings(spark, sf), "ids")))
    current = _version(mutate.insert_if_absent(current, again, "pos"))
    return current.select("doc_id", "content_key")


def collection_search(spark: SparkSession, sf: str) -> DataFrame:
    """Documents are added to a stored collection, which is then searched under a metadata filter."""
    stored = _version(_batch(_documents(spark, sf), EMBED, dimension=64))
    keep = filters.equals_all({"lang": "en"}, filters.map_lookup("metadata"))
    return _rounded(dense.search_filtered(_embedded_questions(spark, sf), stored, keep, TOP_K))


def collection_add(spark: SparkSession, sf: str) -> DataFrame:
    """Documents in three languages come without ids and all without vectors; the others keep theirs. A second call goes on counting."""
    docs = _documents(spark, sf).withColumn("pos", F.col("doc_id"))
    given = docs.withColumn("doc_id", F.when(F.col("metadata")["lang"] != "en", F.col("doc_id").cast("string")))
    first = written(_batch(given, EMBED, ids="counter", dimension=64), "batch")
    second = written(_batch(docs.filter(F.col("metadata")["lang"] == "de").drop("doc_id"), EMBED, ids="counter", next_id=first.count(), dimension=64), "batch")
    stored = _version(mutate.upsert(_version(mutate.one_per_id(first, "pos")), second, "pos"))
    ids = [batch.select("pos", "doc_id", F.lit(call).alias("call")) for call, batch in ((1, first), (2, second))]
    # Joined before vectors become a row for each cell.
    return _keyed_cells(_keyed_vectors(stored).join(ids[0].unionByName(ids[1]), "doc_id"), "call", "pos").select("doc_id", "call", "pos", "content_key", "cell", "value")


def collection_append(spark: SparkSession, sf: str) -> DataFrame:
    """Appended copies stay beside the stored rows until their id is changed."""
    docs = _documents(spark, sf)
    current = _version(_batch(docs))
    current = _version(mutate.append(current, _batch(docs.filter(F.col("metadata")["lang"] == "en")).drop("pos")))
    current = _version(mutate.upsert(current, _batch(_twice(_second_batch(spark, sf))), "pos"))
    return current.select("doc_id", "content_key")


def collection_buckets(spark: SparkSession, sf: str) -> DataFrame:
    """Two batches merged into versions whose rows lie in buckets by id."""
    current = collection.save_buckets(_batch(_documents(spark, sf)), new_folder(spark, "buckets"), N_BUCKETS)
    for _ in range(2):
        current = collection.merge_buckets(current, _batch(_twice(_second_batch(spark, sf))), new_folder(spark, "buckets"), N_BUCKETS, "pos")
    return current.select("doc_id", "content_key")


def _collection_update(mode: str):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        current = _version(_batch(_documents(spark, sf), EMBED, dimension=64))
        return _cells(_version(mutate.update(current, _batch(_twice(_second_batch(spark, sf))), mode, EMBED, order="pos")))

    return query


# --- contexts, prompts, conversations -----------------------------------------------------------

def context_block(spark: SparkSession, sf: str) -> DataFrame:
    questions, hits = _reranked(spark, sf)
    return context.context_blocks(questions.select("query_id"), hits)


def context_split(spark: SparkSession, sf: str) -> DataFrame:
    """Contexts cut out of stored text blocks: the header, then one part per hit."""
    parts = context_block(spark, sf).select("query_id", F.posexplode(context.split_block(F.col("retrieved_info"))).alias("place", "part"))
    return parts.select("query_id", F.col("place").cast("bigint").alias("place"), "part")


def prompt_table(spark: SparkSession, sf: str) -> DataFrame:
    questions, hits = _reranked(spark, sf)
    blocks = context.context_blocks(questions.select("query_id", "query"), hits)
    merged = context.merge_context(F.create_map(F.lit("retrieved_info"), F.lit("stale"), F.lit("channel"), F.lit("batch")),
                                   F.col("retrieved_info"))
    return blocks.select("query_id", context.prompt(F.col("query"), merged, SYSTEM_PROMPT).alias("prompt"))


def augment(spark: SparkSession, sf: str) -> DataFrame:
    questions, hits = _reranked(spark, sf)
    blocks = context.context_blocks(questions.select("query_id", "query"), hits)
    return blocks.select("query_id", context.augment(F.col("retrieved_info"), F.col("query")).alias("augmented"))


def chat_messages(spark: SparkSession, sf: str) -> DataFrame:
    return chat.chat_messages(_messages(spark, sf), SYSTEM_PROMPT)


def replying(spec):
    """Stand-in chat model: counts the messages and repeats the last one."""
    def reply(history: list[tuple[str, str]]) -> str:
        kinds = [kind for kind, _ in history]
        return f"{kinds.count('system')}/{kinds.count('human')}/{kinds.count('ai')} {history[-1][1]}"

    return reply


def chat_replies(spark: SparkSession, sf: str) -> DataFrame:
    """A reply to every turn of a user, from all that was said before it."""
    messages = _messages(spark, sf)
    return chat.replies(chat.all_calls(messages, "user"), messages, replying, ModelSpec(system_prompt=SYSTEM_PROMPT))


def chat_replies_bounded(spark: SparkSession, sf: str) -> DataFrame:
    """The same from a model that holds no more than the last part of a conversation."""
    messages = _messages(spark, sf)
    return chat.replies(chat.all_calls(messages, "user"), messages, replying, ModelSpec(system_prompt=SYSTEM_PROMPT, context_tokens=CONTEXT_TOKENS))


def _history(messages: DataFrame, *conversation: str) -> DataFrame:
    """What every turn sees: one row for each visible message, with the size of the whole."""
    calls = chat.all_calls(messages, conversation=conversation)
    sizes = chat.history_asof(messages, conversation).select(*conversation, F.col("turn").alias("as_of"), "n_messages", "n_chars")
    seen = chat.history_of(calls, messages, conversation)
    return seen.join(sizes, [*conversation, "as_of"]).select(*conversation, "as_of", "n_messages", "n_chars", "turn", "role", "text")


def history_asof(spark: SparkSession, sf: str) -> DataFrame:
    return _history(_messages(spark, sf), "conv_id")


def history_of(spark: SparkSession, sf: str) -> DataFrame:
    """The texts that the last turn of every conversation sees."""
    messages = _messages(spark, sf)
    return chat.history_of(chat.last_calls(messages), messages).select("conv_id", "as_of", "turn", "role", "text")


def history_cleared(spark: SparkSession, sf: str) -> DataFrame:
    """Stored system rows mark the points at which a history was cleared: what every turn sees since the last clear before it."""
    messages = _messages(spark, sf)
    clears = messages.filter("role = 'system'").select("conv_id", F.col("turn").alias("cleared_at"))
    return _history(written(chat.epochs(messages, clears), "epochs"), "conv_id", "epoch")


def history_now(spark: SparkSession, sf: str) -> DataFrame:
    """What is left of every conversation after its last clear."""
    messages = _messages(spark, sf)
    clears = messages.filter("role = 'system'").select("conv_id", F.col("turn").alias("cleared_at"))
    return chat.since_clear(messages, clears)


def token_estimate(spark: SparkSession, sf: str) -> DataFrame:
    return chat.token_estimates(_messages(spark, sf))


def token_totals(spark: SparkSession, sf: str) -> DataFrame:
    return chat.token_totals(_messages(spark, sf))


# --- workflows ----------------------------------------------------------------------------------

def _requests(spark: SparkSession, sf: str) -> DataFrame:
    rows = _messages(spark, sf).select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text")
    return workflow.requests(rows, "id", "text")


STEPS = [
    workflow.column_step("cleaner", "clean", lambda task, _: F.lower(F.replace(task, F.lit("\n"), F.lit(" ")))),
    workflow.column_step("checker", "check", lambda task, _: F.concat(F.lit("checked: "), task),
                         lambda task, _: F.when(~F.contains(task, F.lit(",")), F.concat(F.lit("no comma in "), F.length(task).cast("string")))),
    workflow.column_step("counter", "count", lambda task, _: F.concat(F.length(task).cast("string"), F.lit(" characters")),
                         lambda task, _: F.when(F.contains(task, F.lit("ing")), F.lit("a gerund"))),
]


def _flat_results(results: DataFrame) -> DataFrame:
    log = F.transform("step_results", lambda s: F.concat_ws(":", s["agent"], s["action"], s["success"].cast("string")))
    return results.select("request_id", "success", "error", F.array_join(log, ";").alias("log"), *[
        tables.output("outputs", step.agent).alias(f"out_{step.agent}") for step in STEPS])


def workflow_sequential(spark: SparkSession, sf: str) -> DataFrame:
    return _flat_results(workflow.sequential(_requests(spark, sf), STEPS))


def workflow_parallel(spark: SparkSession, sf: str) -> DataFrame:
    return _flat_results(workflow.parallel(_requests(spark, sf), STEPS))


def workflow_log(spark: SparkSession, sf: str) -> DataFrame:
    log = workflow.step_log(workflow.sequential(_requests(spark, sf), STEPS))
    return log.select("request_id", "step_idx", "agent", "action", "success", text.content_key(F.col("output")).alias("output_key"))


def _rag(spark: SparkSession, sf: str) -> DataFrame:
    """Every question of the benchmark, and an empty request for each question without a line feed."""
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    empty = bench.filter(~F.contains("text", F.lit("\n"))).select((F.col("item_id") + 1_000_000).alias("item_id"), F.lit("").alias("question"))
    asked = bench.select("item_id", F.col("text").alias("question")).unionByName(empty)
    return workflow.retrieve_then_generate(
        workflow.requests(asked, "item_id", "question"), _corpus(spark, sf), EMBED, hooks.first_hit(), PARAMS, lexical=True)


def workflow_rag(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.answers(_rag(spark, sf))
    log = F.transform("step_results", lambda s: F.concat_ws(":", s["agent"], s["action"], s["success"].cast("string")))
    return rows.select("request_id", "success", "answer", "retrieved_context", F.array_join(log, ";").alias("log"), "error")


def _evaluation_rows(spark: SparkSession, sf: str, replies: bool = False) -> DataFrame:
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    if replies:
        # The truth of a question is the first reply of the conversation with its number; without one it is empty.
        first = (_messages(spark, sf).filter("role = 'assistant'").groupBy("conv_id").agg(F.min(F.struct("turn", "text"))["text"].alias("reply")))
        truth = bench.join(first, F.col("item_id") == F.col("conv_id"), "left").withColumn("truth", F.coalesce("reply", F.lit("")))
    else:
        # The truth of a question is what stands in it up to its first full stop.
        truth = bench.withColumn("truth", F.substring_index("text", ".", 1))
    golden = tables.golden(truth, "text", "truth", "item_id")
    return written(evaluation.golden_rows(golden, _rag(spark, sf)), "evaluation-rows")


def _evaluated(spark: SparkSession, sf: str, replies: bool = False) -> DataFrame:
    rows = _evaluation_rows(spark, sf, replies)
    return evaluate.lexical_metrics(spread(rows, rows.count(), "question_id"), EMBED)


def eval_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _evaluated(spark, sf).select("question_id", *[F.round(m, 6).alias(m) for m in evaluate.METRICS])


def eval_replies(spark: SparkSession, sf: str) -> DataFrame:
    """The metrics against truths that are no part of the questions."""
    return _evaluated(spark, sf, replies=True).select("question_id", *[F.round(m, 6).alias(m) for m in evaluate.METRICS])


def eval_summary(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.means(_evaluated(spark, sf)).select("n_questions", *[F.round(m, 6).alias(m) for m in evaluate.METRICS])


def doubting(spec):
    """A judge that refuses to look at the statements of some answers."""
    ask = evaluate.token_judge()(spec)

    def judge(kind: str, row: dict) -> list[tuple[str, int]]:
        if kind == "statement" and len(row["question"]) % 5 == 0:
            raise RuntimeError("refused")
        return ask(kind, row)

    return judge


def _judged(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = _evaluation_rows(spark, sf)
    return rows, written(evaluate.judge(spread(rows, rows.count(), "question_id"), doubting), "verdicts")


def eval_judged(spark: SparkSession, sf: str) -> DataFrame:
    """The four metrics from the verdicts of a judge hook."""
    return evaluate.judged_metrics(*_judged(spark, sf), EMBED).select("question_id", *[F.round(m, 6).alias(m) for m in evaluate.METRICS])


def eval_refused(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts by kind, with the calls that failed."""
    verdicts = _judged(spark, sf)[1]
    return verdicts.groupBy("kind", "error").agg(F.count("*").alias("n"), F.sum(F.col("verdict").cast("bigint")).alias("n_accepted"))


def eval_runs(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.run_counts(_rag(spark, sf))


# --- streams ------------------------------------------------------------------------------------

def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """The documents, then a batch of changes, arrive as files; the stream goes on where it stopped."""
    folder = new_folder(spark, "stream-ingest")
    waves = [_documents(spark, sf), _second_batch(spark, sf)]
    for wave in waves:
        part = wave.select(F.col("doc_id").cast("string").alias("doc_id"), "content", "metadata",
                           F.lit(None).cast("array<float>").alias("embedding"))
        jobs.write_part(part, f"{folder}/in")
        source = jobs.file_stream(spark, f"{folder}/in", part, files_per_batch=4)
        jobs.run(jobs.ingest(source, f"{folder}/collection", f"{folder}/state", "documents", EMBED, 64))
    return _cells(jobs.latest(spark, f"{folder}/collection"))


def stream_tokens(spark: SparkSession, sf: str) -> DataFrame:
    folder = new_folder(spark, "stream-tokens")
    messages = _messages(spark, sf)
    jobs.write_part(messages, f"{folder}/in")
    source = jobs.file_stream(spark, f"{folder}/in", messages, files_per_batch=4)
    jobs.run(jobs.stream_token_totals(source, f"{folder}/out", f"{folder}/state"))
    return jobs.latest_totals(spark, f"{folder}/out")


QUERIES = {
    "knn_l2_topk": _knn("l2", "identity"),
    "knn_l2_score": _knn("l2", "inverse"),
    "knn_l2_blocks": _knn("l2", "inverse", SMALL_BLOCKS),
    "knn_chroma_score": _knn("l2", "one_minus"),
    "knn_cosine_topk": _knn("cosine", "identity"),
    "knn_dot_topk": _knn("dot", "identity"),
    "knn_euclid_topk": _knn("euclid", "inverse"),
    "knn_prefilter": knn_prefilter,
    "knn_postfilter": knn_postfilter,
    "knn_request_filter": knn_request_filter,
    "knn_threshold": knn_threshold,
    "knn_tombstone": _tombstones("post"),
    "knn_without_deleted": _tombstones("pre"),
    "knn_ivf": knn_ivf,
    "knn_ivf_all_lists": _ivf(16, 16),
    "knn_ivf_labels": _ivf(None, 4),
    "knn_filter_operators": knn_filter_operators,
    "knn_own_filters": knn_own_filters,
    "collection_add": collection_add,
    "collection_append": collection_append,
    "collection_update_existing": _collection_update("existing"),
    "collection_buckets": collection_buckets,
    "collection_update_upsert": _collection_update("upsert"),
    "collection_update_payload_only": _collection_update("payload_only"),
    "history_of": history_of,
    "filter_typed": filter_typed,
    "knn_lsh": knn_lsh,
    "knn_multiprobe": knn_multiprobe,
    "filter_operators": filter_operators,
    "valid_input": valid_input,
    "bm25_term_stats": bm25_term_stats,
    "bm25_topk": _bm25(),
    "bm25_blocks": _bm25(replace(SMALL_BLOCKS, broadcast_bytes=1 << 10)),
    "bm25_filtered": bm25_filtered,
    "bm25_updated": bm25_updated,
    "rrf_fuse": rrf_fuse,
    "dense_topk": dense_topk,
    "hybrid_topk": hybrid_topk,
    "hybrid_two_backends": hybrid_two_backends,
    "hybrid_filtered": hybrid_filtered,
    "rerank_lexical": rerank_lexical,
    "rerank_hook": rerank_hook,
    "result_summary": result_summary,
    "ingest_lines": ingest_lines,
    "assign_ids": assign_ids,
    "embed_hash": embed_hash,
    "append_rows": append_rows,
    "upsert": upsert,
    "insert_if_absent": insert_if_absent,
    "delete_ids": delete_ids,
    "delete_report": delete_report,
    "update_existing": _update("existing"),
    "update_upsert": _update("upsert"),
    "update_payload_only": _update("payload_only"),
    "update_report": update_report,
    "payload_roundtrip": payload_roundtrip,
    "collection_stats": collection_stats,
    "dim_check": dim_check,
    "collection_roundtrip": collection_roundtrip,
    "collection_search": collection_search,
    "context_block": context_block,
    "context_split": context_split,
    "prompt_table": prompt_table,
    "augment": augment,
    "chat_messages": chat_messages,
    "chat_replies": chat_replies,
    "chat_replies_bounded": chat_replies_bounded,
    "history_asof": history_asof,
    "history_cleared": history_cleared,
    "history_now": history_now,
    "token_estimate": token_estimate,
    "token_totals": token_totals,
    "workflow_sequential": workflow_sequential,
    "workflow_parallel": workflow_parallel,
    "workflow_log": workflow_log,
    "workflow_rag": workflow_rag,
    "eval_metrics": eval_metrics,
    "eval_replies": eval_replies,
    "eval_summary": eval_summary,
    "eval_runs": eval_runs,
    "eval_judged": eval_judged,
    "eval_refused": eval_refused,
    "stream_ingest": stream_ingest,
    "stream_tokens": stream_tokens,
}
