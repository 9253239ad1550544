"""SQL equivalents of the registered queries, over the same tables and whole texts.

The query without an entry is approximate with projections of Spark's own (``knn_lsh``); tests check its recall.
"""

from __future__ import annotations

from corpusloom.operators.context import DEFAULT_TEMPLATE, NO_RESULTS
from corpusloom.plans.registry import CONTEXT_TOKENS, KEYWORD_K, MULTIPROBE, N_PROBES, PARAMS, SYSTEM_PROMPT, TOP_K

TOP, CANDIDATES = PARAMS.top_k, PARAMS.candidate_k


def _with(body: str, *parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + body


# --- vector search ------------------------------------------------------------------------------

COST = {
    "l2": "round(list_distance(q.e, d.e) * list_distance(q.e, d.e), 6) + 0.0",
    "euclid": "round(list_distance(q.e, d.e), 6) + 0.0",
    "cosine": "0.0 - round(list_cosine_similarity(q.e, d.e), 6)",
    "dot": "0.0 - round(list_inner_product(q.e, d.e), 6)",
}
SCORE = {
    "inverse": "round(1.0::DOUBLE / (1.0::DOUBLE + cost), 6)",
    "one_minus": "round(1.0::DOUBLE - cost, 6)",
    "identity": "round(cost, 6)",
    "similarity": "0.0 - cost",
}


def _knn(metric: str, score: str, docs: str = "v", pairs: str = "true", after: str = "true") -> str:
    distance = "cost" if metric in ("l2", "euclid") else "NULL::DOUBLE"
    return _with(
        f"SELECT query_id, doc_id, rank, {SCORE[score]} AS score, {distance} AS distance "
        f"FROM ranked WHERE rank <= {TOP_K} AND {after}",
        "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)",
        f"pairs AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, d.label, {COST[metric]} AS cost FROM v q, {docs} d WHERE {pairs})",
        "ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cost, doc_id) AS rank FROM pairs)")


def _multiprobe(n_tables: int, n_projections: int, width: int) -> str:
    """Buckets of whole numbers, the probed ones in the order of the borders crossed."""
    names = [f"b{p}" for p in range(n_projections)]
    distance = " + ".join(f"CASE s{p} WHEN -1 THEN r{p} * r{p} WHEN 1 THEN ({width} - r{p}) * ({width} - r{p}) ELSE 0 END" for p in range(n_projections))
    return _with(
        f"SELECT query_id, doc_id, rank, {SCORE['inverse']} AS score, cost AS distance FROM ranked WHERE rank <= {TOP_K}",
        "v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)",
        f"signs AS (SELECT t, p, d, CASE WHEN substr(md5(t || ',' || p || ',' || d), 1, 1) < '8' THEN 1 ELSE -1 END AS sign "
        f"FROM range({n_tables}) a(t), range({n_projections}) b(p), range(64) c(d))",
        "cells AS (SELECT vec_id, generate_subscripts(e, 1) - 1 AS d, floor(unnest(e) * 4096)::BIGINT AS x FROM v)",
        "places AS (SELECT vec_id, t, p, sum(sign * x)::BIGINT AS place FROM cells JOIN signs USING (d) GROUP BY ALL)",
        f"floors AS (SELECT *, floor(place / {width})::BIGINT AS b FROM places)",
        "own AS (SELECT vec_id, t, " + ", ".join(
            f"max(b) FILTER (WHERE p = {p}) AS b{p}, max(place - b * {width}) FILTER (WHERE p = {p}) AS r{p}" for p in range(n_projections))
        + " FROM floors GROUP BY ALL)",
        "steps AS (SELECT * FROM " + ", ".join(f"(VALUES (-1), (0), (1)) x{p}(s{p})" for p in range(n_projections)) + ")",
        "probes AS (SELECT vec_id, t, " + ", ".join(f"b{p} + s{p} AS b{p}" for p in range(n_projections))
        + f", row_number() OVER (PARTITION BY vec_id, t ORDER BY {distance}, " + ", ".join(f"s{p}" for p in range(n_projections))
        + ") AS place FROM own, steps)",
        f"pairs AS (SELECT DISTINCT q.vec_id AS query_id, d.vec_id AS doc_id FROM probes q JOIN own d USING (t, {', '.join(names)}) WHERE q.place <= {N_PROBES})",
        f"costs AS (SELECT query_id, doc_id, {COST['l2']} AS cost FROM pairs JOIN v q ON q.vec_id = query_id JOIN v d ON d.vec_id = doc_id)",
        "ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cost, doc_id) AS rank FROM costs)")


DELETED = "(SELECT doc_id FROM labels WHERE toxic = 1)"

# --- keyword search -----------------------------------------------------------------------------

TOKENS = r"list_filter(string_split_regex(lower({}), '\s+'), lambda x: x <> '')"

DOC_TOKENS = f"dtok AS (SELECT doc_id, unnest({TOKENS.format('text')}) AS token FROM documents)"
QUERY_TOKENS = f"qtok AS (SELECT item_id AS query_id, unnest({TOKENS.format('text')}) AS token FROM benchmark)"
IDF = (
    "tf AS (SELECT doc_id, token, count(*) AS tf FROM dtok GROUP BY ALL)",
    "dl AS (SELECT d.doc_id, count(t.token) AS dl FROM documents d LEFT JOIN dtok t USING (doc_id) GROUP BY ALL)",
    "corpus AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM dl)",
    "raw AS (SELECT token, df, ln(n_docs - df + 0.5) - ln(df + 0.5) AS raw "
    "FROM (SELECT token, count(*) AS df FROM tf GROUP BY ALL), corpus)",
    "idf AS (SELECT token, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw)",
)
BM25 = (
    "qtf AS (SELECT query_id, token, count(*) AS qtf FROM qtok GROUP BY ALL)",
    "bm AS (SELECT query_id, doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score "
    "FROM qtf JOIN idf USING (token) JOIN tf USING (token) JOIN dl USING (doc_id), corpus GROUP BY ALL)",
    "bm_ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank "
    "FROM bm WHERE score > 0)",
)
KEYWORDS = (DOC_TOKENS, QUERY_TOKENS, *IDF, *BM25)

# --- embeddings of texts ------------------------------------------------------------------------


def _embedding(name: str, tokens: str, key: str) -> tuple[str, str]:
    return (
        f"{name}_cells AS (SELECT {key}, (('0x' || substr(md5(token), 1, 8))::UBIGINT % 64)::BIGINT AS cell, "
        f"sum(CASE WHEN substr(md5(token), 9, 1) < '8' THEN 1 ELSE -1 END)::DOUBLE AS v FROM {tokens} GROUP BY ALL)",
        f"{name} AS (SELECT {key}, cell, (v / sqrt(sum(v * v) OVER (PARTITION BY {key})))::FLOAT::DOUBLE AS x "
        f"FROM {name}_cells WHERE v <> 0)",
    )


DENSE = (
    *_embedding("demb", "dtok", "doc_id"),
    *_embedding("qemb", "qtok", "query_id"),
    "dots AS (SELECT query_id, doc_id, sum(q.x * d.x) AS dot FROM qemb q JOIN demb d USING (cell) GROUP BY ALL)",
    "qn AS (SELECT query_id, sum(x * x) AS qn FROM qemb GROUP BY ALL)",
    "dn AS (SELECT doc_id, sum(x * x) AS dn FROM demb GROUP BY ALL)",
    "l2 AS (SELECT query_id, doc_id, round(greatest(qn + dn - 2 * coalesce(dot, 0), 0), 6) + 0.0 AS cost, "
    "0.0 - round(coalesce(dot, 0) / sqrt(qn) / sqrt(dn), 6) AS cos_cost "
    "FROM qn CROSS JOIN dn LEFT JOIN dots USING (query_id, doc_id))",
)


def _list(idx: int, where: str = "true", cost: str = "cost") -> str:
    return (f"SELECT {idx} AS list_idx, query_id, doc_id, {cost} AS cost, "
            f"row_number() OVER (PARTITION BY query_id ORDER BY {cost}, doc_id) AS rank FROM l2 "
            f"JOIN documents USING (doc_id) WHERE {where}")


def _lists(*parts: str) -> str:
    return "hits AS (SELECT * FROM (" + " UNION ALL BY NAME ".join(parts) + f") WHERE rank <= {CANDIDATES})"


KEYWORD_LIST = "SELECT {} AS list_idx, query_id, doc_id, NULL::DOUBLE AS cost, rank FROM bm_ranked"
HYBRID_HITS = _lists(_list(0), KEYWORD_LIST.format(1))
FUSED = (
    "fused AS (SELECT query_id, text, arg_min(doc_id, list_idx * 100000 + rank) AS doc_id, "
    "arg_min(list_idx, list_idx * 100000 + rank) AS first_list, "
    "sum(1::DOUBLE / (60 + rank) ORDER BY list_idx, rank) AS score, min(list_idx * 100000 + rank) AS place "
    "FROM hits JOIN documents USING (doc_id) GROUP BY query_id, text)",
    "fused_ranked AS (SELECT f.*, l2.cost, l2.cos_cost, "
    "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, place) AS rank FROM fused f JOIN l2 USING (query_id, doc_id))",
)


def _hybrid(hits: str, keyword_list: int) -> str:
    distance = f"CASE WHEN first_list = 0 AND {keyword_list} > 0 THEN cost END"
    return _with(f"SELECT query_id, rank, doc_id, round(score, 9) AS score, {distance} AS distance "
                 f"FROM fused_ranked WHERE rank <= {TOP}", *KEYWORDS, *DENSE, hits, *FUSED)


RERANKED = (
    "qset AS (SELECT DISTINCT query_id, token, idf FROM qtok JOIN idf USING (token))",
    "pair AS (SELECT query_id, doc_id, round(coalesce(sum(CASE WHEN tf IS NOT NULL THEN idf ELSE 0 END) / nullif(sum(idf), 0), 0), 6) AS score "
    "FROM fused_ranked f JOIN qset USING (query_id) LEFT JOIN tf USING (doc_id, token) GROUP BY ALL)",
    "final AS (SELECT p.query_id, p.doc_id, p.score, CASE WHEN f.first_list = 0 THEN f.cost END AS distance, d.text, "
    "d.lang, d.source, row_number() OVER (PARTITION BY p.query_id ORDER BY p.score DESC, f.rank) AS rank "
    "FROM pair p JOIN fused_ranked f USING (query_id, doc_id) JOIN documents d USING (doc_id) "
    f"QUALIFY row_number() OVER (PARTITION BY p.query_id ORDER BY p.score DESC, f.rank) <= {TOP})",
)
RERANK = (*KEYWORDS, *DENSE, HYBRID_HITS, *FUSED, *RERANKED)

OVERLAP = (
    "dset AS (SELECT DISTINCT doc_id, token FROM dtok)",
    "overlap AS (SELECT query_id, doc_id, count(s.token)::DOUBLE AS score FROM fused_ranked f "
    "JOIN (SELECT DISTINCT query_id, token FROM qtok) q USING (query_id) LEFT JOIN dset s USING (doc_id, token) GROUP BY ALL)",
    "final AS (SELECT o.query_id, o.doc_id, o.score, CASE WHEN f.first_list = 0 THEN f.cost END AS distance, "
    "row_number() OVER (PARTITION BY o.query_id ORDER BY o.score DESC, f.rank) AS rank "
    "FROM overlap o JOIN fused_ranked f USING (query_id, doc_id))",
)

# --- contexts and prompts -----------------------------------------------------------------------

ENTRY = (r"""rank::VARCHAR || '. [Score: ' || printf('%.2f', score) || E']\n   ' || text || """
         r"""E'\n   Metadata: {"lang":"' || lang || '","source":"' || source || E'"}\n'""")
BLOCK = (f"block AS (SELECT b.item_id AS query_id, b.text AS query, count(f.doc_id) AS num_results, "
         f"CASE WHEN count(f.doc_id) = 0 THEN '{NO_RESULTS}' ELSE E'Retrieved Information:\\n\\n' || "
         f"string_agg({ENTRY.replace('text', 'f.text')}, E'\\n' ORDER BY rank) END AS retrieved_info "
         "FROM benchmark b LEFT JOIN final f ON f.query_id = b.item_id GROUP BY ALL)")


def _quoted(value: str) -> str:
    return "E'" + value.replace("'", "''").replace("\n", "\\n") + "'"


def _augmented() -> str:
    before, rest = DEFAULT_TEMPLATE.split("{retrieved_info}")
    between, after = rest.split("{query}")
    return " || ".join(part for part in (_quoted(before), "retrieved_info", _quoted(between), "query",
                                         _quoted(after) if after else "''"))


# --- ingest and maintenance ---------------------------------------------------------------------

BATCH = ("batch AS (SELECT doc_id, 'changed: ' || text AS text FROM documents JOIN labels USING (doc_id) WHERE quality = 0 "
         "UNION ALL SELECT doc_id + 10000000, text FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)")
DOC_KEYS = "SELECT doc_id, sha256(text) AS content_key FROM documents"
BATCH_KEYS = "SELECT doc_id, sha256(text) AS content_key FROM batch"
NOT_IN_BATCH = "doc_id NOT IN (SELECT doc_id FROM batch)"
NOT_IN_DOCS = "doc_id NOT IN (SELECT doc_id FROM documents)"
GONE = "(SELECT doc_id + 10000000 FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id FROM labels WHERE toxic = 1)"
TOXIC = "(SELECT doc_id FROM labels WHERE toxic = 1)"


def _updated(texts: str, vectors: str, key: str = "doc_id", *batch: str) -> str:
    """``texts`` and ``vectors`` are the tables the text and the embedding come from. One row for each cell that is not zero."""
    return _with(f"SELECT {key} AS doc_id, sha256(t.text) AS content_key, cell, round(x, 6) AS value FROM ({texts}) t JOIN emb USING (doc_id)",
                 *(batch or (BATCH,)), f"vsource AS ({vectors})",
                 f"etok AS (SELECT doc_id, unnest({TOKENS.format('text')}) AS token FROM vsource)", *_embedding("emb", "etok", "doc_id"))


# Each row of the batch comes twice; the last one counts in an upsert, the first in an insert.
AGAIN = (BATCH.replace("batch AS", "first_batch AS"), "batch AS (SELECT doc_id, 'again: ' || text AS text FROM first_batch)")


EXISTING = (f"SELECT doc_id, text FROM documents WHERE {NOT_IN_BATCH} "
            "UNION ALL SELECT doc_id, text FROM batch WHERE doc_id IN (SELECT doc_id FROM documents)")
UPSERTED = f"SELECT doc_id, text FROM documents WHERE {NOT_IN_BATCH} UNION ALL SELECT doc_id, text FROM batch"

# --- conversations ------------------------------------------------------------------------------

SOFAR = "(PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
HISTORY = (f"SELECT conv_id, turn, count(*) OVER {SOFAR} AS n_messages, "
           f"(sum(length(text)) OVER {SOFAR})::BIGINT AS n_chars FROM ")

SEEN = ("SELECT {0}, c.turn AS as_of, n_messages, n_chars, m.turn, m.role, m.text FROM (SELECT {0}, turn, count(*) OVER w AS n_messages, (sum(length(text)) OVER w)::BIGINT AS n_chars "
        "FROM {1} WINDOW w AS (PARTITION BY {0} ORDER BY turn)) c JOIN {1} m USING ({0}) WHERE m.turn <= c.turn")
CALLS = ("spoken AS (SELECT *, greatest(length(text), 1) AS size, sum(greatest(length(text), 1)) OVER (PARTITION BY conv_id ORDER BY turn) AS total FROM conversations WHERE role <> 'system')",)
REPLY = ("SELECT c.conv_id::VARCHAR || '-' || c.turn::VARCHAR AS call_id, c.text <> '' AS success, CASE WHEN c.text = '' THEN 'Invalid input message' END AS error, "
         "CASE WHEN c.text = '' THEN '' ELSE '1/' || count(*) FILTER (WHERE m.role <> 'assistant') || '/' || count(*) FILTER (WHERE m.role = 'assistant') || ' ' || c.text END AS content "
         "FROM spoken c JOIN spoken m ON m.conv_id = c.conv_id AND m.turn <= c.turn AND ({}) WHERE c.role = 'user' GROUP BY c.conv_id, c.turn, c.text")

# --- workflows ----------------------------------------------------------------------------------

REQUESTS = ("req AS (SELECT conv_id::VARCHAR || '-' || turn::VARCHAR AS request_id, text FROM conversations)",
            r"s1 AS (SELECT *, CASE WHEN text <> '' THEN lower(replace(text, E'\n', ' ')) END AS c1 FROM req)")
INVALID = "'Invalid input message'"


def _step_errors(check: str, count: str) -> str:
    return (f"CASE WHEN {check} = '' THEN {INVALID} WHEN NOT contains({check}, ',') THEN 'no comma in ' || length({check}) END AS e2, "
            f"CASE WHEN {count} = '' THEN {INVALID} WHEN contains({count}, 'ing') THEN 'a gerund' END AS e3")


SEQUENTIAL = (*REQUESTS,
              f"seq AS (SELECT request_id, c1, CASE WHEN text = '' THEN {INVALID} END AS e1, 'checked: ' || c1 AS c2, "
              f"{_step_errors('c1', "('checked: ' || c1)")}, length('checked: ' || c1) || ' characters' AS c3 FROM s1)")
PARALLEL = (*REQUESTS,
            f"par AS (SELECT request_id, c1, CASE WHEN text = '' THEN {INVALID} END AS e1, 'checked: ' || text AS c2, "
            f"{_step_errors('text', 'text')}, length(text) || ' characters' AS c3 FROM s1)")
DONE = "CASE WHEN {} IS NULL THEN 'true' ELSE 'false' END"

RAG_QUESTIONS = ("asked AS (SELECT item_id, text AS question FROM benchmark UNION ALL "
                 "SELECT item_id + 1000000, '' FROM benchmark WHERE NOT contains(text, chr(10)))")
RAG = (*RERANK, BLOCK, RAG_QUESTIONS,
       "rag AS (SELECT a.item_id AS request_id, question, question <> '' AS success, b.retrieved_info, b.num_results, "
       f"coalesce(f.text, '{NO_RESULTS}') AS answer FROM asked a LEFT JOIN block b ON b.query_id = a.item_id "
       "LEFT JOIN final f ON f.query_id = a.item_id AND f.rank = 1)")

# --- evaluation ---------------------------------------------------------------------------------

SENTENCES = (r"list_filter(list_transform(string_split_regex({}, '[.!?\n]+'), "
             r"lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')")
EVALUATION = (
    *RAG,
    "er AS (SELECT r.request_id AS qid, b.text AS question, r.answer, split_part(b.text, '.', 1) AS ground_truth FROM rag r "
    "JOIN benchmark b ON b.item_id = r.request_id WHERE success)",
    "ctx AS (SELECT query_id AS qid, rank, text AS context FROM final JOIN er ON er.qid = query_id)",
    f"ctxtok AS (SELECT DISTINCT qid, rank, unnest({TOKENS.format('context')}) AS token FROM ctx)",
    "known AS (SELECT DISTINCT qid, token FROM ctxtok)",
    f"asent AS (SELECT qid, unnest(list_zip({SENTENCES.format('answer')}, range(len({SENTENCES.format('answer')})))) AS s FROM er)",
    f"atok AS (SELECT DISTINCT qid, s[2] AS idx, unnest({TOKENS.format('s[1]')}) AS token FROM asent)",
    "averd AS (SELECT qid, idx, (count(k.token) / count(*) >= 0.5)::INT AS v FROM atok LEFT JOIN known k USING (qid, token) GROUP BY ALL)",
    "faith AS (SELECT qid, avg(v) AS faithfulness FROM averd GROUP BY ALL)",
    f"gsent AS (SELECT qid, unnest(list_zip({SENTENCES.format('ground_truth')}, range(len({SENTENCES.format('ground_truth')})))) AS s FROM er)",
    f"gtok AS (SELECT DISTINCT qid, s[2] AS idx, unnest({TOKENS.format('s[1]')}) AS token FROM gsent)",
    "gverd AS (SELECT qid, idx, (count(k.token) / count(*) >= 0.5)::INT AS v FROM gtok LEFT JOIN known k USING (qid, token) GROUP BY ALL)",
    "recall AS (SELECT qid, avg(v) AS context_recall FROM gverd GROUP BY ALL)",
    f"want AS (SELECT DISTINCT qid, unnest({TOKENS.format('ground_truth')}) AS token FROM er)",
    "cverd AS (SELECT qid, rank, (count(c.token) / count(*) >= 0.5)::INT AS v FROM (SELECT DISTINCT qid, rank FROM ctx) "
    "JOIN want USING (qid) LEFT JOIN ctxtok c USING (qid, rank, token) GROUP BY ALL)",
    "cprec AS (SELECT qid, v, avg(v) OVER (PARTITION BY qid ORDER BY rank) AS p FROM cverd)",
    "precision_ AS (SELECT qid, coalesce(sum(p * v) / nullif(sum(v), 0), 0) AS context_precision FROM cprec GROUP BY ALL)",
    f"qt2 AS (SELECT qid, unnest({TOKENS.format('question')}) AS token FROM er)",
    *_embedding("qe", "qt2", "qid"),
    f"gt2 AS (SELECT qid || '#' || s[2] AS gid, unnest({TOKENS.format('s[1]')}) AS token FROM asent)",
    *_embedding("ge", "gt2", "gid"),
    "cosines AS (SELECT g.gid, split_part(g.gid, '#', 1)::BIGINT AS qid, sum(g.x * q.x) AS dot FROM ge g LEFT JOIN qe q "
    "ON q.qid = split_part(g.gid, '#', 1)::BIGINT AND q.cell = g.cell GROUP BY ALL)",
    f"relevancy AS (SELECT c.qid, avg(CASE WHEN answer = '{NO_RESULTS}' THEN 0 ELSE coalesce(dot, 0) / sqrt(gn) / sqrt(qn) END) AS answer_relevancy "
    "FROM cosines c JOIN (SELECT gid, sum(x * x) AS gn FROM ge GROUP BY ALL) USING (gid) "
    "JOIN (SELECT qid, sum(x * x) AS qn FROM qe GROUP BY ALL) USING (qid) JOIN er USING (qid) GROUP BY ALL)",
    "scores AS (SELECT qid AS question_id, faithfulness, answer_relevancy, coalesce(context_precision, 0) AS context_precision, "
    "context_recall FROM er LEFT JOIN faith USING (qid) LEFT JOIN relevancy USING (qid) LEFT JOIN precision_ USING (qid) "
    "LEFT JOIN recall USING (qid))",
)
# The same against the first reply of the conversation with the question's number.
REPLIES = tuple(
    part.replace("split_part(b.text, '.', 1)", "coalesce(c.reply, '')").replace(
        "b.item_id = r.request_id", "b.item_id = r.request_id LEFT JOIN replies c ON c.conv_id = b.item_id")
    for part in ("replies AS (SELECT conv_id, min(struct_pack(turn := turn, reply := text)).reply AS reply FROM conversations WHERE role = 'assistant' GROUP BY ALL)",
                 *EVALUATION))
ROUNDED = ", ".join(f"round({{0}}({m}), 6) AS {m}" for m in (
    "faithfulness", "answer_relevancy", "context_precision", "context_recall"))

ORACLE: dict[str, str] = {
    "knn_l2_topk": _knn("l2", "identity"),
    "knn_l2_score": _knn("l2", "inverse"),
    "knn_l2_blocks": _knn("l2", "inverse"),
    "knn_chroma_score": _knn("l2", "one_minus"),
    "knn_cosine_topk": _knn("cosine", "similarity"),
    "knn_dot_topk": _knn("dot", "similarity"),
    "knn_euclid_topk": _knn("euclid", "inverse"),
    "knn_prefilter": _knn("l2", "inverse", docs="(SELECT * FROM v WHERE label = 3)"),
    "knn_postfilter": _knn("l2", "inverse", after="label = 3"),
    "knn_request_filter": _knn("l2", "inverse", pairs="q.label = d.label"),
    "knn_threshold": _knn("cosine", "similarity", after="0.0 - cost >= 0.3"),
    "knn_tombstone": _knn("l2", "inverse", after=f"doc_id NOT IN {DELETED}"),
    "knn_without_deleted": _knn("l2", "inverse", docs=f"(SELECT * FROM v WHERE vec_id NOT IN {DELETED})"),
    "knn_ivf": _knn("l2", "inverse"),
    "knn_ivf_all_lists": _knn("l2", "inverse"),
    "knn_multiprobe": _multiprobe(**MULTIPROBE),
    "filter_operators": """
        SELECT event_id, event_type, value, k FROM (SELECT *, json_extract(props, '$.k')::BIGINT AS k FROM events)
        WHERE k >= 10 AND k < 90 AND (event_type IN ('click', 'error') OR value > 15.0) AND k NOT IN (13, 42) AND k <> 77 AND value > 0.5""",
    "valid_input": r"""
        SELECT doc_id, line_no - 1 AS line_no, line <> '' AS success,
               CASE WHEN line = '' THEN 'Invalid input message' END AS error
        FROM (SELECT doc_id, unnest(string_split(text, E'\n')) AS line,
                     generate_subscripts(string_split(text, E'\n'), 1) AS line_no FROM documents)""",
    "bm25_term_stats": _with("SELECT token, df, round(idf, 6) AS idf FROM idf", DOC_TOKENS, *IDF),
    "bm25_topk": _with(f"SELECT query_id, doc_id, rank, score FROM bm_ranked WHERE rank <= {KEYWORD_K}", *KEYWORDS),
    "bm25_blocks": _with(f"SELECT query_id, doc_id, rank, score FROM bm_ranked WHERE rank <= {KEYWORD_K}", *KEYWORDS),
    "bm25_updated": _with(
        f"SELECT query_id, doc_id, rank, score FROM bm_ranked WHERE rank <= {KEYWORD_K}",
        BATCH, f"present AS (SELECT * FROM ({UPSERTED}) WHERE doc_id NOT IN {TOXIC})",
        *[part.replace("FROM documents", "FROM present") for part in KEYWORDS]),
    "bm25_filtered": _with(
        "SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank "
        "FROM bm JOIN documents USING (doc_id) WHERE score > 0 AND lang = 'en' "
        f"QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= {KEYWORD_K}", *KEYWORDS),
    "rrf_fuse": _with(
        "SELECT query_id, doc_id, round(score, 9) AS score, distance, "
        "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, place) AS rank FROM fused",
        "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)",
        f"pairs AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, d.label, {COST['l2']} AS cost FROM v q, v d)",
        "hits AS (SELECT 0 AS list_idx, query_id, doc_id, cost, row_number() OVER (PARTITION BY query_id ORDER BY cost, doc_id) AS rank FROM pairs "
        f"QUALIFY rank <= {TOP_K} UNION ALL SELECT 1, query_id, doc_id, cost, "
        f"row_number() OVER (PARTITION BY query_id ORDER BY cost, doc_id) AS rank FROM pairs WHERE label = 3 QUALIFY rank <= {TOP_K})",
        "fused AS (SELECT query_id, text, arg_min(doc_id, list_idx * 100000 + rank) AS doc_id, arg_min(cost, list_idx * 100000 + rank) AS distance, "
        "sum(1::DOUBLE / (60 + rank) ORDER BY list_idx, rank) AS score, min(list_idx * 100000 + rank) AS place "
        "FROM hits JOIN documents USING (doc_id) GROUP BY query_id, text)"),
    "dense_topk": _with(
        f"SELECT query_id, rank, doc_id, round(1.0::DOUBLE - cost, 9) AS score, cost AS distance FROM ({_list(0)}) "
        f"WHERE rank <= {TOP} AND 1.0::DOUBLE - cost >= -0.5", DOC_TOKENS, QUERY_TOKENS, *DENSE),
    "hybrid_topk": _hybrid(HYBRID_HITS, 1),
    "hybrid_two_backends": _hybrid(_lists(_list(0), _list(1, cost="cos_cost"), KEYWORD_LIST.format(2)), 2),
    "hybrid_filtered": _hybrid(_lists(_list(0, "lang = 'de'"), KEYWORD_LIST.format(1)), 1),
    "rerank_lexical": _with("SELECT query_id, rank, doc_id, round(score, 9) AS score, distance FROM final", *RERANK),
    "rerank_hook": _with(f"SELECT query_id, rank, doc_id, score, distance FROM final WHERE rank <= {TOP}",
                         *KEYWORDS, *DENSE, HYBRID_HITS, *FUSED, *OVERLAP),
    "result_summary": _with(
        "SELECT b.item_id AS query_id, count(f.doc_id) OVER (PARTITION BY b.item_id) AS num_results, true AS hybrid, true AS reranked, "
        "f.rank - 1 AS place, round(f.score, 6) AS score, f.text AS content, f.lang FROM benchmark b LEFT JOIN final f ON f.query_id = b.item_id", *RERANK),
    "ingest_lines": r"""
        SELECT doc_id, line_no - 1 AS line_no, regexp_replace(line, '^\s+|\s+$', '', 'g') AS content, 'lines' AS source
        FROM (SELECT doc_id, unnest(string_split(text, E'\n')) AS line,
                     generate_subscripts(string_split(text, E'\n'), 1) AS line_no FROM documents)
        WHERE regexp_replace(line, '^\s+|\s+$', '', 'g') <> ''""",
    "assign_ids": """
        SELECT doc_id AS input_pos,
               CASE WHEN lang <> 'en' THEN doc_id::VARCHAR ELSE 'doc_' || (row_number() OVER (ORDER BY doc_id) - 1) END AS batch_id,
               CASE WHEN lang <> 'en' THEN doc_id::VARCHAR ELSE 'doc_' || (row_number() OVER (ORDER BY doc_id) + 499) END AS counter_id,
               CASE WHEN lang <> 'en' THEN doc_id::VARCHAR ELSE sha256(text) END AS hash_id FROM documents""",
    "embed_hash": _with("SELECT doc_id, cell, round(x, 6) AS value FROM demb", DOC_TOKENS, *_embedding("demb", "dtok", "doc_id")),
    "append_rows": _with(f"{DOC_KEYS} UNION ALL {BATCH_KEYS}", BATCH),
    "upsert": _with(f"{DOC_KEYS} WHERE {NOT_IN_BATCH} UNION ALL {BATCH_KEYS}", *AGAIN),
    "insert_if_absent": _with(f"{DOC_KEYS} UNION ALL {BATCH_KEYS} WHERE {NOT_IN_DOCS}", BATCH),
    "delete_ids": f"SELECT doc_id::VARCHAR AS doc_id, sha256(text) AS content_key FROM documents WHERE doc_id NOT IN {TOXIC}",
    "delete_report": f"SELECT 2 * (SELECT count(*) FROM labels WHERE toxic = 1) AS num_requested, "
                     f"(SELECT count(*) FROM documents WHERE doc_id IN {TOXIC}) AS num_deleted",
    "update_existing": _updated(EXISTING, EXISTING),
    "update_upsert": _updated(UPSERTED, UPSERTED),
    "update_payload_only": _updated(EXISTING, "SELECT doc_id, text FROM documents"),
    "update_report": _with("SELECT doc_id, doc_id IN (SELECT doc_id FROM documents) AS updated FROM batch", BATCH),
    "payload_roundtrip": "SELECT doc_id, sha256(lang) AS key_metadata_wins, 'lang,source' AS rest_metadata_wins, "
                         "sha256(text) AS key_content_wins, 'lang,source' AS rest_content_wins FROM documents",
    "collection_stats": """
        SELECT 'documents' AS name, count(*) AS document_count, count(embedding) AS vector_count,
               max(len(embedding))::BIGINT AS dimension, 'flat' AS index_type, 'parquet' AS backend
        FROM documents LEFT JOIN embeddings ON vec_id = doc_id""",
    "dim_check": "SELECT vec_id AS doc_id, label, label <> 9 AS accepted FROM embeddings",
    "collection_roundtrip": _with(
        "SELECT doc_id::VARCHAR AS doc_id, content_key FROM ("
        # What was deleted comes back as the first row of its id; the rest stays as the last.
        f"{DOC_KEYS} WHERE {NOT_IN_BATCH} AND doc_id NOT IN {TOXIC} UNION ALL "
        f"{BATCH_KEYS} WHERE doc_id NOT IN {GONE} UNION ALL SELECT doc_id, sha256(text) FROM first_batch WHERE doc_id IN {GONE})", *AGAIN),
    "collection_buckets": _with(f"SELECT doc_id::VARCHAR AS doc_id, content_key FROM ({DOC_KEYS} WHERE {NOT_IN_BATCH} UNION ALL {BATCH_KEYS})", *AGAIN),
    "collection_append": _with(
        "SELECT doc_id::VARCHAR AS doc_id, content_key FROM ("
        f"{DOC_KEYS} WHERE {NOT_IN_BATCH} UNION ALL {DOC_KEYS} WHERE {NOT_IN_BATCH} AND lang = 'en' UNION ALL {BATCH_KEYS})", *AGAIN),
    "collection_add": _with(
        "SELECT s.doc_id, call, pos, sha256(s.text) AS content_key, cell, round(x, 6) AS value FROM stored s JOIN emb USING (doc_id)",
        "stored AS (SELECT CASE WHEN lang <> 'en' THEN doc_id::VARCHAR ELSE 'doc_' || (row_number() OVER (ORDER BY doc_id) - 1) END AS doc_id, "
        "1 AS call, doc_id AS pos, text FROM documents UNION ALL SELECT 'doc_' || (row_number() OVER (ORDER BY doc_id) - 1 + (SELECT count(*) FROM documents)), "
        "2, doc_id, text FROM documents WHERE lang = 'de')",
        f"etok AS (SELECT doc_id, unnest({TOKENS.format('text')}) AS token FROM stored)", *_embedding("emb", "etok", "doc_id")),
    "collection_update_existing": _updated(EXISTING, EXISTING, "doc_id::VARCHAR", *AGAIN),
    "collection_update_upsert": _updated(UPSERTED, UPSERTED, "doc_id::VARCHAR", *AGAIN),
    "collection_update_payload_only": _updated(EXISTING, "SELECT doc_id, text FROM documents", "doc_id::VARCHAR", *AGAIN),
    "collection_search": _with(
        "SELECT query_id, doc_id, rank, round(1.0::DOUBLE / (1.0::DOUBLE + cost), 6) AS score, cost AS distance FROM ("
        "SELECT query_id, doc_id::VARCHAR AS doc_id, cost, row_number() OVER (PARTITION BY query_id ORDER BY cost, doc_id::VARCHAR) AS rank "
        f"FROM l2 JOIN documents USING (doc_id) WHERE lang = 'en') WHERE rank <= {TOP_K}", DOC_TOKENS, QUERY_TOKENS, *DENSE),
    "context_block": _with("SELECT query_id, retrieved_info, num_results FROM block", *RERANK, BLOCK),
    "context_split": _with(
        "SELECT query_id, 0::BIGINT AS place, CASE WHEN num_results = 0 THEN '' ELSE 'Retrieved Information:' END AS part FROM block "
        r"""UNION ALL SELECT query_id, rank, text || E'\n   Metadata: {"lang":"' || lang || '","source":"' || source || '"}' FROM final""", *RERANK, BLOCK),
    "prompt_table": _with(
        f"""SELECT query_id, E'System: {SYSTEM_PROMPT}\\n\\nContext: {{"channel":"batch","retrieved_info":' || to_json(retrieved_info)::VARCHAR || """
        """E'}\\n\\nUser: ' || query AS prompt FROM block""", *RERANK, BLOCK),
    "augment": _with(f"SELECT query_id, {_augmented()} AS augmented FROM block", *RERANK, BLOCK),
    "chat_messages": f"""
        SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position,
               CASE WHEN role = 'assistant' THEN 'ai' ELSE 'human' END AS kind, text
        FROM conversations WHERE role <> 'system'
        UNION ALL SELECT DISTINCT conv_id, 0, 'system', '{SYSTEM_PROMPT}' FROM conversations""",
    "chat_replies": _with(REPLY.format("true"), *CALLS),
    "chat_replies_bounded": _with(REPLY.format(f"c.total - m.total + m.size <= {4 * CONTEXT_TOKENS} OR m.turn = c.turn"), *CALLS),
    "history_asof": SEEN.format("conv_id", "conversations"),
    "history_of": "SELECT c.conv_id, max(turn) OVER (PARTITION BY conv_id) AS as_of, turn, role, text FROM conversations c",
    "history_now": _with("SELECT c.conv_id, turn, role, text FROM conversations c LEFT JOIN cleared USING (conv_id) WHERE cleared_at IS NULL OR turn > cleared_at",
                         "cleared AS (SELECT conv_id, max(turn) AS cleared_at FROM conversations WHERE role = 'system' GROUP BY ALL)"),
    "eval_judged": _with(f"SELECT question_id, {ROUNDED.format('').replace('round((faithfulness), 6)', 'CASE WHEN length(question) % 5 <> 0 THEN round(faithfulness, 6) END')} "
                         "FROM scores JOIN (SELECT qid AS question_id, question FROM er) USING (question_id)", *EVALUATION),
    "eval_refused": _with(
        "SELECT 'statement' AS kind, NULL AS error, count(*) AS n, sum(v)::BIGINT AS n_accepted FROM averd JOIN er USING (qid) WHERE length(question) % 5 <> 0 HAVING count(*) > 0 "
        "UNION ALL SELECT 'statement', 'refused', count(*), NULL FROM er WHERE length(question) % 5 = 0 HAVING count(*) > 0 "
        "UNION ALL SELECT 'sentence', NULL, count(*), sum(v) FROM gverd HAVING count(*) > 0 "
        "UNION ALL SELECT 'context', NULL, count(*), sum(coalesce(v, 0)) FROM (SELECT DISTINCT qid, rank FROM ctx) LEFT JOIN cverd USING (qid, rank) HAVING count(*) > 0 "
        f"UNION ALL SELECT 'question', NULL, count(*), sum((answer = '{NO_RESULTS}')::INT) FROM asent JOIN er USING (qid) HAVING count(*) > 0", *EVALUATION),
    "knn_ivf_labels": _with(
        f"SELECT query_id, doc_id, rank, round(1.0::DOUBLE / (1.0::DOUBLE + cost), 6) AS score, cost AS distance FROM ranked WHERE rank <= {TOP_K}",
        "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)",
        "means AS (SELECT label, list(m ORDER BY i) AS m FROM (SELECT label, i, avg(e[i]) AS m FROM (SELECT label, e, unnest(range(1, 65)) AS i FROM v) GROUP BY ALL) GROUP BY label)",
        "near AS (SELECT vec_id, c.label AS list, row_number() OVER (PARTITION BY vec_id ORDER BY list_distance(e, m), c.label) AS n FROM v, means c)",
        f"pairs AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, {COST['l2']} AS cost FROM near p JOIN near l ON p.list = l.list AND p.n <= 4 AND l.n = 1 "
        "JOIN v q ON q.vec_id = p.vec_id JOIN v d ON d.vec_id = l.vec_id)",
        "ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cost, doc_id) AS rank FROM pairs)"),
    "knn_own_filters": _knn("l2", "inverse", pairs="(d.label > q.vec_id % 7 + 2 OR d.vec_id < q.vec_id) AND d.vec_id <> q.vec_id"),
    "knn_filter_operators": _knn("l2", "inverse", pairs="CASE q.vec_id % 4 WHEN 0 THEN d.label >= 3 AND d.label < 7 "
                                 "WHEN 1 THEN d.label = 1 OR d.label > 7.5 WHEN 2 THEN d.label NOT IN (0, 2, 4) ELSE true END"),
    "filter_typed": """
        SELECT event_id, CASE event_id % 3 WHEN 0 THEN m + 0.5 > 10 WHEN 1 THEN m > 10 ELSE false END AS int_as_double,
               CASE event_id % 3 WHEN 0 THEN m = 30 WHEN 1 THEN m = 10 ELSE m = 20 END AS in_mixed,
               m = 10 AS text, false AS no_text, event_id % 2 = 0 AS flag, event_id % 10 <= 5 AS dotted, true AS absent
        FROM (SELECT event_id, event_id % 40 AS m FROM events)""",
    "history_cleared": _with(SEEN.format("conv_id, epoch", "spoken"),
                             "spoken AS (SELECT *, (SELECT count(DISTINCT s.turn) FROM conversations s WHERE s.role = 'system' AND s.conv_id = c.conv_id AND s.turn < c.turn) AS epoch "
                             "FROM conversations c)"),
    "token_estimate": f"SELECT conv_id, turn, n_chars, n_chars // 4 AS est_tokens FROM ({HISTORY} conversations)",
    "token_totals": "SELECT conv_id, count(*) AS n_messages, sum(length(text))::BIGINT AS n_chars, "
                    "(sum(length(text)) // 4)::BIGINT AS est_tokens FROM conversations GROUP BY conv_id",
    "workflow_sequential": _with(
        f"SELECT request_id, coalesce(e1, e2, e3) IS NULL AS success, coalesce(e1, e2, e3) AS error, "
        f"'cleaner:clean:' || {DONE.format('e1')} || CASE WHEN e1 IS NULL THEN ';checker:check:' || {DONE.format('e2')} ELSE '' END "
        f"|| CASE WHEN e1 IS NULL AND e2 IS NULL THEN ';counter:count:' || {DONE.format('e3')} ELSE '' END AS log, "
        "CASE WHEN e1 IS NULL THEN c1 ELSE '' END AS out_cleaner, CASE WHEN e1 IS NULL AND e2 IS NULL THEN c2 ELSE '' END AS out_checker, "
        "CASE WHEN e1 IS NULL AND e2 IS NULL AND e3 IS NULL THEN c3 ELSE '' END AS out_counter FROM seq", *SEQUENTIAL),
    "workflow_parallel": _with(
        f"SELECT request_id, coalesce(e1, e2, e3) IS NULL AS success, coalesce(e1, e2, e3) AS error, "
        f"'cleaner:clean:' || {DONE.format('e1')} || ';checker:check:' || {DONE.format('e2')} || ';counter:count:' || {DONE.format('e3')} AS log, "
        "CASE WHEN e1 IS NULL THEN c1 ELSE '' END AS out_cleaner, CASE WHEN e2 IS NULL THEN c2 ELSE '' END AS out_checker, "
        "CASE WHEN e3 IS NULL THEN c3 ELSE '' END AS out_counter FROM par", *PARALLEL),
    "workflow_log": _with(
        "SELECT request_id, 0::BIGINT AS step_idx, 'cleaner' AS agent, 'clean' AS action, e1 IS NULL AS success, "
        "sha256(CASE WHEN e1 IS NULL THEN c1 ELSE '' END) AS output_key FROM seq "
        "UNION ALL SELECT request_id, 1, 'checker', 'check', e2 IS NULL, sha256(CASE WHEN e2 IS NULL THEN c2 ELSE '' END) FROM seq WHERE e1 IS NULL "
        "UNION ALL SELECT request_id, 2, 'counter', 'count', e3 IS NULL, sha256(CASE WHEN e3 IS NULL THEN c3 ELSE '' END) FROM seq WHERE e1 IS NULL AND e2 IS NULL",
        *SEQUENTIAL),
    "workflow_rag": _with(
        "SELECT request_id, success, CASE WHEN success THEN answer ELSE '' END AS answer, "
        "CASE WHEN success THEN retrieved_info ELSE '' END AS retrieved_context, "
        "CASE WHEN success THEN 'retriever:retrieve:true;generator:generate:true' ELSE 'retriever:retrieve:false' END AS log, "
        f"CASE WHEN NOT success THEN {INVALID} END AS error FROM rag", *RAG),
    "eval_metrics": _with(f"SELECT question_id, {ROUNDED.format('')} FROM scores", *EVALUATION),
    "eval_replies": _with(f"SELECT question_id, {ROUNDED.format('')} FROM scores", *REPLIES),
    "eval_summary": _with(f"SELECT count(*) AS n_questions, {ROUNDED.format('avg')} FROM scores", *EVALUATION),
    "eval_runs": _with("SELECT count(*) FILTER (WHERE question <> '') AS n_evaluated, "
                       "count(*) FILTER (WHERE question = '') AS n_skipped FROM asked", RAG_QUESTIONS),
    "stream_ingest": _updated(UPSERTED, UPSERTED, "doc_id::VARCHAR"),
    "stream_tokens": "SELECT conv_id, count(*) AS n_messages, sum(length(text))::BIGINT AS n_chars, "
                     "(sum(length(text)) // 4)::BIGINT AS est_tokens FROM conversations GROUP BY conv_id",
}
