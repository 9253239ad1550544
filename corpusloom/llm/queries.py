"""The operators of this subpackage as queries over the given tables: name -> (spark, folder) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusloom.llm import bpe, codebooks, decontaminate, fm_index, language, licenses, main_text, merkle, mtree, neardup, suffix_array, toxicity, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@_query
def op1_bpe(spark: SparkSession, sf: str) -> DataFrame:
    """Token ids of every document and the text that they decode to, as digests."""
    tokens = bpe.round_trip(_table(spark, sf, "documents"), tokenizer_path())
    return tokens.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                         F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
                         F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


@_query
def op3_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    """Words of every document that lie in a passage of ten words of a benchmark item."""
    found = decontaminate.find_passages(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"), window=10)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["last"] - x["first"] + 1)
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


_WORDS = r"[^\x{0}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE["op3_decontaminate"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{_WORDS}') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({_LOWER}, '{_WORDS}') AS w FROM benchmark WHERE item_id IS NOT NULL),
p AS (SELECT DISTINCT item_id, w[i:i + least(len(w), 10) - 1] AS g, least(len(w), 10) AS k
      FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
g AS (SELECT r, k, i, w[i:i + k - 1] AS g
      FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM p) WHERE len(w) >= k)),
h AS (SELECT g.r, g.i, g.k, p.item_id FROM g JOIN p ON g.k = p.k AND g.g = p.g),
n AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS j FROM h) GROUP BY r),
t AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM h GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN t USING (r)
"""


def _fold(column: str, folds: int):
    return F.crc32(F.col(column).cast("string")) % folds


@_query
def op7_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """Toxicity of every document; rows of fold 0 of 5 are held out."""
    docs = _table(spark, sf, "documents")
    model = toxicity.fit(docs, _table(spark, sf, "labels").filter(_fold("doc_id", 5) != 0))
    return toxicity.score(docs, model).select("doc_id", (_fold("doc_id", 5) == 0).alias("held_out"), "score",
                                              (F.col("score") >= 0.5).cast("int").alias("predicted"))


@_query
def op9_language(spark: SparkSession, sf: str) -> DataFrame:
    """Language of every document; rows of fold 1 of 3 are held out."""
    docs = _table(spark, sf, "documents")
    model = language.fit(docs.filter(_fold("doc_id", 3) != 1))
    return language.predict(docs, model).select("doc_id", (_fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


@_query
def op2_minhash(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of near-duplicate documents: shingles of two words, similarity 0.8."""
    return neardup.near_duplicates(_table(spark, sf, "documents"), shingle=2, percent=80)


ORACLE["op2_minhash"] = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x{{20}}\\x{{09}}-\\x{{0D}}]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 2 THEN [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]
                                        WHEN len(w) = 1 THEN w ELSE [] END) AS s FROM w),
c AS (SELECT list_sort(s) AS k, any_value(s) AS s, min(doc_id) AS id FROM s WHERE len(s) > 0 GROUP BY 1),
e AS (SELECT id, len(s) AS n, unnest(s) AS t FROM c),
p AS (SELECT a.id AS a, b.id AS b FROM e a JOIN e b ON a.t = b.t AND a.id < b.id AND b.n <= a.n * 1.25 AND a.n <= b.n * 1.25
      GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
u AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT id, id AS root FROM c UNION SELECT u.b, r.root FROM r JOIN u ON r.id = u.a),
m AS (SELECT id, min(root) AS root FROM r GROUP BY id)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(m.root, s.doc_id) AS component_id, s.doc_id = coalesce(m.root, s.doc_id) AS kept
FROM s LEFT JOIN c ON list_sort(s.s) = c.k LEFT JOIN m ON m.id = c.id
"""


@_query
def op10_suffix_array(spark: SparkSession, sf: str) -> DataFrame:
    """Every document without the strings of 50 bytes that also start in an earlier one."""
    cut = suffix_array.cut_repeated_bytes(_table(spark, sf, "documents"), window=50)
    return cut.select("doc_id", F.col("n_symbols").alias("n_bytes"), "n_removed", F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


@_query
def op6_fm_index(spark: SparkSession, sf: str) -> DataFrame:
    """Every document without the windows of 13 words that also start in an earlier one."""
    cut = fm_index.cut_repeated_words(_table(spark, sf, "documents"), window=13)
    return cut.select("doc_id", F.col("n_symbols").alias("n_words"), "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@_query
def op8_licenses(spark: SparkSession, sf: str) -> DataFrame:
    """License phrases of every document, and labels of the templates that its windows of words hold."""
    found = licenses.scan(_table(spark, sf, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.concat_ws(",", "base_labels").alias("base_labels"),
                        F.concat_ws(",", "labels").alias("labels"), "score")


def _values(rows: list[tuple[str, str]]) -> str:
    return ", ".join(f"('{a}', '{b}')" for a, b in rows)


ORACLE["op8_licenses"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all({_LOWER}, '{_WORDS}') AS w FROM documents),
p AS (SELECT string_split(phrase, ' ') AS p, label FROM (VALUES {_values(licenses.PHRASES)}) AS x(phrase, label)),
h AS (SELECT r, i - 1 AS i, label
      FROM (SELECT r, w, p, label, unnest(range(1, len(w) - len(p) + 2)) AS i FROM d, p WHERE len(w) >= len(p)) WHERE w[i:i + len(p) - 1] = p),
b AS (SELECT r, count(*) AS n, min(i) AS f, max(i) AS l, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM h GROUP BY r),
t AS (SELECT label, list_distinct(string_split(words, ' ')) AS t, len(string_split(words, ' ')) AS n FROM (VALUES {_values(licenses.TEMPLATES)}) AS x(label, words)),
s AS (SELECT r, w, label, t, n FROM d, t WHERE 100 * len(list_intersect(list_distinct(w), t)) >= {licenses.PERCENT} * len(t)),
m AS (SELECT r, label, len(list_intersect(w[i:i + n - 1], t)) / len(t) AS share FROM (SELECT *, unnest(range(1, greatest(len(w) - n + 1, 1) + 1)) AS i FROM s)
      WHERE 100 * len(list_intersect(w[i:i + n - 1], t)) >= {licenses.PERCENT} * len(t)),
a AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM m UNION SELECT r, label FROM h) GROUP BY r),
k AS (SELECT r, max(share) AS share FROM m GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(f AS BIGINT) AS first_word, CAST(l AS BIGINT) AS last_word,
       coalesce(b.labels, '') AS base_labels, coalesce(a.labels, '') AS labels, CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0::DOUBLE) END AS score
FROM d LEFT JOIN b USING (r) LEFT JOIN a USING (r) LEFT JOIN k USING (r)
"""


@_query
def op5_mtree(spark: SparkSession, sf: str) -> DataFrame:
    """The five largest inner products of every 50th vector with all others."""
    vectors = _table(spark, sf, "embeddings").select("vec_id", mtree.quantised(F.col("embedding")).alias("vector"))
    return mtree.top_k(mtree.build(vectors), vectors.filter("vec_id % 50 = 0"), 5)


ORACLE["op5_mtree"] = """
WITH v AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
z AS (SELECT vec_id, i, CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM v),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
      FROM z q JOIN z c ON q.i = c.i AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 GROUP BY ALL)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 5
"""


@_query
def op4_main_text(spark: SparkSession, sf: str) -> DataFrame:
    """The article text of every page."""
    pages = _table(spark, sf, "pages")
    found = main_text.extract(pages, main_text.fit(pages))
    return found.withColumn("n_chars", F.length("text").cast("long"))


@_query
def op12_merkle(spark: SparkSession, sf: str) -> DataFrame:
    """Digests of every document, of its language and of the whole table, with what remains of the proof after tampering."""
    docs = _table(spark, sf, "documents")
    tampered = (_fold("doc_id", 7) == 0) & F.col("n_chars").isNotNull()
    rows = merkle.manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], "lang", "doc_id",
                           {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}, tampered)
    rows = rows.withColumn("folded_root", merkle.folded(F.coalesce("altered", "leaf"), F.col("path")))
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(F.concat_ws("", "path.digest"), 256).alias("proof_sha256"),
                       "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _field(column: str) -> str:
    return f"coalesce(strlen(CAST({column} AS VARCHAR)) || ':' || CAST({column} AS VARCHAR), '-')"


def _leaf(n_chars: str) -> str:
    return f"sha256(concat({_field('doc_id')}, {_field('source')}, {_field('lang')}, {_field(n_chars)}, {_field('text')}))"


# The CRC-32 of a decimal number, bit by bit.
_BITS = "flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: list_transform(range(8), lambda k: (ascii(x) >> k) & 1)))"
_CRC32 = f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {_BITS}), lambda c, b: xor(c >> 1, CASE WHEN xor(c & 1, b) = 1 THEN 3988292384 ELSE 0 END)))"


def _tree(name: str, leaves: str) -> str:
    """Nodes of all levels of the trees of a table (t, i, d, n): nodes with the same t, numbered from 0, their digests, and how many there are."""
    return f"""{name} AS (SELECT 0 AS l, t, i, d, n FROM {leaves} UNION ALL
           SELECT l + 1, t, i // 2, sha256(string_agg(d, '' ORDER BY i)), (any_value(n) + 1) // 2 FROM {name} WHERE n > 1 GROUP BY l, t, i // 2)"""


ORACLE["op12_merkle"] = f"""
WITH RECURSIVE r AS (SELECT doc_id, lang, {_leaf('n_chars')} AS leaf,
    CASE WHEN {_CRC32} % 7 = 0 THEN {_leaf('(n_chars + 1)')} END AS altered FROM documents),
b AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n,
      dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS t FROM r),
x AS (SELECT t, i, leaf AS d, n FROM b),
{_tree('low', 'x')},
y AS (SELECT 0 AS t, t AS i, d, count(*) OVER () AS n FROM low WHERE n = 1),
{_tree('high', 'y')},
p AS (SELECT b.t, b.i, m.l AS step, m.i & 1 AS odd, o.d FROM b JOIN low m ON m.t = b.t AND m.i = b.i >> m.l AND m.n > 1
      LEFT JOIN low o ON o.t = m.t AND o.l = m.l AND o.i = xor(m.i, 1)
      UNION ALL
      SELECT b.t, b.i, 100 + m.l AS step, m.i & 1 AS odd, o.d FROM b JOIN high m ON m.i = b.t >> m.l AND m.n > 1
      LEFT JOIN high o ON o.l = m.l AND o.i = xor(m.i, 1)),
q AS (SELECT *, row_number() OVER (PARTITION BY t, i ORDER BY step) AS k FROM p),
f AS (SELECT t, i, 0 AS k, coalesce(altered, leaf) AS d FROM b UNION ALL
      SELECT f.t, f.i, f.k + 1, sha256(CASE WHEN odd = 1 THEN q.d || f.d ELSE f.d || coalesce(q.d, '') END) FROM f JOIN q ON q.t = f.t AND q.i = f.i AND q.k = f.k + 1),
z AS (SELECT t, i, arg_max(d, k) AS folded FROM f GROUP BY t, i),
w AS (SELECT t, i, string_agg(d, '' ORDER BY k) AS proof FROM q GROUP BY t, i)
SELECT doc_id, leaf, y.d AS subroot, h.d AS root, sha256(coalesce(proof, '')) AS proof_sha256, folded AS folded_root, folded = h.d AS verified
FROM b JOIN y ON y.i = b.t JOIN (SELECT d FROM high WHERE n = 1) h ON true JOIN z ON z.t = b.t AND z.i = b.i LEFT JOIN w ON w.t = b.t AND w.i = b.i
"""


#: Host and path rules; fixed values.
URL_RULES = [url_filter.Rule("com", "/", "allow"), url_filter.Rule("example.com", "/en/", "block"), url_filter.Rule("www.example.com", "/en/", "allow"),
             url_filter.Rule("net", "/es/", "block"), url_filter.Rule("net", "/fr/", "block")]


@_query
def op13_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Verdict on the URL of every page: the longest rule's, else that of a classifier trained on a small labelled table."""
    model = url_filter.fit(url_filter.labelled_urls(spark))
    return url_filter.judge(_table(spark, sf, "pages"), URL_RULES, model)


@_query
def op11_codebooks(spark: SparkSession, sf: str) -> DataFrame:
    """Codes of every vector in eight codebooks of sixteen entries, with their errors."""
    return codebooks.compress(_table(spark, sf, "embeddings").withColumnRenamed("embedding", "vector"))


def _codebook_sql(rounds: int) -> str:
    """Rounds of assigning parts to entries and moving the entries, one after the other; components of a part are one row each."""
    steps = []
    for n in range(rounds + 1):
        steps.append(f"""a{n} AS MATERIALIZED (SELECT r, p, arg_min(e, k) AS e, min(s) AS s FROM (SELECT *, row_number() OVER (PARTITION BY r, p ORDER BY s, e) AS k FROM (
            SELECT z.r, z.p, c.e, sum((z.x - c.x) * (z.x - c.x)) AS s FROM z JOIN c{n} c ON z.p = c.p AND z.i = c.i GROUP BY ALL)) GROUP BY r, p)""")
        if n < rounds:
            steps.append(f"""c{n + 1} AS MATERIALIZED (SELECT c.p, c.e, c.i, coalesce(m.x, c.x) AS x FROM c{n} c LEFT JOIN (
            SELECT a.p, a.e, z.i, (sum(z.x) - ((sum(z.x) % count(*)) + count(*)) % count(*)) // count(*) AS x FROM a{n} a JOIN z ON z.r = a.r AND z.p = a.p GROUP BY ALL) m
            ON m.p = c.p AND m.e = c.e AND m.i = c.i)""")
    return ",\n".join(steps)


ORACLE["op11_codebooks"] = f"""
WITH v AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS r, vec_id, label, embedding FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
z AS MATERIALIZED (SELECT r, (i - 1) * 8 // n AS p, i, x FROM (SELECT r, len(embedding) AS n, generate_subscripts(embedding, 1) AS i,
                   unnest(list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS HUGEINT))) AS x FROM v)),
c0 AS (SELECT p, r AS e, i, x FROM z WHERE r < 16),
{_codebook_sql(codebooks.ROUNDS)},
w AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(s) AS BIGINT) AS error FROM a{codebooks.ROUNDS} GROUP BY r),
h AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM c{codebooks.ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN w USING (r) JOIN h ON true
"""
