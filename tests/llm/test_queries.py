import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import queries
from corpusloom.session import written

TABLES = ("documents", "embeddings", "pages", "benchmark", "labels")


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, sf, name):
    for table in TABLES:
        duckdb.sql(f"CREATE OR REPLACE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    got = queries.QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    want = duckdb.sql(queries.ORACLE[name])
    assert columns == sorted(want.columns)
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, want.select(*(f'"{c}"' for c in columns)).fetchall()))


def test_all_are_registered():
    assert [n.split("_")[0] for n in sorted(queries.QUERIES, key=lambda n: int(n[2:].split("_")[0]))] == [f"op{i}" for i in range(1, 14)]


def awkward_folder(spark, tmp_path, awkward, items):
    """The tables of a pipeline made of awkward documents."""
    folder = str(tmp_path / "tables")
    awkward.write.parquet(f"{folder}/documents.parquet")
    awkward.selectExpr("doc_id", "cast(doc_id in (6, 7, 16) as int) as toxic", "1 as quality", "'clash' as text").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'clash' as doc_id").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def check_stages(spark, folder, docs):
    """Each stage against what its decisions should be by brute force, on what the stage before has kept."""
    from corpusloom.llm import toxicity

    from .test_classifiers import plain_grams
    from .test_decontaminate import brute as passages
    from .test_neardup import brute as groups
    from .test_repeats import brute as repeats

    def rows_of(df):
        return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)

    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    rows = rows_of(docs)
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, folder), "stage")
        after = rows_of(out)
        if name == "toxicity":
            labels = spark.read.parquet(f"{folder}/labels.parquet").filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
            model = toxicity.fit(docs, labels)
            weights = dict(zip(model.grams.tolist(), model.weights.tolist(), strict=True))
            hashed = {}
            for _, text in rows:
                for g in plain_grams(text) - hashed.keys():
                    # One n-gram by itself: its hash is the one at its own first place, behind the edge.
                    data, offsets = toxicity.characters(pa.array([g]))
                    hashed[g] = next(int(h[at == 1][0]) for (h, at), n in zip(toxicity.grams(data, offsets), toxicity.ORDERS, strict=True) if n == len(g))
            kept = [(i, t) for i, t in rows if sum(weights.get(hashed[g], 0.0) for g in plain_grams(t)) + model.intercept < 0]
            assert after == kept
        elif name == "near_duplicates":
            found = groups(rows, 5)
            assert sorted((i for i, _ in after), key=repr) == sorted((i for i, _, _, kept in found if kept), key=repr) and set(after) <= set(rows)
        elif name == "suffix_array":
            want = repeats(rows, False, 50)
            assert len(after) == len(rows)
            for (i, text), (j, _, n, _, kept) in zip(sorted(after, key=lambda r: repr(r[0])), sorted(want, key=lambda r: repr(r[0])), strict=True):
                # A character goes with any of its bytes.
                assert i == j and text.encode() == (kept.decode(errors="ignore").encode() if n else kept)
            assert all(r.n_chars == len(r.text) for r in out.collect())
        elif name == "decontamination":
            assert sorted((i for i, _ in after), key=repr) == sorted((i for i, _, hit, _ in passages(rows, items, 10) if not hit), key=repr) and set(after) <= set(rows)
        else:
            assert after == [(i, t or "") for i, t in rows] and all(len(r.ids) == r.n_tokens for r in out.collect())
        if name != "bpe":
            assert sorted(out.columns) == sorted(corpus_pipeline.COLUMNS)
        docs, rows = out, after
    return rows


def test_pipeline_stages(spark, sf):
    assert check_stages(spark, sf, spark.read.parquet(f"{sf}/documents.parquet"))


def test_pipeline_of_awkward_rows(spark, tmp_path, awkward):
    """Nulls, empty and very long texts, repeated ids and rows, and columns of clashing names."""
    folder = awkward_folder(spark, tmp_path, awkward, [(1, " ".join(f"p{i}" for i in range(20, 40))), (None, "one two"), (2, None), (3, "x1")])
    assert check_stages(spark, folder, spark.read.parquet(f"{folder}/documents.parquet"))


def test_pipeline_of_empty_tables(spark, tmp_path, no_rows):
    folder = awkward_folder(spark, tmp_path, no_rows, [])
    assert corpus_pipeline.run(spark, folder).collect() == []
