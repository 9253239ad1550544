import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import merkle

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, n_chars):
    values = [n_chars if c == "n_chars" else row[c] for c in COLUMNS]
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(leaves):
    """Root, and the path of each leaf as (whether the sibling is on the left, sibling or None)."""
    paths, nodes, own = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(nodes) > 1:
        for i, at in enumerate(own):
            other = at ^ 1
            paths[i].append((at & 1, nodes[other] if other < len(nodes) else None))
        nodes = [h(*nodes[i:i + 2]) for i in range(0, len(nodes), 2)]
        own = [at // 2 for at in own]
    return nodes[0], paths


def brute(rows, altered):
    groups = {}
    for row in rows:
        groups.setdefault(row["lang"], []).append(row)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    subs, paths = {}, {}
    for lang in langs:
        groups[lang].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r, r["n_chars"])))
        subs[lang], paths[lang] = tree([leaf_of(r, r["n_chars"]) for r in groups[lang]])
    root, above = tree([subs[x] for x in langs])
    out = []
    for lang, upper in zip(langs, above, strict=True):
        for row, path in zip(groups[lang], paths[lang], strict=True):
            leaf = leaf_of(row, row["n_chars"])
            d = leaf_of(row, altered(row)) if altered(row) is not None else leaf
            for left, other in path + upper:
                d = h(d) if other is None else h(other, d) if left else h(d, other)
            out.append((row["doc_id"], leaf, subs[lang], root, h(*(o for _, o in path + upper if o)), d))
    return sorted(out, key=repr)


def tampered(row):
    if row["n_chars"] is None or row["doc_id"] is None or zlib.crc32(str(row["doc_id"]).encode()) % 7:
        return None
    return row["n_chars"] + 1


def run(docs):
    out = merkle.manifest(docs, COLUMNS, "lang", "doc_id", {"n_chars": F.col("n_chars") + 1}, (F.crc32(F.col("doc_id").cast("string")) % 7 == 0) & F.col("n_chars").isNotNull())
    out = out.select("doc_id", "leaf", "subroot", "root", F.sha2(F.concat_ws("", "path.digest"), 256), merkle.folded(F.coalesce("altered", "leaf"), F.col("path")))
    return sorted((tuple(r) for r in out.collect()), key=repr)


def test_awkward_rows(awkward):
    rows = [r.asDict() for r in awkward.select(*COLUMNS).collect()]
    assert run(awkward) == brute(rows, tampered)


def test_no_rows(no_rows):
    assert run(no_rows) == []


@pytest.mark.parametrize("n", [1, 2, 3, 7, 17])
def test_small_blocks(spark, monkeypatch, n):
    """Trees of several rounds of blocks of four, some ending in lone nodes; one of many groups."""
    monkeypatch.setattr(merkle, "LEVELS", 2)
    monkeypatch.setattr(merkle, "BLOCK", 4)
    rows = [dict(zip(COLUMNS, (i * 3, "s", lang, i, f"t{i}"), strict=True)) for lang in (None, "", "b", "é", "中") for i in range(n)]
    rows += [dict(zip(COLUMNS, (i, None, f"g{i}", None, None), strict=True)) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(3)
    assert run(docs) == brute(rows, tampered)


def test_numbers_run_on_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(merkle, "TASK_ROWS", 7)
    rows = spark.range(60).select(F.when(F.col("id") % 5 == 0, "a").otherwise("b").alias("tree"), (F.col("id") % 40).alias("order"), F.sha2(F.col("id").cast("string"), 256).cast("binary").alias("digest"))
    got = merkle.numbered(rows, "t").collect()
    for name in ("a", "b"):
        own = sorted((r.position, r.order, bytes(r.digest), r.size) for r in got if r.tree == name)
        assert [p for p, *_ in own] == list(range(own[0][3])) and [x[1:3] for x in own] == sorted(x[1:3] for x in own)


def test_a_changed_leaf_is_found(spark, sf):
    from corpusloom.llm.queries import QUERIES

    rows = QUERIES["op12_merkle"](spark, sf).collect()
    docs = {r.doc_id: r.n_chars for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert all(r.verified == (docs[r.doc_id] is None or zlib.crc32(str(r.doc_id).encode()) % 7 != 0) for r in rows)
    assert {r.verified for r in rows} == {True, False}
