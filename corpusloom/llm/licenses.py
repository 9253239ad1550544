"""License texts in documents: phrases, and an exact set-similarity join of text blocks with templates.

A block is a window of as many consecutive words as the template has, wherever lines break (a shorter document is one block), taken as a
set of words. A block matches a template if it holds at least a given share of the template's words. Overlapping stretches of two chunks hold every window, and each window of a
stretch that passes the filters as a whole is verified by itself. Template words are ordered by their frequency in the whole corpus, rarest first. A block that
reaches the threshold must hold one of the first few (the prefix), must have enough words (length), and what is left of both
sets behind the first common word must suffice (position). What passes is verified on the full sets. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

#: Phrases and labels, as words in lower case.
PHRASES = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]
#: Sentences of public licences and common notices: label, words in lower case.
TEMPLATES = [
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "released under the mit license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
]
PERCENT = 90
NOT_WORDS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def plain(text: Column) -> Column:
    """The words of a text, joined by one space; their letters as they are."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), NOT_WORDS, " "))


def _spaces(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("long")


def _words(text: Column) -> Column:
    """A-Z in lower case; the set of words of a text without any is empty."""
    return F.array_remove(F.array_distinct(F.split(F.translate(text, UPPER, LOWER), " ", -1)), "")


def phrase_places(words: Column, n_words: Column, phrases: Sequence[tuple[str, str]]) -> list[tuple[str, Column, Column, Column]]:
    """For each phrase: its label, number of places, first and last start in ``words`` (as ``plain`` gives them)."""
    exact = F.concat(F.lit(" "), F.replace(F.translate(words, UPPER, LOWER), F.lit(" "), F.lit("  ")), F.lit(" "))
    out = []
    for phrase, label in phrases:
        own = " " + phrase.replace(" ", "  ") + " "
        maybe = F.contains(F.lower(words), F.lit(phrase)) & F.contains(exact, F.lit(own))
        n = (F.length(exact) - F.length(F.replace(exact, F.lit(own), F.lit("")))) / len(own)
        first = _spaces(F.substring_index(exact, own, 1)) / 2
        last = n_words - _spaces(F.substring_index(exact, own, -1)) / 2 - len(phrase.split(" "))
        out.append((label, F.when(maybe, n).otherwise(0).cast("long"), F.when(maybe, first).cast("long"), F.when(maybe, last).cast("long")))
    return out


def _stretches(docs: DataFrame, sets: Sequence[tuple[str, list[str], int]], prefix: Sequence[str], vocabulary: Sequence[str], percent: int) -> DataFrame:
    """Stretches of words that hold every window: ``doc_id``, ``key``, ``block`` (set of words), ``words`` (in order).

    Only documents that hold enough words of some template are cut.
    """
    size = max(n for _, _, n in sets)
    docs = docs.select("doc_id", F.xxhash64("text").alias("key"), F.translate(plain(F.col("text")), UPPER, LOWER).alias("text"))
    # An exploded array of one element is computed once, however often it is used.
    docs = docs.select("*", F.explode(F.array(F.array_intersect(F.split("text", " ", -1), F.lit(vocabulary)))).alias("held"))
    enough = F.lit(False)
    for _, own, _ in sets:
        enough = enough | (100 * F.size(F.array_intersect("held", F.lit(own))) >= percent * len(own))
    docs = docs.filter(F.arrays_overlap("held", F.lit(prefix))).filter(enough)
    chunks = docs.select("doc_id", "key", F.explode(F.array(F.regexp_extract_all("text", F.lit(f"(?:[^ ]++ ?){{1,{size}}}"), F.lit(0)))).alias("chunks"))
    both = F.zip_with("chunks", F.slice("chunks", 2, F.greatest(F.size("chunks"), F.lit(1))), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    words = chunks.select("doc_id", "key", F.explode(both).alias("text")).select("doc_id", "key", F.explode(F.array(F.split(F.trim("text"), " ", -1))).alias("words"))
    return words.select("doc_id", "key", F.array_distinct("words").alias("block"), "words")


def matching_blocks(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, percent: int = PERCENT) -> DataFrame:
    """``doc_id``, ``key`` (hash of the text), ``label``, ``score`` (largest share of the template's words) of every matching stretch of words."""
    spark = docs.sparkSession
    sets = [(label, sorted(set(text.split(" "))), len(text.split(" "))) for label, text in templates]
    vocabulary = sorted({w for _, words, _ in sets for w in words})
    # One count for each template word: as many rows as there are template words reach the driver.
    words = docs.select(F.explode(F.array_intersect(F.split(F.translate(plain(F.col("text")), UPPER, LOWER), " ", -1), F.lit(vocabulary))).alias("word"))
    counts = dict(words.groupBy("word").count().collect())
    order = sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    rows = []
    for label, own, width in sets:
        own = sorted(own, key=rank.__getitem__)
        need = -(-percent * len(own) // 100)
        rows += [(label, own, width, need, i, w) for i, w in enumerate(own[:len(own) - need + 1])]
    prefix = sorted({r[5] for r in rows})
    least = min(r[3] for r in rows)
    table = F.broadcast(spark.createDataFrame(rows, "label string, template array<string>, width int, need int, place int, word string"))
    # Only blocks with a prefix word and enough words go on.
    blocks = _stretches(docs, sets, prefix, vocabulary, percent).filter((F.size("block") >= least) & F.arrays_overlap("block", F.lit(prefix)))
    known = F.create_map(*(x for w in vocabulary for x in (F.lit(w), F.lit(rank[w]))))
    blocks = blocks.withColumn("known", F.array_sort(F.transform(F.array_intersect("block", F.lit(vocabulary)), lambda w: known[w])))
    pairs = blocks.withColumn("word", F.explode(F.array_intersect("block", F.lit(prefix)))).join(table, "word")
    left = F.least(F.size("template") - F.col("place"), F.size("known") - F.array_position("known", known[F.col("word")]) + 1)
    whole = F.size(F.array_intersect("block", "template"))
    pairs = pairs.filter((F.size("block") >= F.col("need")) & (left >= F.col("need") - F.col("place"))).filter(whole >= F.col("need"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - F.col("width") + 1, F.lit(1)))
    window = F.array_max(F.transform(starts, lambda i: F.size(F.array_intersect(F.slice("words", i, F.col("width")), F.col("template")))))
    pairs = pairs.select("doc_id", "key", "label", "need", F.size("template").alias("size"),
                         F.explode(F.array(window)).alias("common"))
    return pairs.filter("common >= need").select("doc_id", "key", "label", (F.col("common") / F.col("size")).alias("score"))


def scan(docs: DataFrame, phrases: Sequence[tuple[str, str]] = PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES, percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs`` (``doc_id``, ``text``): ``doc_id``, ``n_words``, ``n_base`` (places of all phrases), ``first_word``, ``last_word``
    (smallest and largest start, null without a place), ``base_labels`` and ``labels`` (arrays, sorted), ``score``: 1 if a phrase
    stands in the text, else the largest share of a template's words in a matching window, else 0.

    A null or empty text has no words. Rows that repeat an id are scanned each by itself, and so are rows without id. Other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    found = (matching_blocks(docs, templates, percent).groupBy("doc_id", "key")
             .agg(F.collect_set("label").alias("more"), F.max("score").alias("share")))
    words = docs.select("doc_id", F.xxhash64("text").alias("key"), plain(F.col("text")).alias("words"))
    words = words.withColumn("n_words", F.when(F.col("words") == "", 0).otherwise(_spaces(F.col("words")) + 1).cast("long"))
    places = phrase_places(F.col("words"), F.col("n_words"), phrases)
    maybe = F.lit(False)
    for phrase, _ in phrases:
        maybe = maybe | F.contains(F.lower("words"), F.lit(phrase))
    labels = F.array_compact(F.array(*(F.when(n > 0, F.lit(label)) for label, n, _, _ in places)))
    base = words.select(
        "doc_id", "key", "n_words",
        F.when(maybe, F.struct(sum((n for _, n, _, _ in places[1:]), places[0][1]).alias("n"), F.array_min(F.array(*(f for _, _, f, _ in places))).alias("first"),
                               F.array_max(F.array(*(x for *_, x in places))).alias("last"), F.array_sort(F.array_distinct(labels)).alias("labels"))).alias("base"))
    none = F.array().cast("array<string>")
    rows = base.join(found, base.doc_id.eqNullSafe(found.doc_id) & (base.key == found.key), "left").select(base.doc_id, "n_words", "base", "more", "share")
    return rows.select(
        "doc_id", "n_words", F.coalesce("base.n", F.lit(0).cast("long")).alias("n_base"), F.col("base.first").alias("first_word"), F.col("base.last").alias("last_word"),
        F.coalesce("base.labels", none).alias("base_labels"),
        F.array_sort(F.array_union(F.coalesce("base.labels", none), F.coalesce("more", none))).alias("labels"),
        F.when(F.col("base.n") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"))
