import random

import pytest

KIND = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns with names that the operators use inside.
CLASH = ("key", "kept", "spans", "id", "ids", "bucket", "score", "label", "words", "toxic", "component", "letter", "_text", "_row")


def awkward_rows():
    rng = random.Random(3)
    words = ["the", "an", "of", "ring", "über", "naïve", "東京", "x1", "Idiot", "moron", "mit", "license", "MIT", "License", "gnu"]
    long = " ".join(rng.choice(words) + str(rng.randrange(400)) for _ in range(9000))
    base = " ".join(f"w{i}" for i in range(120))
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "one"), (5, "one two"), (6, long), (7, long), (8, base), (9, base + " tail"),
            (10, "head " + base + " tail"), (11, f"a b c {passage} d e f"), (12, f"g {passage} h"), (13, passage), (14, "ÀÉ ß  <|endoftext|> x"),
            (15, "1234 5678 !!"), (16, "a" * 400), (17, "a" * 300), (18, "Released under the MIT License."), (19, "mit license mit license"),
            (20, "one two"), (20, "one two"), (21, "other text of the same id"), (21, "and one more text of it"), (None, base), (None, None),
            (22, "東京" * 60), (23, "x" + "東京" * 60)]
    return [(i, t, rng.choice(["en", None]), "s", None) for i, t in rows]


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with nulls, empty and very long texts, repeated rows and ids, and more columns."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(awkward_rows(), KIND)
    for name in CLASH:
        df = df.withColumn(name, F.lit("clash"))
    return df.repartition(3)


@pytest.fixture(scope="session")
def no_rows(spark):
    return spark.createDataFrame([], KIND)
