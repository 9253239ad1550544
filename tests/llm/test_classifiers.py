import numpy as np
from pyspark.sql import functions as F

from corpusloom.llm import language, main_text, queries, toxicity

from .conftest import awkward_rows

SF = "sf0.01"


def folder(sf):
    return sf.replace("sf0.001", SF)


def test_toxicity_on_held_out_rows(spark, sf):
    labels = spark.read.parquet(f"{folder(sf)}/labels.parquet")
    rows = queries.op7_toxicity(spark, folder(sf)).join(labels, "doc_id").filter("held_out").toPandas()
    assert (rows.predicted == rows.toxic).mean() > 0.93
    assert rows[rows.predicted == 1].toxic.mean() > 0.9
    assert rows.score.between(0, 1).all()


def test_toxicity_of_awkward_rows(spark, awkward, no_rows):
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(30)] + [(1, 1, 0), (1, None, 0), (None, 1, 0), (2, 7, 0)], "doc_id long, toxic int, text int")
    model = toxicity.fit(awkward, labels, max_rows=20)
    scores = toxicity.score(awkward, model)
    assert scores.columns == ["doc_id", "score"]
    found = [(str(r.doc_id), r.score) for r in scores.collect()]
    assert sorted(i for i, _ in found) == sorted(str(r[0]) for r in awkward_rows()) and all(0 <= s <= 1 for _, s in found)
    assert toxicity.score(no_rows, model).count() == 0
    for none in (toxicity.fit(awkward, labels.limit(0)), toxicity.fit(awkward, labels.filter("toxic = 0")), toxicity.fit(no_rows, labels)):
        assert {round(r.score, 6) for r in toxicity.score(awkward, none).collect()} == {0.0}
    kept = toxicity.scored(awkward, model)
    assert kept.columns == [*awkward.columns, "toxicity_score"] and kept.count() == len(awkward_rows())


def plain_grams(text):
    """Distinct n-grams of three to six characters of an edged text."""
    text = " " + "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else " " if c in "\t\n\v\f\r" else c for c in text or "") + " "
    return {text[i:i + n] for n in (3, 4, 5, 6) for i in range(len(text) - n + 1)}


def test_toxicity_by_hand(spark):
    """Ratios of all supported n-grams, and the features of each text, against plain sets of characters."""
    texts = ["Dreadful Ring", "dreadful\tring!", "a ring", "über 東京東京", "東京東京 x", "x", "", "\U0001f600\U0001f600 ring", "dreadful 東京東京"] * 3
    rows = [(i, t, int("readful" in t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(3)
    n_toxic = sum(r[2] for r in rows)
    counts = {}
    for _, t, toxic in rows:
        for g in plain_grams(t):
            hits, all_ = counts.get(g, (0, 0))
            counts[g] = hits + toxic, all_ + 1
    want = {g: np.log((t + 1) / (n_toxic + 1)) - np.log((r - t + 1) / (len(rows) - n_toxic + 1)) for g, (t, r) in counts.items() if r >= 4}
    want = {g: v for g, v in want.items() if abs(v) >= 0.5}
    gram, ratio = toxicity.ratios(df, len(rows), n_toxic, 4, 0.5)
    assert np.allclose(np.sort(ratio), sorted(want.values()))
    model = toxicity.Model(gram, ratio, -0.25)
    for r in toxicity.score(df, model).collect():
        z = sum(want.get(g, 0.0) for g in plain_grams(texts[r.doc_id])) - 0.25
        assert abs(r.score - 1 / (1 + np.exp(-z))) < 1e-9


def test_toxicity_learns_words_and_not_length(spark):
    rng = np.random.default_rng(4)
    plain = ["river", "stone", "cloud", "garden", "window", "paper", "silver", "mountain"]
    rows = []
    for i in range(300):
        words = list(rng.choice(plain, rng.integers(3, 200)))
        if i % 3 == 0:
            words.insert(int(rng.integers(len(words))), ["dreadful", "horrid"][i % 2])
        rows.append((i, " ".join(words), int(i % 3 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df.filter("doc_id < 200"), df.select("doc_id", "toxic"))
    found = toxicity.score(df.filter("doc_id >= 200"), model).join(df, "doc_id").collect()
    assert all((r.score >= 0.5) == (r.toxic == 1) for r in found)


def test_language_on_held_out_rows(spark, sf):
    docs = spark.read.parquet(f"{folder(sf)}/documents.parquet")
    rows = queries.op9_language(spark, folder(sf)).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (rows.lang == rows.lang_pred).mean() > 0.97 and rows.score.between(0, 1).all()


def test_language_mixture_is_told(spark):
    a, b, c = "alpha beta gamma delta", "uno dos tres cuatro", "zwölf elf über öl"
    train = spark.createDataFrame([(a * 5, "x"), (b * 5, "y"), (c * 5, "z"), (None, "x"), (a, None)], "text string, lang string")
    model = language.fit(train)
    assert model.names == ["x", "y", "z"]
    rows = [(0, " ".join([a] * 30 + [b] * 10)), (1, " ".join([b] * 40)), (2, " ".join([c] * 30 + [a] * 10 + [b] * 5)), (3, None), (4, "123 !!"), (5, ""), (6, "é"), (None, a * 3)]
    found = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit(1)), model).collect()}
    assert [found[i][0] for i in (0, 1, 2, None)] == ["x", "y", "z", "x"]
    assert 0.65 < found[0][1] < 0.85 and found[1][1] == 1.0 and 0.5 < found[2][1] < 0.8
    assert [found[i] for i in (3, 4, 5)] == [("und", 0.0)] * 3
    assert found[6][0] in model.names
    nothing = language.fit(train.limit(0))
    assert {r.lang_pred for r in language.predict(spark.createDataFrame(rows, "doc_id long, text string"), nothing).collect()} == {"und"}


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x:1}</style><script>var t="</p>";</script></head><body>
<header><p>Site name</p></header><nav><ul><li><a href="/a>b">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<article><h1>Head &amp; line</h1><p>First <b>bold</b>
 text&nbsp;here<br>and on.<p>Second &lt;p&gt; &eacute;&#233;<!-- no --></p><div class="ad">Buy now</div><p>a < b</p></article>
<aside><p>Other stories</p></aside><section id="comments"><h3>Comments</h3><div class="comment"><p>Nice one</p></div></section>
<form><label>Mail</label><button>Send</button></form><footer>&copy; 2020</footer></body></html>"""
WANT = "Head & line\n\nFirst bold text here and on.\n\nSecond <p> éé\n\na < b"


def test_main_text(spark, sf):
    pages = spark.read.parquet(f"{folder(sf)}/pages.parquet")
    model = main_text.fit(pages)
    rows = [(0, "u", PAGE), (1, None, None), (2, "u", ""), (None, "u", PAGE), (0, "u", PAGE), (3, "u", PAGE[:PAGE.index("<div class=\"ad\"")] + "<div cla"),
            (4, "u", "<article><p>" + "long " * 30000 + "</p></article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    found = sorted(((str(r.page_id), r.text) for r in main_text.extract(df, model).collect()))
    assert found == sorted([("0", WANT), ("1", ""), ("2", ""), ("None", WANT), ("0", WANT), ("3", WANT[:-7]), ("4", ("long " * 30000).strip())])
    assert main_text.extract(df.limit(0), model).count() == 0
    assert main_text.fit(df.limit(0)).weights[0].shape == (main_text.INPUT, 4 * main_text.HIDDEN)
    # Pages that were not trained on, against the text of their article element.
    import html
    import re

    rest = pages.orderBy(F.xxhash64("page_id"), "page_id", "html").offset(main_text.TRAIN_PAGES)
    said = {r.page_id: r.text for r in main_text.extract(rest, model).collect()}
    assert said
    for r in rest.collect():
        article = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)
        want = re.sub(r"<[^>]*>?", " ", article[1]) if article else ""
        assert said[r.page_id].split() == html.unescape(want).split()


UNSEEN = ["<article>{}</article>", "<div>{}</div>", '<div class="article-body">{}</div>', '<table><tr><td>{}</td></tr></table>', '<div id="page-wrap">{}</div>', '<div class="text">{}</div>', "{}",
          '<div class="col-8 lg"><div class="prose">{}</div></div>', '<section id="s1">{}</section>', '<div class="blog-inner"><div>{}</div></div>']


def test_articles_in_unseen_containers(spark, sf):
    """What an article is must be told by its content: plain paragraphs between a bar of links and a footer, in containers that the training never names."""
    pages = spark.read.parquet(f"{folder(sf)}/pages.parquet")
    model = main_text.fit(pages)
    rng = np.random.default_rng(3)
    words = "winter river the of and market stone a light in morning walked over bridge to town it was old people came from hills".split()

    def sentence():
        return " ".join(rng.choice(words, rng.integers(6, 20))).capitalize() + rng.choice([".", ".", "!", "?"])

    kept = wanted = extra = others = 0
    for n in range(60):
        paragraphs = [" ".join(sentence() for _ in range(rng.integers(1, 6))) for _ in range(6)]
        title = f"<h1>{sentence()[:-1]}</h1>" if n % 3 else ""
        body = UNSEEN[n % len(UNSEEN)].replace("{}", title + "".join(f"<p>{p}</p>" for p in paragraphs))
        bar = "".join(f'<li><a href="/{w}">{w.capitalize()}</a></li>' for w in rng.choice(words, 6))
        page = f"<html><body><ul>{bar}</ul>{body}<div>&copy; 2024 Old Town</div></body></html>"
        found = main_text.blocks(page)
        keep = model.scores(main_text.vectors([found]), np.array([len(found)])) >= 0.5
        for b, k in zip(found, keep, strict=True):
            if b.text in paragraphs:
                wanted, kept = wanted + 1, kept + k
            elif b.linked or "©" in b.text:
                others, extra = others + 1, extra + k
    assert wanted == 360 and kept >= 0.95 * wanted, kept
    assert others == 420 and extra <= 0.05 * others, extra


def test_deep_pages_cost_no_more_than_flat_ones():
    import time

    for deep in ("<div>", "<b>", "<div><p>", "<b><p></p>", '<section class="x">', "<a>"):
        seconds = []
        for n in (5_000, 40_000):
            start = time.perf_counter()
            found = main_text.blocks(deep * n + "text" + "</div></p></b>" * n)
            main_text.vectors([found])
            seconds.append(time.perf_counter() - start)
            assert found[-1].text == "text"
        assert seconds[1] < 30 * seconds[0] + 1


def test_gradients():
    model = main_text.Labeller.fresh()
    pages = [main_text.blocks(PAGE), main_text.blocks("<p>a</p><p>b</p>")]
    x, n = main_text.vectors(pages), np.array([len(p) for p in pages])
    y = np.array([main_text.meaning(b.path) for p in pages for b in p], np.float32)

    def loss():
        p = model.scores(x, n).astype(float)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    grads = model.gradients(x, n, y)
    for i, at in ((0, (main_text.PATH + main_text.WORDS, 30)), (1, (3, 60)), (2, (10,)), (4, (2, 80)), (5, (75,)), (6, (3,)), (7, (0,))):
        old = model.weights[i][at]
        model.weights[i][at] = old + 1e-2
        up = loss()
        model.weights[i][at] = old - 1e-2
        down = loss()
        model.weights[i][at] = old
        assert abs(grads[i][at] - (up - down) / 2e-2) < 1e-5 + 0.02 * abs(grads[i][at])
