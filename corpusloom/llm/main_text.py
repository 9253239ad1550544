"""Main text of web pages: a recurrent labeller over the blocks of a page.

A page is cut into blocks of text at block-level tags. Each block has a vector: hashed names and class words of the tags on its path, hashed
words, and a few measures (length, links, punctuation, place). A bidirectional LSTM, written in numpy, reads the blocks of a page in
order and says of each whether it belongs to the article, with the whole page as context.

The labeller is trained on a bounded sample of the pages and on variants of them: their articles in other containers, between menus, notices, forms, comments and
adverts filled with texts of other pages. A variant's labels are known because it was built; the given pages' come from the meaning of the tags around each block. In many variants
the containers say nothing (a plain ``div``, a table cell, made-up names, none at all), so that length, links, punctuation and what stands around a block must decide.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusloom.llm.batches import column, pieces
from corpusloom.llm.shingles import word_bounds, word_hashes

#: Pages that the labeller is trained on, those with the smallest hashes of their ids.
TRAIN_PAGES = 200
PATH, WORDS, MEASURES, HIDDEN = 256, 32, 8, 24
INPUT = PATH + WORDS + MEASURES
STEPS, BATCH, LONGEST = 320, 16, 96
VARIANTS = 4
#: Stands before the texts of a variant's article (a private character, removed again).
MARK = "\ue000"

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|iframe|svg|title|object)\b[^>]*(?:>.*?(?:</(?P=raw)\s*>|\Z)|\Z)"
    r"|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<own>(?:\"[^\"]*\"|'[^']*'|[^\"'>])*+>|[^>]*(?:>|\Z))", re.S | re.I)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup "
                   "time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NESTING = frozenset("div ul section article".split())
CLOSING = NESTING | frozenset("p li option tr td th dt dd h1 h2 h3 footer".split())
# Words in tags, classes and ids that tell what a part of a page is.
OTHER = frozenset("ad ads advert advertisement advertising alert aside banner breadcrumb breadcrumbs button comment comments consent cookie cookies copyright "
                  "dialog disclaimer discussion footer form head legal login masthead menu modal nav navbar navigation newsletter notice notification pagination popup "
                  "promo related replies reply select share sidebar signup social sponsor sponsored subscribe textarea toolbar widget".split())
ARTICLE = frozenset("article main content post entry story".split())


class Path:
    """The tags above a block, as a link to the one above and what all of them add up to; a deep page costs no more than a flat one."""

    __slots__ = ("tag", "buckets", "words", "inside", "other")

    def __init__(self, above: Path | None, tag: str, own: tuple[str, ...]):
        self.tag, self.words = tag, ((above.words if above else ()) + own)[-2:]
        self.buckets = (above.buckets if above else 0) | word_buckets(own)
        self.inside, self.other = (above.inside, above.other) if above else (False, False)
        for word in own:
            self.other |= word in OTHER or word == "header" and not self.inside
            self.inside |= word in ARTICLE


class Block:
    __slots__ = ("path", "text", "linked")

    def __init__(self, path: Path | None, text: str, linked: int):
        self.path, self.text, self.linked = path, text, linked


@lru_cache(maxsize=20_000)
def tag_words(tag: str, own: str) -> tuple[str, ...]:
    named = " ".join(next(filter(None, m), "") for m in NAMED.findall(own)).lower()
    return (tag, *re.findall(r"[a-z]+", named))


@lru_cache(maxsize=20_000)
def word_buckets(words: tuple[str, ...], kind: str = "") -> int:
    """The buckets of words, as bits of one number."""
    bits = 0
    for word in words:
        bits |= 1 << zlib.crc32((kind + word).encode()) % PATH
    return bits


def blocks(page: str) -> list[Block]:
    """Texts between block-level tags, references decoded, white space made one space; empty ones are left out."""
    out: list[Block] = []
    stack: list[Path] = []
    # Places of the block-level tags in the stack, and how often each tag is open.
    outer: list[int] = []
    is_open: Counter[str] = Counter()
    parts: list[str] = []
    linked, at, path = 0, 0, None

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(path, text, linked))
            parts.clear()
            linked = 0

    def say(raw: str) -> None:
        nonlocal linked, path
        if raw:
            if not parts:
                path = stack[-1] if stack else None
            raw = html.unescape(raw) if "&" in raw else raw
            parts.append(raw)
            if is_open["a"]:
                linked += len(raw)

    def close() -> str:
        gone = stack.pop().tag
        is_open[gone] -= 1
        if outer and outer[-1] == len(stack):
            outer.pop()
        return gone

    for m in TOKEN.finditer(page):
        say(page[at:m.start()])
        at = m.end()
        tag = m["tag"]
        if not tag:
            continue
        tag = tag.lower()
        if tag == "br":
            say(" ")
            continue
        if tag not in INLINE:
            flush()
        if m["end"]:
            if is_open[tag]:
                while close() != tag:
                    pass
        elif tag not in VOID and not m["own"].endswith("/>"):
            if outer and tag in CLOSING:
                # An open paragraph ends where a block begins, and an open item where its like begins.
                last = stack[outer[-1]].tag
                if last == "p" or last == tag and tag not in NESTING:
                    for _ in range(len(stack) - outer[-1]):
                        close()
            own = m["own"]
            if tag not in INLINE:
                outer.append(len(stack))
            stack.append(Path(stack[-1] if stack else None, tag, tag_words(tag, own[:-1] if "=" in own else "")))
            is_open[tag] += 1
    say(page[at:])
    flush()
    return out


def vectors(pages: list[list[Block]]) -> np.ndarray:
    """One row for each block of all pages."""
    flat = [b for p in pages for b in p]
    x = np.zeros((len(flat), INPUT), np.float32)
    if not flat:
        return x
    raw = [b.text.encode("utf-8", "surrogatepass") for b in flat]
    offsets = np.cumsum([0, *map(len, raw)])
    data = np.frombuffer(b"".join(raw), np.uint8)
    starts, ends, first = word_bounds(data, offsets)
    n_words = np.diff(first)
    of = np.repeat(np.arange(len(flat)), n_words)
    bucket = (word_hashes(data, starts, ends, lower=True) >> np.uint64(59)).astype(np.int64)
    x[:, PATH:PATH + WORDS] = np.bincount(of * WORDS + bucket, minlength=len(flat) * WORDS).reshape(-1, WORDS) / np.maximum(n_words, 1)[:, None]
    for i, b in enumerate(flat):
        if b.path:
            x[i, :PATH] = path_bits(b.path.buckets, b.path.words)
    size = np.diff(offsets)
    sentence = np.array([b.text[-1] in ".!?\"'”»)" for b in flat], np.float32)
    heading = np.array([b.path is not None and b.path.tag in ("h1", "h2", "h3", "h4") for b in flat], np.float32)
    marks = np.add.reduceat(np.append(np.isin(data, np.frombuffer(b".,;:!?", np.uint8)), False).astype(np.int64), offsets[:-1])
    place = np.concatenate([np.linspace(0, 1, len(p)) for p in pages])
    measures = [np.log1p(size) / 8, np.array([b.linked for b in flat]) / np.maximum(size, 1), marks / np.maximum(size, 1) * 5, np.log1p(n_words) / 6, place, sentence, heading, place ** 0]
    x[:, PATH + WORDS:] = np.stack(measures, 1)
    return x


@lru_cache(maxsize=20_000)
def path_bits(buckets: int, last: tuple[str, ...]) -> np.ndarray:
    """Buckets of all words of a path, and of the last two by themselves."""
    bits = (buckets | word_buckets(last, "last ")).to_bytes(PATH // 8, "little")
    return np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little").astype(np.float32)


def meaning(path: Path | None) -> int:
    """1 if the tags around a block say that it is part of an article."""
    return int(path is not None and path.inside and not path.other)


class Labeller:
    """Bidirectional LSTM with one output; ``weights``: for each direction input, state and bias, then the output's."""

    def __init__(self, weights: list[np.ndarray]):
        self.weights = weights

    @staticmethod
    def fresh(seed: int = 1) -> Labeller:
        rng = np.random.default_rng(seed)
        out: list[np.ndarray] = []
        for _ in range(2):
            bias = np.zeros(4 * HIDDEN, np.float32)
            bias[HIDDEN:2 * HIDDEN] = 1
            out += [rng.normal(0, INPUT ** -0.5, (INPUT, 4 * HIDDEN)).astype(np.float32), rng.normal(0, HIDDEN ** -0.5, (HIDDEN, 4 * HIDDEN)).astype(np.float32), bias]
        return Labeller([*out, rng.normal(0, 0.2, 2 * HIDDEN).astype(np.float32), np.zeros(1, np.float32)])

    @staticmethod
    def _pass(x: np.ndarray, order: list[np.ndarray], state: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """Runs all sequences in step; order[t]: rows of ``x`` (input times weights) at step t, one for each sequence still going."""
        n = len(order[0]) if order else 0
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        out, memory = np.zeros((len(x), HIDDEN), np.float32), []
        for rows in order:
            h, c = h[:len(rows)], c[:len(rows)]
            z = x[rows] + h @ state
            gate = 1 / (1 + np.exp(-z[:, :3 * HIDDEN]))
            i, f, o = np.split(gate, 3, 1)
            g = np.tanh(z[:, 3 * HIDDEN:])
            before = (h, c)
            c = f * c + i * g
            t = np.tanh(c)
            h = o * t
            out[rows] = h
            if keep:
                memory.append((rows, i, f, o, g, t, *before))
        return out, memory

    @staticmethod
    def _steps(lengths: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Rows of each step forwards and backwards; the longest sequences come first, so those still going are a prefix."""
        order = np.argsort(-lengths, kind="stable")
        starts = (np.cumsum(lengths) - lengths)[order]
        sizes = lengths[order]
        going = np.searchsorted(-sizes, -np.arange(int(sizes.max(initial=0))), "left")
        ahead = [starts[:g] + t for t, g in enumerate(going)]
        return ahead, [starts[:g] + sizes[:g] - 1 - t for t, g in enumerate(going)]

    def scores(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Probability of each block to belong to the article; ``lengths``: blocks of each page."""
        lengths = np.asarray(lengths)
        z = np.full(len(x), self.weights[7][0], np.float32)
        for side, order in enumerate(self._steps(lengths[lengths > 0])):
            w, u, b = self.weights[3 * side:3 * side + 3]
            h, _ = self._pass(x @ w + b, order, u, False)
            z += h @ self.weights[6][side * HIDDEN:(side + 1) * HIDDEN]
        return 1 / (1 + np.exp(-z))

    def gradients(self, x: np.ndarray, lengths: np.ndarray, label: np.ndarray) -> list[np.ndarray]:
        orders = self._steps(lengths)
        both = [self._pass(x @ self.weights[3 * s] + self.weights[3 * s + 2], orders[s], self.weights[3 * s + 1], True) for s in (0, 1)]
        h = np.concatenate([both[0][0], both[1][0]], 1)
        error = (1 / (1 + np.exp(-(h @ self.weights[6] + self.weights[7][0]))) - label) / len(label)
        out: list[np.ndarray] = []
        for side in (0, 1):
            u = self.weights[3 * side + 1]
            above = error[:, None] * self.weights[6][None, side * HIDDEN:(side + 1) * HIDDEN]
            dz_all, du = np.zeros((len(x), 4 * HIDDEN), np.float32), np.zeros_like(u)
            dh, dc = np.zeros((0, HIDDEN), np.float32), np.zeros((0, HIDDEN), np.float32)
            for rows, i, f, o, g, t, h0, c0 in reversed(both[side][1]):
                more = np.zeros((len(rows) - len(dh), HIDDEN), np.float32)
                dh, dc = np.concatenate([dh, more]) + above[rows], np.concatenate([dc, more])
                dc = dc + dh * o * (1 - t * t)
                dz = np.concatenate([dc * g * i * (1 - i), dc * c0 * f * (1 - f), dh * t * o * (1 - o), dc * i * (1 - g * g)], 1)
                dz_all[rows] = dz
                du += h0.T @ dz
                dh, dc = dz @ u.T, dc * f
            out += [x.T @ dz_all, du, dz_all.sum(0)]
        return [*out, h.T @ error, np.array([error.sum()], np.float32)]

    def train(self, pages: list[tuple[np.ndarray, np.ndarray]], steps: int = STEPS, seed: int = 1) -> None:
        """Adam on batches of pages (vectors and labels of their blocks); of a long page a stretch of LONGEST blocks."""
        rng = random.Random(seed)
        m, v = [np.zeros_like(w) for w in self.weights], [np.zeros_like(w) for w in self.weights]
        for step in range(1, steps + 1):
            xs, ys = [], []
            for x, y in rng.choices(pages, k=BATCH):
                at = rng.randrange(max(1, len(x) - LONGEST + 1))
                xs.append(x[at:at + LONGEST])
                ys.append(y[at:at + LONGEST])
            grads = self.gradients(np.concatenate(xs), np.array([len(x) for x in xs]), np.concatenate(ys).astype(np.float32))
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.99 * v[i] + 0.01 * g * g
                self.weights[i] = (self.weights[i] - 0.01 * (m[i] / (1 - 0.9 ** step)) / (np.sqrt(v[i] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)


_CLASSES = sorted(OTHER - {"aside", "button", "footer", "form", "head", "nav", "select", "textarea"})
_CONTAINERS = ["<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", '<div class="content">{}</div>', '<div id="main-content">{}</div>',
               '<div class="post">{}</div>', '<div class="entry-content">{}</div>', '<section class="story">{}</section>', "<article><header><h1>{h}</h1></header>{}</article>"]
# Containers whose names say nothing; {n} is a made-up name.
_NEUTRAL = ["<div>{}</div>", "<div>{}</div>", "<div><div>{}</div></div>", "{}", "{}", '<div class="{n}">{}</div>', '<div id="{n}">{}</div>', '<div class="{n} {n}"><div class="{n}">{}</div></div>',
            "<table><tr><td>{}</td></tr></table>", '<table class="{n}"><tr><td class="{n}">{}</td></tr></table>', "<section>{}</section>", '<div id="{n}"><section class="{n}">{}</section></div>']
_BEFORE = ["<header><h2>{}</h2><p>{}</p></header>", '<div id="header"><p>{}</p></div>', '<nav><ul><li><a href="/x">{}</a></li><li><a href="/y">{}</a></li></ul></nav>',
           '<div class="menu"><a href="/x">{}</a></div>', '<div class="cookie-notice"><p>{}</p></div>', '<div class="notice">{}</div>', '<aside><p>{}</p></aside>',
           '<div class="sidebar"><h3>{}</h3><p>{}</p></div>', '<div class="ad">{}</div>', '<div class="banner"><p>{}</p></div>', '<ul class="breadcrumb"><li>{}</li></ul>']
_AFTER = ['<section id="comments"><h3>{}</h3><div class="comment"><p>{}</p></div><div class="comment"><p>{}</p></div></section>', '<div class="comments"><p>{}</p></div>',
          '<aside class="related"><ul><li><a href="/z">{}</a></li></ul></aside>', '<form class="newsletter"><p>{}</p><button>{}</button></form>', "<form><label>{}</label></form>",
          "<footer><p>{}</p></footer>", "<footer>&copy; {}</footer>", '<div id="footer">{}</div>', '<div class="advert"><p>{}</p></div>', '<div class="share">{}</div>',
          '<div class="sidebar">{}</div>', '<div class="social"><a href="/s">{}</a></div>']
_ANYWHERE = ['<div class="{c}"><p>{}</p></div>', '<div class="{c}">{}</div>', '<section class="{c}"><h3>{}</h3><p>{}</p></section>', '<div id="{c}"><p>{}</p><p>{}</p></div>',
             '<div class="page-{c}"><ul><li>{}</li></ul></div>', '<div role="{c}">{}</div>'] * 2
# Menus and footers that are told by what they hold.
_LINKS = ["<ul>{l}</ul>", "<div><ul>{l}</ul></div>", "<div>{a}</div>", "<p>{a}</p>", '<div class="{n}"><ul>{l}</ul></div>', "<table><tr><td>{a}</td></tr></table>", "<ol>{l}</ol>"]
_ENDS = ["<div>&copy; {y} {s}</div>", "<p>&copy; {y} {s}</p>", '<div class="{n}">Copyright {y} {s}</div>', "<div><p>&copy; {s}</p><p>{a}</p></div>", "<p>{a}</p>", "<div><ul>{l}</ul></div>"]


def variant(texts: list[str], others: list[str], rng: random.Random) -> tuple[list[Block], np.ndarray]:
    """Blocks and labels of a page around paragraphs of an article, with parts of other kinds filled with other texts."""
    def name(_=None) -> str:
        return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 10))) + rng.choice(["", "-x", "_1", "-wrap", "-text", "-body", "-col", "-page", "-inner"])

    def short() -> str:
        words = rng.choice(others).split()
        at = rng.randrange(len(words))
        return html.escape(" ".join(words[at:at + rng.randrange(1, 5)]))

    def link() -> str:
        return f'<a href="/{rng.randrange(99)}">{short()}</a>'

    def fill(pattern: str) -> str:
        pattern = pattern.replace("{c}", rng.choice(_CLASSES)).replace("{y}", str(rng.randrange(1995, 2030))).replace("{s}", short())
        pattern = pattern.replace("{l}", "".join(f"<li>{link()}</li>" for _ in range(rng.randrange(2, 9)))).replace("{a}", rng.choice([" ", " | ", " &middot; "]).join(link() for _ in range(rng.randrange(2, 9))))
        pattern = re.sub(r"\{n\}", name, pattern)
        return re.sub(r"\{\}", lambda _: html.escape(rng.choice(others)[:rng.choice([20, 60, 200, 1000])]), pattern)

    plain = rng.random() < 0.5
    title = MARK + html.escape(texts[0][:60])
    inner = [f"<h1>{title}</h1>"] if rng.random() < 0.6 else []
    for text in texts:
        if rng.random() < 0.15:
            inner.append(f"<p>{MARK}{short()}</p>")
        inner.append(f"<p>{MARK}{html.escape(text)}</p>" if rng.random() < 0.95 else f"<div>{MARK}{html.escape(text)}</div>")
        if rng.random() < 0.05:
            inner.append(f"<h2>{MARK}{html.escape(rng.choice(texts)[:40])}</h2>")
        if rng.random() < 0.1:
            inner.append(fill(rng.choice(['<div class="ad">{}</div>', "<aside>{}</aside>", '<div class="newsletter"><p>{}</p></div>'])))
    body = re.sub(r"\{n\}", name, rng.choice(_NEUTRAL if plain else _CONTAINERS)).replace("{h}", title).replace("{}", "".join(inner))
    kinds = (_LINKS * 2 + _BEFORE, _ENDS * 3 + _LINKS + _AFTER) if plain else (_BEFORE + _ANYWHERE + _LINKS, _AFTER + _ANYWHERE + _ENDS)
    before = [fill(p) for p in rng.sample(kinds[0], rng.randrange(4 if plain else 7))]
    after = [fill(p) for p in rng.sample(kinds[1], rng.randrange(4 if plain else 8))]
    page = f"<html><body>{''.join(before)}{body}{''.join(after)}</body></html>"
    if plain and rng.random() < 0.5:
        page = re.sub("<body>(.*)</body>", lambda m: f'<body><div id="{name()}">{m[1]}</div></body>', page, flags=re.S)
    found = blocks(page)
    label = np.array([MARK in b.text for b in found], int)
    for b in found:
        b.text = b.text.replace(MARK, "")
    keep = [i for i, b in enumerate(found) if b.text]
    return [found[i] for i in keep], label[keep]


def fit(pages: DataFrame, max_pages: int = TRAIN_PAGES) -> Labeller:
    """Trains on at most ``max_pages`` pages (``page_id``, ``html``), those with the smallest hashes of their ids, and ``VARIANTS`` variants of each."""
    pages = pages.select("page_id", "html").filter("page_id is not null and length(html) > 0")
    # Ids first: the html of every task's candidates would add up on the driver. At most max_pages ids are broadcast.
    chosen = pages.select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(max_pages)
    rows = pages.join(F.broadcast(chosen), "page_id").orderBy(F.xxhash64("page_id"), "page_id", "html").limit(max_pages).collect()
    parsed = [blocks(r[1]) for r in rows]
    others = [b.text for p in parsed for b in p if len(b.text) > 3] or ["text"]
    rng = random.Random(1)
    found = [(p, np.array([meaning(b.path) for b in p])) for p in parsed if p]
    for page in parsed or [[]]:
        texts = [b.text.replace(MARK, "") or "text" for b in page if meaning(b.path)] or others[:3]
        for _ in range(VARIANTS):
            at = rng.randrange(len(texts))
            found.append(variant(texts[at:at + rng.randrange(1, 30)], others, rng))
    labeller = Labeller.fresh()
    labeller.train([(vectors([p]), label) for p, label in found if p])
    return labeller


def extract(pages: DataFrame, labeller: Labeller) -> DataFrame:
    """``page_id``, ``url``, ``text`` of every row: the blocks of the article in page order, joined by two line feeds.

    A null or empty ``html``, or one without article blocks, gives an empty text. Pages cut off in a tag, a comment or a reference are read as far as they go.
    Other columns are ignored; repeated rows and null ids are rows like others.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "html", most=1 << 20):
            parsed = [blocks(h or "") for h in column(batch, "html").to_pylist()]
            lengths = np.array([len(p) for p in parsed])
            keep = labeller.scores(vectors(parsed), lengths) >= 0.5
            ends = np.cumsum(lengths)
            texts = ["\n\n".join(b.text for b, k in zip(p, keep[e - len(p):e].tolist(), strict=True) if k) for p, e in zip(parsed, ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([column(batch, "page_id"), column(batch, "url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    pages = pages.select("page_id", "url", "html")
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    return pages.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
