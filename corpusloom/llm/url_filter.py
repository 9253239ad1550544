"""URL filters: host and path rules, and a logistic regression on hashed character n-grams of host and path for the rest.

The host and the path of a URL are edged, their digits made alike, and their n-grams of three to five bytes hashed, each field by itself, into a
fixed number of weights; a URL's features are counts divided by the root of their number, so a long path does not outweigh the host. The regression is fitted on a small labelled table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.llm.batches import column, flat, words8

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORDERS = (3, 4, 5)
BITS = 16
MIX = np.uint64(0x9E3779B97F4A7C15)
#: The regression is fitted on at most so many labelled URLs, those with the smallest hashes.
TRAIN_ROWS = 20_000
#: Rules are sent to every task; more are refused.
MOST_RULES = 1_000_000


@dataclass(frozen=True)
class Rule:
    """A host, which stands for itself and its subdomains, and the start of a path."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z in lower case; empty without ``://`` or for a null."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``; empty without ``://`` or for a null."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class Rules:
    """Rules by host; the longest (host and path together) that fits wins, of equally long ones the longest host."""

    def __init__(self, rules: Sequence[Rule]):
        if len(rules) > MOST_RULES:
            raise ValueError(f"at most {MOST_RULES} rules, not {len(rules)}")
        self.by_host: dict[str, list[Rule]] = {}
        for rule in rules:
            self.by_host.setdefault(rule.host, []).append(rule)

    def of_host(self, name: str) -> list[Rule]:
        found, at = [], 0
        while True:
            found += self.by_host.get(name[at:], ())
            at = name.find(".", at) + 1
            if not at:
                return sorted(found, key=lambda r: (-len(r.text), -len(r.host), r.path, r.verdict))

    def match(self, hosts: list[str], paths: list[str]) -> list[Rule | None]:
        known: dict[str, list[Rule]] = {}
        out: list[Rule | None] = []
        for h, p in zip(hosts, paths, strict=True):
            if h not in known:
                known[h] = self.of_host(h)
            out.append(next((r for r in known[h] if p.startswith(r.path)), None))
        return out


def _table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[ord("A"):ord("Z") + 1] += 32
    table[ord("0"):ord("9") + 1] = ord("0")
    return table


def _field_features(texts: pa.Array, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of the text and weight index of every n-gram of every text."""
    data, offsets = flat(texts)
    n = len(offsets) - 1
    out = np.full(len(data) + 2 * n, ord(" "), np.uint8)
    text = np.repeat(np.arange(n), np.diff(offsets))
    out[np.arange(len(data)) + 2 * text + 1] = _table()[data]
    ends = offsets[1:] + 2 * np.arange(1, n + 1)
    eight = words8(out)[:-1]
    rows, index = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    of = np.repeat(np.arange(n), np.diff(offsets) + 2)
    for order in ORDERS:
        at = np.flatnonzero(np.arange(len(out)) + order <= ends[of])
        gram = (eight[at] & np.uint64((1 << 8 * order) - 1)) | np.uint64(order + 8 * salt) << np.uint64(56)
        gram = (gram ^ (gram >> np.uint64(31))) * MIX
        rows.append(of[at])
        index.append(((gram ^ (gram >> np.uint64(29))) * MIX >> np.uint64(64 - BITS)).astype(np.int64))
    return np.concatenate(rows), np.concatenate(index)


def features(hosts: pa.Array, paths: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Triples of row, feature and value; the squared values of each field of a row add up to one."""
    parts = []
    for salt, texts in enumerate((hosts, paths)):
        row, index = _field_features(texts, salt)
        count = np.bincount(row, minlength=len(texts))
        parts.append((row, index, 1.0 / np.sqrt(np.maximum(count, 1))[row]))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


@dataclass
class Model:
    weights: np.ndarray
    intercept: float

    def score(self, hosts: pa.Array, paths: pa.Array) -> np.ndarray:
        """Probability that each URL is to be blocked."""
        row, index, value = features(hosts, paths)
        z = np.bincount(row, value * self.weights[index], len(hosts)) + self.intercept
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def fit(labelled: DataFrame, max_rows: int = TRAIN_ROWS, share: float = 0.2, steps: int = 400, penalty: float = 3e-5) -> Model:
    """Fits on at most ``max_rows`` rows of ``labelled`` (``url``, ``blocked`` 0 or 1), those with the smallest hashes of their URLs.

    A labelled table holds more bad URLs than a crawl, so its rows are weighted as if ``share`` of them were blocked, and the intercept is held at the log odds of that
    share: a URL of n-grams that the table does not know gets ``share`` as its score.

    Rows with another label, or without ``url``, are passed over; of a repeated URL the largest label counts. Without labels of both kinds the score is the
    one label there is, or 0 without any.
    """
    rows = (labelled.select("url", F.col("blocked").cast("int").alias("blocked")).filter("url is not null and blocked in (0, 1)").groupBy("url").agg(F.max("blocked").alias("blocked"))
            .orderBy(F.xxhash64("url"), "url").limit(max_rows).select(host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), "blocked").toArrow())
    label = rows["blocked"].to_numpy().astype(float)
    weights = np.zeros(1 << BITS)
    if not 0 < label.sum() < len(label):
        return Model(weights, 60.0 if label.sum() else -60.0)
    row, index, value = features(rows["host"].combine_chunks(), rows["path"].combine_chunks())
    used, local = np.unique(index, return_inverse=True)
    w, intercept = np.zeros(len(used)), float(np.log(share / (1 - share)))
    m, v = np.zeros_like(w), np.zeros_like(w)
    weight = np.where(label == 1, share / label.sum(), (1 - share) / (1 - label).sum())
    for step in range(1, steps + 1):
        z = np.bincount(row, value * w[local], len(label)) + intercept
        error = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - label) * weight
        g = np.bincount(local, value * error[row], len(used)) + penalty * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    weights[used] = w
    return Model(weights, intercept)


def judge(pages: DataFrame, rules: Sequence[Rule], model: Model, threshold: float = 0.5, keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """The columns ``keep``, ``host``, ``path``, ``rule`` (its text, else null), ``score`` (probability of being blocked) and ``verdict``: the rule's, else ``block`` from ``threshold`` on.

    One row for each row of ``pages`` (``url``). A null URL, and one without ``://``, has an empty host and path, fits no rule and is scored like any other. Other columns are ignored.
    """
    known = Rules(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths = column(batch, "_host"), column(batch, "_path")
            score = model.score(hosts, paths)
            found = known.match(hosts.to_pylist(), paths.to_pylist())
            verdict = [r.verdict if r else "block" if s >= threshold else "allow" for r, s in zip(found, score.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r.text if r else None for r in found], pa.string()), pa.array(score), pa.array(verdict, pa.string())],
                                             [*(f"_{n}" for n in range(len(keep))), "host", "path", "rule", "score", "verdict"])

    rows = pages.select(*(F.col(c).alias(f"_{n}") for n, c in enumerate(keep)), host(F.col("url")).alias("_host"), path(F.col("url")).alias("_path"))
    own = ", ".join(f"`_{n}` {pages.schema[c].dataType.simpleString()}" for n, c in enumerate(keep))
    found = rows.mapInArrow(run, f"{own}, host string, path string, rule string, score double, verdict string")
    return found.withColumnsRenamed({f"_{n}": c for n, c in enumerate(keep)})


#: A small labelled table to start from: URLs of kinds that a training corpus leaves out, and usual ones.
BLOCKED = """
http://adult-videos.test/watch/12
https://www.xxx-tube.test/de/12
http://hot-adult-chat.test/fr/19/
https://nude-models.test/gallery/7
http://sexy-cams.test/es/102
https://adult-dating.test/en/340
http://porn-hd.test/v/33
https://casino-royal.test/de/33.html
http://online-casino.test/en/218/
https://www.poker-win.test/play
http://win-big-casino.test/en/905
https://jackpot-slots.test/en/7
http://lucky-win.test/en/99
https://free-spins.test/de/12
http://sports-bets.test/fr/19/
https://bets-online.test/en/live
http://free-betting.test/es/102
https://best-bets.test/en/340
http://cheap-viagra.test/buy
https://pills-online.test/de/33.html
http://cheap-meds.test/en/218/
https://www.diet-pills.test/offer
http://weight-loss-pills.test/en/905
https://pharmacy-cheap.test/en/7
http://cheap-watches.test/replica
https://cheap-loans.test/de/12
http://spam-links.test/fr/19/
https://link-farm.test/en/301
http://seo-spam.test/es/102
https://content-farm.test/en/340
http://click-farm.test/go
https://ads-server.test/de/33.html
http://track-ads.test/en/218/
https://adserver.test/banner
http://popup-ads.test/en/905
https://click-track.test/en/7
http://tracking-pixel.test/p.gif
https://free-money.test/de/12
http://get-rich-quick.test/fr/19/
https://free-iphone.test/claim
http://free-download-crack.test/es/102
https://warez-crack.test/en/340
http://torrent-free.test/dl
https://malware-update.test/de/33.html
http://phishing-login.test/en/218/
https://secure-bank-verify.test/account
http://fake-news-clicks.test/en/905
http://www.adult-world.test/en/66
https://m.adult-shop.test/de/5
http://blog.casino-tips.test/en/812
https://m.casino-bonus.test/fr/90
http://www.win-prizes.test/en/14.html
https://blog.free-bets-now.test/en/391
http://m.bets-today.test/es/28
https://www.cheap-deals-pills.test/en/650/
http://m.cheap-pharmacy.test/en/71
https://blog.spam-host.test/en/203
http://www.farm-of-links.test/de/8
https://m.spam-blog.test/en/59
http://www.ads-network.test/en/430
https://m.track-clicks.test/fr/111
http://blog.ads-exchange.test/en/6
https://www.x-rated.test/en/95
"""
USUAL = """
https://www.city-news.test/en/2021/budget
http://daily.test/en/481
https://news.morning.test/politics/77
http://weather.test/de/12
https://blog.gardening.test/en/roses
http://blog.travels.test/fr/19/
https://m.recipes.test/en/soup.html
http://cooking.test/es/102
https://university.test/research/physics
http://library.test/catalogue/9
https://museum.test/fr/expositions
http://history.test/en/romans.html
https://en.encyclopedia.test/wiki/Rome
http://science.test/en/340
https://journal.test/articles/55
http://archive.test/de/1999/3
https://docs.software.test/guide/install
http://developers.test/en/api
https://forum.cars.test/thread/812
http://www.cycling.test/en/tours
https://football.test/en/results
http://music.test/albums/41
https://books.test/en/novels/7.html
http://theatre.test/es/obras
https://hospital.test/en/visitors
http://health.test/de/ernaehrung
https://council.test/services/parking
http://government.test/en/forms
https://school.test/en/lessons/8
http://students.test/fr/cours
https://shop.furniture.test/en/chairs
http://store.test/products/64
https://hotel.test/de/zimmer
http://trains.test/en/timetable
https://maps.test/en/streets/5
http://photos.test/en/218/
https://m.nature.test/birds/owl.html
http://www.animals.test/en/777
https://astronomy.test/en/stars
http://poetry.test/fr/604
https://painting.test/es/31.html
http://language.test/en/grammar
https://philosophy.test/de/kant
http://economy.test/en/trade/2
https://thinking.test/en/905
http://the-other-side.test/en/18
https://station.test/en/163/
http://nation.test/fr/288
https://together.test/en/675
http://northern.test/de/42.html
https://thread.test/en/5
http://the-hand.test/en/960
https://motion.test/es/797
http://therapy-centre.test/en/391
https://m.harbour.test/en/7
http://blog.kitchen.test/en/230.html
https://www.river-trust.test/en/88/
http://orchard.test/en/12
https://m.painters.test/de/415
http://blog.islands.test/fr/77.html
https://www.mountain-club.test/en/309
http://village.test/en/561/
https://courthouse.test/en/29
http://m.teachers.test/es/640
https://blog.weaving.test/en/118
http://www.bridges.test/en/902.html
https://carpentry.test/fr/53/
http://m.lighthouse.test/en/334
https://blog.chess.test/de/271
http://www.railways.test/en/16
https://theory.test/en/728
http://m.meadows.test/en/45/
https://blog.winter.test/en/853
http://www.parliament.test/en/690
https://election.test/en/214.html
http://m.education.test/en/37
https://blog.tradition.test/es/149
http://www.gathering.test/en/482/
https://earth.test/en/570
http://m.method.test/fr/6
https://blog.anthem.test/en/925
http://www.thunder.test/en/361.html
https://weather-station.test/en/108
http://m.brothers.test/en/744
"""


def labelled_urls(spark) -> DataFrame:
    """``url`` and ``blocked`` of the table above. Hosts also come with paths of the other kind, so that a path's shape alone says little."""
    kinds = BLOCKED.split(), USUAL.split()
    rows = []
    for own, other, blocked in (kinds[0], kinds[1], 1), (kinds[1], kinds[0], 0):
        for i, url in enumerate(own):
            rows.append((url, blocked))
            for shift in (0, 17, 31):
                rows.append(("/".join(url.split("/")[:3] + other[(i + shift) % len(other)].split("/")[3:]), blocked))
    return spark.createDataFrame(rows, "url string, blocked int")
