"""Language identification as inference of a mixture.

Every language has a model of hashed letter trigrams. A document is cut into units of a few words, each taken as drawn
from one language; expectation-maximisation estimates the document's proportions of languages from the likelihoods of
its units. Languages are then taken away one by one, the rarest first, as long as the likelihood less a penalty for
each language grows. The largest proportion names the document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusloom.llm.batches import column, flat, pieces, words8

BUCKET_BITS = 15
UNIT_WORDS = 4
STEPS = 8
MIX = np.uint64(0x9E3779B97F4A7C15)


def _byte_table() -> np.ndarray:
    """Letters of ASCII in lower case and all bytes of other characters; everything else is a space."""
    table = np.full(256, 32, np.uint8)
    table[0x80:] = np.arange(0x80, 256)
    table[ord("a"):ord("z") + 1] = table[ord("A"):ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
    return table


TABLE = _byte_table()


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all trigrams that begin in a word or before one, the document and the word (counted on) of each."""
    n = len(offsets) - 1
    out = np.full(len(data) + 3 * n + 3, 32, np.uint8)
    data = TABLE[data]
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        out[a + 3 * i + 1:b + 3 * i + 1] = data[a:b]
    space = out == 32
    begins = space.copy()
    begins[:-1] &= ~space[1:]
    begins[-1] = False
    word = np.cumsum(begins)
    at = np.flatnonzero(begins | (~space & np.append(~space[1:], False)))
    at = at[at < len(out) - 2]
    gram = words8(out)[at] & np.uint64(0xFFFFFF)
    doc = np.searchsorted(offsets[1:] + 3 * np.arange(1, n + 1), at, "right")
    return ((gram * MIX) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), doc, word[at]


@dataclass
class Model:
    """Log probability of each bucket in each language, and the names of the languages in order."""

    names: list[str]
    table: np.ndarray

    def predict(self, data: np.ndarray, offsets: np.ndarray, penalty: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
        """Number of the chosen language (-1: no trigram) and its proportion, of every text."""
        n, k = len(offsets) - 1, len(self.names)
        share, best = np.zeros((n, k)), np.full(n, -1)
        bucket, doc, word = trigrams(data, offsets)
        if not len(bucket) or not k:
            return best, np.zeros(n)
        first_word = np.zeros(n, np.int64)
        new_doc = np.flatnonzero(np.diff(doc, prepend=-1))
        first_word[doc[new_doc]] = word[new_doc]
        unit = doc * (len(data) + 1) + (word - first_word[doc]) // UNIT_WORDS
        cut = np.flatnonzero(np.diff(unit, prepend=-1))
        likelihood = np.add.reduceat(self.table[bucket], cut, axis=0)
        top = likelihood.max(1)
        likelihood = np.exp(np.maximum(likelihood - top[:, None], -60.0))
        doc = doc[cut]
        begin = np.flatnonzero(np.diff(doc, prepend=-1))
        docs, rows = doc[begin], np.diff(np.append(begin, len(doc)))
        at = np.repeat(np.arange(len(docs)), rows)
        base = np.add.reduceat(top, begin)

        def fit(theta: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
            for _ in range(steps):
                part = theta[at] * likelihood
                part /= np.maximum(part.sum(1, keepdims=True), 1e-300)
                theta = np.add.reduceat(part, begin, axis=0) / rows[:, None]
            return theta, base + np.add.reduceat(np.log(np.maximum((theta[at] * likelihood).sum(1), 1e-300)), begin)

        cost = penalty * np.log(rows + 1.0) + 2.0
        theta, gain = fit(np.full((len(docs), k), 1 / k), STEPS)
        theta = np.where(theta < min(0.01, 0.5 / k), 0.0, theta)
        theta /= theta.sum(1, keepdims=True)
        theta, gain = fit(theta, 2)
        gain -= cost * (theta > 0).sum(1)
        going = (theta > 0).sum(1) > 1
        while going.any():
            less = theta.copy()
            lowest = np.where(theta > 0, theta, 2.0).argmin(1)
            less[going, lowest[going]] = 0.0
            less /= less.sum(1, keepdims=True)
            less, value = fit(less, STEPS)
            value -= cost * (less > 0).sum(1)
            going &= value > gain
            theta[going], gain[going] = less[going], value[going]
            going &= (theta > 0).sum(1) > 1
        share[docs] = theta
        best[docs] = theta.argmax(1)
        return best, np.where(best >= 0, share[np.arange(n), np.maximum(best, 0)], 0.0)


def fit(docs: DataFrame) -> Model:
    """Counts the trigrams of all rows with ``text`` and ``lang``; rows that lack either are passed over.

    Every task adds up its own counts first, so no more than languages x buckets rows leave it.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in pieces(batches, most=1 << 20):
            bucket, doc, _ = trigrams(*flat(column(batch, "text")))
            names, code = np.unique(np.array(column(batch, "lang").to_pylist(), object).astype(str), return_inverse=True)
            both = np.bincount(code[doc] * (1 << BUCKET_BITS) + bucket, minlength=len(names) << BUCKET_BITS).reshape(len(names), -1)
            for i, name in enumerate(names.tolist()):
                counts[name] = counts.get(name, 0) + both[i]
        for name, count in counts.items():
            at = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(count[at])], ["lang", "bucket", "n"])

    rows = (docs.select("text", F.col("lang").cast("string").alias("lang")).filter("text is not null and lang is not null")
            .mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas())
    names = sorted(set(rows["lang"]))
    number = {name: i for i, name in enumerate(names)}
    count = np.full((1 << BUCKET_BITS, len(names)), 0.5)
    np.add.at(count, (rows["bucket"].to_numpy(int), rows["lang"].map(number).to_numpy(int)), rows["n"].to_numpy(float))
    return Model(names, np.log(count / count.sum(0)).astype(np.float32))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score`` (the language's proportion) of every whole ``text``.

    ``und`` with score 0 if the text is null, has no letter, or no language was learned; a text whose letters form no
    trigram gets the first language by name, with score 1 / languages.
    """
    names = [*model.names, "und"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, most=1 << 20):
            best, score = model.predict(*flat(column(batch, "text")))
            letter = column(batch, "letter").fill_null(False).to_numpy(zero_copy_only=False).astype(bool) & (len(names) > 1)
            unknown = letter & (best < 0)
            best = np.where(unknown, 0, np.where(letter, best, len(names) - 1))
            score = np.where(unknown, 1 / max(len(names) - 1, 1), np.where(letter, score, 0.0))
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array([names[i] for i in best], pa.string()), pa.array(score)],
                                             ["doc_id", "lang_pred", "score"])

    docs = docs.select("doc_id", F.col("text").rlike(r"\p{L}").alias("letter"), "text")
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")
