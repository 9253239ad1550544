"""Toxicity: a linear classifier of character n-grams whose features are scaled by naive Bayes log-count ratios.

A feature is an n-gram of three to six characters of the text in lower case (A-Z), present or not. Its value is the log ratio of
its smoothed document rates in toxic and other training texts. Every n-gram that stands in enough training texts and whose rates differ
enough is a feature, however many there are; a logistic regression over them gives the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusloom.llm.batches import column, pieces

ORDERS = (3, 4, 5, 6)
#: The classifier is fitted on at most so many labelled rows, those with the smallest hashes of their ids.
TRAIN_ROWS = 5_000
#: Training texts that an n-gram must stand in, and the least size of its log ratio; both are thresholds, not caps.
LEAST_SUPPORT = 4
LEAST_RATIO = 1.0
MIX = np.uint64(0x9E3779B97F4A7C15)
FILTER_BITS = 24


SPACES = (9, 10, 11, 12, 13)


def characters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, A-Z in lower case and white space as blanks, and the offsets of each; a null counts as empty."""
    raw = [(t or "").encode("utf-32-le", "surrogatepass") for t in texts.to_pylist()]
    data = np.frombuffer(b"".join(raw), np.uint32).copy()
    data[(data >= ord("A")) & (data <= ord("Z"))] += 32
    data[np.isin(data, SPACES)] = 32
    return data, np.cumsum([0, *(len(r) // 4 for r in raw)])


def grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: the n-grams as hashes of 64 bits, and the positions at which they begin. Texts are edged with a space."""
    n = len(offsets) - 1
    out = np.full(len(data) + 2 * n, 32, np.uint64)
    out[np.arange(len(data)) + 2 * np.repeat(np.arange(n), np.diff(offsets)) + 1] = data
    ends = offsets[1:] + 2 * np.arange(1, n + 1)
    h = out.copy()
    for order in range(2, max(ORDERS) + 1):
        h = h[:-1] * MIX + out[order - 1:] if len(h) else h
        if order in ORDERS:
            whole = np.ones(len(h), bool)
            for back in range(1, order):
                whole[(ends - back)[ends - back < len(h)]] = False
            at = np.flatnonzero(whole)
            gram = (h[at] ^ (h[at] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(order)
            yield gram ^ (gram >> np.uint64(32)), at


def documents_of(at: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.searchsorted(offsets[1:] + 2 * np.arange(1, len(offsets)), at, "right")


@dataclass
class Model:
    """Sorted n-grams with weight times ratio of each, and the intercept."""

    grams: np.ndarray
    weights: np.ndarray
    intercept: float

    def present(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of document and feature, each once. A bit table drops nearly all n-grams before the exact look-up."""
        table = np.zeros(1 << FILTER_BITS, bool)
        table[(self.grams * MIX) >> np.uint64(64 - FILTER_BITS)] = True
        found = [np.zeros(0, np.int64)]
        for gram, at in grams(data, offsets):
            maybe = table[(gram * MIX) >> np.uint64(64 - FILTER_BITS)]
            gram, at = gram[maybe], at[maybe]
            i = np.minimum(np.searchsorted(self.grams, gram), max(len(self.grams) - 1, 0))
            same = self.grams[i] == gram if len(self.grams) else np.zeros(len(gram), bool)
            found.append(np.unique(documents_of(at[same], offsets) * max(len(self.grams), 1) + i[same]))
        both = np.concatenate(found)
        return both // max(len(self.grams), 1), both % max(len(self.grams), 1)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        doc, feature = self.present(data, offsets)
        z = np.bincount(doc, self.weights[feature], len(offsets) - 1) + self.intercept
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        data, offsets = characters(column(batch, "text"))
        toxic = column(batch, "toxic").to_numpy(zero_copy_only=False)
        for gram, at in grams(data, offsets):
            doc = documents_of(at, offsets)
            order = np.lexsort((doc, gram))
            gram, doc = gram[order], doc[order]
            once = np.ones(len(gram), bool)
            once[1:] = (gram[1:] != gram[:-1]) | (doc[1:] != doc[:-1])
            gram, doc = gram[once], doc[once]
            values, first = np.unique(gram, return_index=True)
            if not len(values):
                continue
            hits = np.add.reduceat(toxic[doc].astype(np.int64), first)
            rows = np.diff(np.append(first, len(gram)))
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(hits), pa.array(rows)], ["gram", "toxic", "rows"])


def ratios(rows: DataFrame, n: int, n_toxic: int, least_support: int, least_ratio: float) -> tuple[np.ndarray, np.ndarray]:
    """N-grams in order, and the log ratio of each, of ``rows`` (``text``, ``toxic``), of which there are ``n`` and ``n_toxic`` toxic ones."""
    seen = rows.mapInArrow(_counts, "gram long, toxic long, rows long").groupBy("gram").agg(F.sum("toxic").alias("t"), F.sum("rows").alias("r"))
    ratio = F.log((F.col("t") + 1) / (n_toxic + 1)) - F.log((F.col("r") - F.col("t") + 1) / (n - n_toxic + 1))
    # The n-grams of at most max_rows texts that stand in several of them.
    best = (seen.filter(F.col("r") >= least_support).withColumn("ratio", ratio).filter(F.abs("ratio") >= least_ratio).select("gram", "ratio").toArrow())
    gram, ratio = best["gram"].to_numpy().view(np.uint64), best["ratio"].to_numpy()
    order = np.argsort(gram)
    return gram[order], ratio[order]


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = TRAIN_ROWS, least_support: int = LEAST_SUPPORT, least_ratio: float = LEAST_RATIO) -> Model:
    """Fits on at most ``max_rows`` rows of ``labels`` (``doc_id``, ``toxic`` 0 or 1), a bounded sample by hash of the id.

    Labels that are null or neither 0 nor 1, ids that are null, and rows without a text are passed over; of a repeated id the
    largest label counts. Without labels of both kinds the model has no features and its score is the share of toxic rows (0.0 without any).
    """
    chosen = (labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)")
              .groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    # At most max_rows pairs of numbers are broadcast.
    rows = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic")
    n, n_toxic = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < n_toxic < n:
        return Model(np.zeros(0, np.uint64), np.zeros(0), 60.0 if n and n_toxic == n else -60.0)
    model = Model(*ratios(rows, n, n_toxic, least_support, least_ratio), 0.0)

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            doc, feature = model.present(*characters(column(batch, "text")))
            sort = np.argsort(doc, kind="stable")
            ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=batch.num_rows))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(feature[sort].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "toxic"), lists], ["doc_id", "toxic", "features"])

    # A row of the sample carries the features it has, at most so many numbers as there are features.
    sample = rows.mapInArrow(present, "doc_id long, toxic int, features array<int>").toPandas().sort_values("doc_id", kind="stable")
    if sample.empty:
        return Model(np.zeros(0, np.uint64), np.zeros(0), -60.0)
    model.weights, model.intercept = _regression(
        [np.asarray(x, np.int64) for x in sample["features"]], sample["toxic"].to_numpy(float), model.weights)
    return model


def _regression(features: list[np.ndarray], label: np.ndarray, ratio: np.ndarray, steps: int = 300, penalty: float = 1.0) -> tuple[np.ndarray, float]:
    """Logistic regression with a quadratic penalty, by Adam over all rows; gives weight times ratio."""
    column_ = np.concatenate(features) if features else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(features)), [len(f) for f in features])
    value = ratio[column_]
    w, n = np.zeros(len(ratio) + 1), len(label)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        z = np.bincount(row, value * w[column_], n) + w[-1]
        error = 1 / (1 + np.exp(-np.clip(z, -60, 60))) - label
        g = np.append(np.bincount(column_, value * error[row], len(ratio)) + penalty * w[:-1], error.sum()) / n
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.02 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return w[:-1] * ratio, float(w[-1])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``score`` (0 to 1) of the whole ``text``; one row per row. Null counts as an empty text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, most=1 << 20):
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(model.score(*characters(column(batch, "text"))))], ["doc_id", "score"])

    docs = docs.select("doc_id", "text")
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` and ``toxicity_score``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, most=1 << 20):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(*characters(column(batch, "text"))))], [*batch.schema.names, "toxicity_score"])

    from pyspark.sql.types import DoubleType, StructType

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add("toxicity_score", DoubleType()))
