"""Model hooks: functions the user supplies, applied per Arrow batch, and repeatable stand-ins.

A hook *factory* takes no argument and returns the function. It is called once in each Python worker of a job, however many tasks
the worker runs, so a model is loaded once per worker:

* embedder: ``list[str] -> array (n, dim)``
* pair scorer: ``(list[str] queries, list[str] texts) -> array (n,)``
* generator: ``str -> str``; what it raises becomes an error row

The stand-ins make no claim about quality. They exist so that jobs can be run and tested.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from corpusloom.schemas import VECTOR, ModelSpec


# Text of a batch that is embedded at once, tokens whose cells the stand-in keeps, and characters of the longest such token.
BATCH_BYTES = 1 << 20
KNOWN_TOKENS = 1 << 16
KNOWN_LENGTH = 64

_made: dict[str, object] = {}


def made_once(token: str, factory: Callable, *settings):
    """The function of ``factory`` in this worker. A worker keeps the four that it has made last."""
    if token not in _made:
        while len(_made) >= 4:
            _made.pop(next(iter(_made)))
        _made[token] = factory(*settings)
    return _made[token]


def here():
    """This module as the worker has imported it; functions that travel with a job bring copies of what they name."""
    import importlib

    return importlib.import_module("corpusloom.functions.hooks")


def hashed_tokens(dim: int = 64) -> Callable[[], Callable[[list[str]], np.ndarray]]:
    """Stand-in embedder: a signed bag of hashed tokens of unit length."""

    def factory():
        known: dict[str, tuple[int, float]] = {}

        def cell(token: str) -> tuple[int, float]:
            if token not in known:
                digest = hashlib.md5(token.encode()).hexdigest()
                made = (int(digest[:8], 16) % dim, 1.0 if digest[8] < "8" else -1.0)
                if len(token) > KNOWN_LENGTH:
                    return made
                if len(known) >= KNOWN_TOKENS:
                    known.clear()
                known[token] = made
            return known[token]

        def embed(texts: list[str]) -> np.ndarray:
            counts = np.zeros((len(texts), dim))
            for row, text in enumerate(texts):
                # The tokens of one text at a time.
                cells = np.array([cell(token) for token in text.lower().split()]).reshape(-1, 2)
                counts[row] = np.bincount(cells[:, 0].astype(int), cells[:, 1], dim)
            norm = np.sqrt((counts ** 2).sum(axis=1, keepdims=True))
            return np.divide(counts, norm, out=np.zeros_like(counts), where=norm > 0)

        return embed

    return factory


def text_bytes(column: pa.Array) -> np.ndarray:
    """Bytes of text in each row of a column of strings or of lists of strings."""
    if pa.types.is_null(column.type):
        return np.zeros(len(column), np.int64)
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        ends = np.concatenate([[0], np.cumsum(text_bytes(column.values))])
        offsets = column.offsets.to_numpy()
        return ends[offsets[1:]] - ends[offsets[:-1]]
    return pc.fill_null(pc.binary_length(column), 0).to_numpy().astype(np.int64)


def bounded(batches: Iterator[pa.RecordBatch], *texts: str) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``BATCH_BYTES`` of text: texts are long, and a batch of Spark's holds thousands of them. A longer text is a batch of its own."""
    for batch in batches:
        size = sum(text_bytes(batch.column(batch.schema.get_field_index(text))) for text in texts)
        ends, start = np.cumsum(size), 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + BATCH_BYTES, "right")))
            yield batch.slice(start, end - start)
            start = end


def embed_column(df: DataFrame, factory, text: str = "content", out: str = "embedding") -> DataFrame:
    """Add the embedding of a text column. Column names are kept; ``out`` is appended or replaced.

    The embedder gets batches of bounded text, however long the texts are.
    """
    kept = [name for name in df.columns if name != out]
    schema = T.StructType([df.schema[name] for name in kept] + [T.StructField(out, VECTOR)])
    token = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embed = here().made_once(token, factory)
        for batch in bounded(batches, text):
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            matrix = np.asarray(embed([t or "" for t in texts]), dtype=np.float32).reshape(len(texts), -1)
            offsets = np.arange(len(texts) + 1, dtype=np.int32) * matrix.shape[1]
            vectors = pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(name)) for name in kept] + [vectors],
                names=kept + [out])

    return df.select(*kept).mapInArrow(run, schema)


def score_pairs(df: DataFrame, factory, query: str = "query", text: str = "content",
                out: str = "score") -> DataFrame:
    """Add a pair score, higher is better, for each (query, text) row."""
    kept = [name for name in df.columns if name != out]
    schema = T.StructType([df.schema[name] for name in kept] + [T.StructField(out, T.DoubleType())])
    token = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = here().made_once(token, factory)
        for batch in batches:
            given = {name: batch.column(batch.schema.get_field_index(name)) for name in kept}
            values = predict(given[query].to_pylist(), given[text].to_pylist())
            yield pa.RecordBatch.from_arrays(
                list(given.values()) + [pa.array(np.asarray(values, dtype=np.float64))], names=kept + [out])

    return df.select(*kept).mapInArrow(run, schema)


def generate(df: DataFrame, factory, spec: ModelSpec = ModelSpec(), prompt: str = "prompt",
             active: Column | None = None) -> DataFrame:
    """Add ``content, success, error`` from a generator; each failure is a row, the job goes on.

    ``factory`` receives the model settings. An empty prompt is an error row and calls no model.
    Rows where ``active`` is false get nulls. Prompts are taken in batches of bounded text, since each may repeat several whole texts.
    """
    kept = df.columns
    schema = T.StructType([*df.schema.fields, T.StructField("content", T.StringType()),
                           T.StructField("success", T.BooleanType()), T.StructField("error", T.StringType())])
    token = uuid.uuid4().hex
    flagged = df.withColumn("__active", F.lit(True) if active is None else F.coalesce(active, F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = here().made_once(token, factory, spec)

        def answer(text: str | None, wanted: bool):
            if not wanted:
                return None, None, None
            if not text:
                return "", False, "Invalid input message"
            try:
                return model(text), True, None
            except Exception as problem:  # a failed call must not end the job
                return "", False, str(problem)

        for batch in bounded(batches, prompt):
            given = {name: batch.column(batch.schema.get_field_index(name)) for name in kept}
            wanted = batch.column(batch.schema.get_field_index("__active")).to_pylist()
            rows = [answer(text, flag) for text, flag in zip(given[prompt].to_pylist(), wanted)]
            columns = [pa.array([row[i] for row in rows], kind)
                       for i, kind in enumerate((pa.string(), pa.bool_(), pa.string()))]
            yield pa.RecordBatch.from_arrays(list(given.values()) + columns,
                                             names=list(kept) + ["content", "success", "error"])

    return flagged.mapInArrow(run, schema)


def generate_chat(messages: DataFrame, factory, spec: ModelSpec = ModelSpec()) -> DataFrame:
    """One reply per call from a model that takes a message list: ``call_id, content, success, error``.

    ``messages`` has ``call_id, position, kind, text``. The function from ``factory`` gets
    ``[(kind, text), ...]``. Messages stream through the task in order, and only those of one call, which
    the model has to be given anyway, are held at a time. A call whose last message is empty is an
    error row.
    """
    id_type, token = messages.schema["call_id"].dataType, uuid.uuid4().hex
    schema = T.StructType([T.StructField("call_id", id_type), T.StructField("content", T.StringType()),
                           T.StructField("success", T.BooleanType()), T.StructField("error", T.StringType())])
    ordered = (messages.select("call_id", "position", "kind", "text").repartition("call_id")
               .sortWithinPartitions("call_id", "position"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = here().made_once(token, factory, spec)

        def answer(call) -> dict:
            call_id, history = call
            if not history[-1][1]:
                return {"call_id": call_id, "content": "", "success": False, "error": "Invalid input message"}
            try:
                return {"call_id": call_id, "content": model(history), "success": True, "error": None}
            except Exception as problem:  # a failed call must not end the job
                return {"call_id": call_id, "content": "", "success": False, "error": str(problem)}

        def packed(rows: list[dict], id_kind: pa.DataType) -> pa.RecordBatch:
            kinds = {"call_id": id_kind, "content": pa.string(), "success": pa.bool_(), "error": pa.string()}
            return pa.RecordBatch.from_arrays([pa.array([row[name] for row in rows], kind) for name, kind in kinds.items()],
                                              names=list(kinds))

        current = None
        for batch in batches:
            id_kind, done = batch.schema.field("call_id").type, []
            given = {name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names)}
            for call_id, kind, text in zip(given["call_id"], given["kind"], given["text"]):
                if current is None or current[0] != call_id:
                    if current is not None:
                        done.append(answer(current))
                    current = (call_id, [])
                current[1].append((kind, text))
            yield packed(done, id_kind)
        if current is not None:
            yield packed([answer(current)], id_kind)

    return ordered.mapInArrow(run, schema)


def first_hit() -> Callable[[ModelSpec], Callable[[str], str]]:
    """Stand-in generator: repeats the first retrieved text, or the sentence for "nothing found"."""

    def factory(spec: ModelSpec):
        first = re.compile(r"1\. \[Score: [^]]*\]\n   (.*?)(?:\n   Metadata: |\n\n2\. \[Score: |\n\Z)", re.DOTALL)

        def answer(prompt: str) -> str:
            shown = re.search(r"^Context: (.*)$", prompt, re.MULTILINE)
            info = json.loads(shown.group(1)).get("retrieved_info", "") if shown else ""
            hit = first.search(info)
            return hit.group(1) if hit else info

        return answer

    return factory
