"""Table schemas and immutable job parameters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

METADATA = T.MapType(T.StringType(), T.StringType())
VECTOR = T.ArrayType(T.FloatType())

DOCUMENT_SCHEMA = T.StructType([
    T.StructField("doc_id", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("metadata", METADATA),
    T.StructField("embedding", VECTOR),
    T.StructField("content_key", T.StringType()),
])

STEP_RESULT = T.StructType([
    T.StructField("agent", T.StringType()),
    T.StructField("action", T.StringType()),
    T.StructField("success", T.BooleanType()),
    T.StructField("output", T.StringType()),
])


@dataclass(frozen=True)
class RetrievalParams:
    """Parameters of one retrieval job. The defaults."""

    top_k: int = 5
    threshold: float = 0.7
    multiplier: int = 4
    rrf_k: int = 60
    metric: str = "l2"
    score: str = "one_minus"
    secondary_metric: str = "cosine"
    bm25_respects_filter: bool = False

    @property
    def candidate_k(self) -> int:
        return self.top_k * self.multiplier


@dataclass(frozen=True)
class BlockLimits:
    """Memory bounds of the block search."""

    broadcast_bytes: int = 64 << 20  # query block that may be sent to every executor
    doc_rows: int = 100_000          # documents of one cell or part handled by one task; a part may have more where queries would be copied too often
    doc_bytes: int = 64 << 20        # bytes of the documents of a part, always kept
    query_copies: int = 24           # parts that a query is sent to, unless more are needed to keep doc_bytes
    query_rows: int = 20_000         # queries of one cell handled by one task
    matrix_cells: int = 1 << 22      # (query, document) scores held at once inside a task
    task_pairs: int = 1 << 32        # (query, document) scores of one part that one task makes, one after the other
    reduce_groups: int | None = None  # groups of tasks cut to k rows per query before the final cut; None: the root of the number of splits, from 64 splits on


@dataclass(frozen=True)
class ModelSpec:
    """What a generation hook is told about the model it should call."""

    model_name: str = ""
    temperature: float | None = None
    max_tokens: int | None = None
    system_prompt: str = ""
    context_tokens: int | None = None  # estimated tokens of a conversation that one call may hold
