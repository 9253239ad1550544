"""Merkle manifest of a table: a digest tree for each group of rows, a tree over the groups, and a witness for every row.

Rows are numbered in order inside their group and dealt into aligned blocks of ``BLOCK`` leaves. A task appends the leaves of a
block one after the other. It keeps only the open subtrees; each leaf's witness is partial until its subtrees are completed: when a
subtree meets its sibling, the digest of each is attached to the witnesses of all leaves below the other. Block roots are appended in
the same way in the next round, in blocks of their own, and so are the roots of the groups; a leaf's witness is then
extended by that of its block. A round has 1/``BLOCK`` of the rows of the one before, and no task holds more than one block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.session import BROADCAST_KEY_BYTES, key_bytes, released, written

LEVELS = 10
BLOCK = 1 << LEVELS
# Rows of one task that numbers or appends.
TASK_ROWS = 200_000
#: Steps of a witness: the other digest stands to the left or right; a node without sibling is hashed alone.
ALONE, RIGHT, LEFT = 0, 1, 2
SIDES = ("alone", "right", "left")
PATH = "array<struct<side:string,digest:string>>"
APPENDED = "tree string, position long, size long, root binary, leaves int, siblings binary, sides binary"
HEX = np.frombuffer("".join(f"{i:02x}" for i in range(256)).encode(), np.uint8).reshape(256, 2)


def leaf_digest(*values: Column) -> Column:
    """Digest (lowercase hex) of values: ``-`` for a null, else the value's bytes in UTF-8, a colon and the value."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def node_digest(*below: bytes) -> bytes:
    return hashlib.sha256("".join(d.hex() for d in below).encode()).digest()


def append(leaves: Sequence[bytes], levels: int) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Appends the leaves of an aligned block to an empty tree of so many levels.

    Gives the root, and for each leaf and level the sibling (32 bytes) and its side.
    """
    n = len(leaves)
    siblings, sides = np.zeros((n, levels, 32), np.uint8), np.full((n, levels), ALONE, np.uint8)
    # Open subtrees from the left to the right: level, first leaf, digest.
    open_subtrees: list[tuple[int, int, bytes]] = []

    def close(level: int, first: int, digest: bytes, end: int) -> None:
        while open_subtrees and open_subtrees[-1][0] == level:
            _, start, left = open_subtrees.pop()
            siblings[start:first, level] = np.frombuffer(digest, np.uint8)
            siblings[first:end, level] = np.frombuffer(left, np.uint8)
            sides[start:first, level], sides[first:end, level] = RIGHT, LEFT
            level, first, digest = level + 1, start, node_digest(left, digest)
        open_subtrees.append((level, first, digest))

    for i, leaf in enumerate(leaves):
        close(0, i, leaf, i + 1)
    while open_subtrees[-1][0] < levels:
        level, first, digest = open_subtrees.pop()
        close(level + 1, first, node_digest(digest), n)
    return open_subtrees[-1][2], siblings, sides


def _append_block(payload: bool):
    """The nodes of one block of one tree as one row."""
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("position")
        size, position = table["size"][0].as_py(), table["position"][0].as_py()
        root, siblings, sides = append(table["digest"].to_pylist(), LEVELS if size > BLOCK else (size - 1).bit_length())
        row = {"tree": table["tree"][0].as_py(), "position": position // BLOCK, "size": -(-size // BLOCK), "root": root, "leaves": table.num_rows,
               "siblings": siblings.tobytes(), "sides": sides.tobytes()}
        if payload:
            row["payload"] = table.select(["order", "digest", "altered"]).to_pylist()
        return pa.Table.from_pylist([row], _arrow(payload, table.schema))
    return run


def _arrow(payload: bool, schema: pa.Schema) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [(n, kinds[k]) for n, k in (f.split(" ") for f in APPENDED.split(", "))]
    if payload:
        fields.append(("payload", pa.list_(pa.struct([("order", schema.field("order").type), ("digest", pa.binary()), ("altered", pa.binary())]))))
    return pa.schema(fields)


def numbered(rows: DataFrame, label: str) -> DataFrame:
    """``rows`` (``tree``, never null, ``order``, ``digest`` and more) with ``position`` in its tree by ``order`` (nulls first) and ``size`` of the tree.

    Equal orders go by digest. The rows are sorted by ranges of tree and order, so that a large tree is dealt over many tasks; a task numbers its own
    rows, and counts of the tasks before, summed up in order, make the numbers run on.
    """
    rows = written(rows.withColumn("tie", F.monotonically_increasing_id()), label)
    order = ["tree", F.asc_nulls_first("order"), "digest", "tie"]
    tasks = max(1, -(-rows.count() // TASK_ROWS))
    sorted_rows = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order).drop("tie").withColumn("task", F.spark_partition_id())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n = None, 0
        for batch in batches:
            tree = batch.column("tree").to_pylist()
            place = np.empty(len(tree), np.int64)
            for i, t in enumerate(tree):
                n = n + 1 if t == last else 0
                place[i], last = n, t
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place)], [*batch.schema.names, "place"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sorted_rows.schema)
    sorted_rows = written(sorted_rows.mapInArrow(count, f"{kinds}, place long"), label)
    counts = sorted_rows.groupBy("tree", "task").agg((F.max("place") + 1).alias("n"))
    before = F.sum("n").over(Window.partitionBy("tree").orderBy("task")) - F.col("n")
    counts = written(counts.select("tree", "task", before.alias("before"), F.sum("n").over(Window.partitionBy("tree")).alias("size")), label)
    found = _joined(sorted_rows, counts, ["tree", "task"])
    return found.withColumn("position", F.col("before") + F.col("place")).drop("task", "place", "before")


def _joined(rows: DataFrame, few: DataFrame, on: list[str]) -> DataFrame:
    """Join with a written table, which is broadcast when its measured bytes are within the bound."""
    return rows.join(F.broadcast(few) if key_bytes(few) <= BROADCAST_KEY_BYTES else few, on)


def _grown(nodes: DataFrame, payload: bool) -> list[DataFrame]:
    """The rounds of appends, from the leaves on, until each tree is one node; each a written table with a row for each block."""
    rounds, fields = [], APPENDED
    if payload:
        kind = nodes.schema["order"].dataType.simpleString()
        fields += f", payload array<struct<order:{kind},digest:binary,altered:binary>>"
    while True:
        blocks = nodes.withColumn("block", F.floor(F.col("position") / BLOCK)).groupBy("tree", "block")
        rounds.append(written(blocks.applyInArrow(_append_block(payload), fields), "merkle"))
        if (rounds[-1].agg(F.max("size")).first()[0] or 1) == 1:
            return rounds
        nodes, payload, fields = rounds[-1].select("tree", "position", "size", F.col("root").alias("digest")), False, APPENDED


def _extended(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """The nodes of the blocks with their witnesses, each extended by the witness of its block in ``above`` (``tree``, ``position``, ``siblings``, ``sides``, ...)."""
    upper = above.withColumnsRenamed({"siblings": "upper_siblings", "sides": "upper_sides"})
    more = [n for n in upper.columns if n not in ("tree", "position", "upper_siblings", "upper_sides")]
    rows = _joined(blocks.drop("size", "root"), upper, ["tree", "position"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n = row["leaves"]
                siblings, sides = _witnesses(row, n)
                out = {"tree": [row["tree"]] * n, "position": list(range(row["position"] * BLOCK, row["position"] * BLOCK + n)),
                       "siblings": [x.tobytes() for x in siblings], "sides": [x.tobytes() for x in sides]} | {m: [row[m]] * n for m in more}
                yield pa.RecordBatch.from_pydict(out, pa.schema([(k, schema[k]) for k in out]))

    schema = {"tree": pa.string(), "position": pa.int64(), "siblings": pa.binary(), "sides": pa.binary()} | {m: pa.string() for m in more}
    return rows.mapInArrow(run, ", ".join(f"`{k}` {'long' if k == 'position' else 'string' if k == 'tree' or k in more else 'binary'}" for k in schema))


def _witnesses(row: dict, n: int) -> tuple[np.ndarray, np.ndarray]:
    sides = np.frombuffer(row["sides"], np.uint8).reshape(n, -1) if row["sides"] else np.zeros((n, 0), np.uint8)
    siblings = np.frombuffer(row["siblings"], np.uint8).reshape(n, -1, 32) if row["sides"] else np.zeros((n, 0, 32), np.uint8)
    upper_sides = np.frombuffer(row["upper_sides"], np.uint8)
    upper = np.frombuffer(row["upper_siblings"], np.uint8).reshape(-1, 32)
    return (np.concatenate([siblings, np.broadcast_to(upper, (n, *upper.shape))], 1),
            np.concatenate([sides, np.broadcast_to(upper_sides, (n, *upper_sides.shape))], 1))


def _hex(digests: np.ndarray) -> np.ndarray:
    return HEX[digests].reshape(*digests.shape[:-1], 64)


def _strings(digests: list[bytes | None]) -> pa.Array:
    return pa.array([None if d is None else d.hex() for d in digests], pa.string())


def _paths(siblings: np.ndarray, sides: np.ndarray) -> pa.Array:
    """A list of steps for each leaf; a step of a node without sibling has an empty digest."""
    n, levels = sides.shape
    there = sides != ALONE
    data = _hex(siblings)[there].tobytes()
    ends = np.concatenate([[0], np.cumsum(there.ravel() * 64)]).astype(np.int32)
    digests = pa.StringArray.from_buffers(n * levels, pa.py_buffer(ends.tobytes()), pa.py_buffer(data))
    names = pa.DictionaryArray.from_arrays(pa.array(sides.ravel().astype(np.int8)), pa.array(SIDES)).cast(pa.string())
    steps = pa.StructArray.from_arrays([names, digests], ["side", "digest"])
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * levels), steps)


def manifest(docs: DataFrame, columns: Sequence[str], group: str, order: str, altered: dict[str, Column] | None = None, when: Column | None = None) -> DataFrame:
    """``order`` column, ``leaf``, ``altered`` (the leaf with the values of ``altered`` where ``when`` holds, else null), ``subroot``, ``root`` and ``path``.

    A leaf is the digest of ``columns``. The leaves of each ``group`` (a string; null is a group of its own and the first) ascend by ``order`` (nulls first,
    equal ones by digest); every two nodes give the digest of both in hex, a last one without sibling that of its own, until one is left; the groups' roots, in
    bytewise order of the groups, give ``root`` in the same way. ``path`` has the steps from the leaf to the root: ``side`` of the
    sibling and its ``digest``, empty for a node hashed alone. Repeated rows are leaves of their own. No rows give no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    leaf = F.unhex(leaf_digest(*(F.col(c) for c in columns)))
    other = F.lit(None).cast("binary")
    if altered:
        other = F.when(F.coalesce(when, F.lit(False)), F.unhex(leaf_digest(*(altered.get(c, F.col(c)) for c in columns))))
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    with released(spark):
        leaves = numbered(docs.select(tree.alias("tree"), F.col(order).alias("order"), leaf.alias("digest"), other.alias("altered")), "leaves")
        rounds = _grown(leaves, payload=True)
        tops = rounds[-1].select(F.lit("").alias("tree"), F.col("tree").alias("order"), F.col("root").alias("digest"))
        tops = written(numbered(tops, "groups"), "groups")
        upper = _grown(tops, payload=False)
        top = upper[-1].select("tree", "position", F.lit(b"").alias("siblings"), F.lit(b"").alias("sides"), F.lower(F.hex("root")).alias("root"))
        for blocks in reversed(upper):
            top = written(_extended(blocks, top), "witnesses")
        above = top.join(tops.select("position", F.col("order").alias("name"), F.lower(F.hex("digest")).alias("subroot")), "position")
        above = written(above.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("position"), "siblings", "sides", "subroot", "root"), "witnesses")
        for blocks in reversed(rounds[1:]):
            above = written(_extended(blocks, above), "witnesses")
    rows = _joined(rounds[0].drop("size", "root"), above.withColumnsRenamed({"siblings": "upper_siblings", "sides": "upper_sides"}), ["tree", "position"])
    kind = docs.schema[order].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                payload = batch.column("payload").slice(i, 1).flatten()
                row = batch.drop_columns(["payload"]).slice(i, 1).to_pylist()[0]
                n = len(payload)
                siblings, sides = _witnesses(row, n)
                columns = [payload.field("order"), _strings(payload.field("digest").to_pylist()), _strings(payload.field("altered").to_pylist()),
                           pa.array([row["subroot"]] * n, pa.string()), pa.array([row["root"]] * n, pa.string()), _paths(siblings, sides)]
                yield pa.RecordBatch.from_arrays(columns, [order, "leaf", "altered", "subroot", "root", "path"])

    return rows.mapInArrow(run, f"`{order}` {kind}, leaf string, altered string, subroot string, root string, path {PATH}")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the steps of its path lead to."""
    def step(digest: Column, s: Column) -> Column:
        return F.sha2(F.when(s["side"] == "left", F.concat(s["digest"], digest)).otherwise(F.concat(digest, s["digest"])), 256)

    return F.aggregate(path, leaf, step)
