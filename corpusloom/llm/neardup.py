"""Near-duplicate documents by MinHash with sequential Bayesian verification.

Rows with equal shingle sets form a class, and only the class with its smallest id goes on. Signatures are cut into
bands; classes that agree in a band are candidates. The signatures of a candidate pair are compared batch by batch:
after n values of which m agree, the similarity has a Beta posterior, and the pair is dropped as soon as the
probability that it still reaches the threshold falls below the chosen miss probability. Survivors are confirmed on their full sets.

No group is expanded into pairs. Each class is first compared with one other, the smallest id of all its buckets. Buckets that still hold
several components are then compared within, inside the tasks and in blocks of bounded size, only between components: first each block gives a forest
of its most similar pairs, fewer than its members, which joins most components; then every plausible pair that is left, across all
blocks of a bucket, is confirmed on the full sets inside its task, so no link between components is missed and only links leave the task.

Two texts at the threshold of 0.8 share none of the 48 bands of 6 values with probability 5e-7.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusloom.llm.batches import column, flat, pieces
from corpusloom.llm.components import components
from corpusloom.llm.shingles import MIX, mixed, shingle_sets
from corpusloom.session import released, written

BANDS, BAND_ROWS = 48, 6
HASHES = BANDS * BAND_ROWS
STEP = 32
MISS = 1e-7
BLOCK = 1024
# Ids to look up in the documents are broadcast up to this number (a hash table of 16 bytes each), shuffled beyond it.
BROADCAST_IDS = 1_000_000
_A = (mixed(np.arange(1, HASHES + 1, dtype=np.uint64) * MIX) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (mixed(np.arange(1, HASHES + 1, dtype=np.uint64) + MIX) >> np.uint64(32)).astype(np.uint32)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of 16-bit minimum values for each set that is not empty."""
    sets = [s for s in sets if len(s)]
    out = np.zeros((len(sets), HASHES), np.uint16)
    start = 0
    while start < len(sets):
        end, total = start, 0
        while end < len(sets) and (end == start or total + len(sets[end]) <= 1 << 16):
            total += len(sets[end])
            end += 1
        x = (np.concatenate(sets[start:end]) >> np.uint64(32)).astype(np.uint32)
        first = np.cumsum([0, *(len(s) for s in sets[start:end - 1])])
        value = np.empty_like(x)
        for j in range(HASHES):
            np.multiply(x, _A[j], out=value)
            np.add(value, _B[j], out=value)
            # The lowest bits of such a product are weak, its order is not: the high half of the minimum is kept.
            out[start:end, j] = (np.minimum.reduceat(value, first) * np.uint32(0x9E3779B1)) >> np.uint32(16)
        start = end
    return out


def least_matches(share: float, miss: float = MISS) -> list[int]:
    """For each n = 0, STEP, 2 STEP, ...: how many of n values must agree for a pair to stay.

    With a uniform prior the posterior of the similarity s is Beta(m + 1, n - m + 1), and P(s >= share) is the
    probability that a binomial variable of n + 1 trials with chance ``share`` is at most m.
    """
    out = []
    for n in range(0, HASHES + 1, STEP):
        total, m = 0.0, -1
        while total < miss and m <= n:
            m += 1
            total += comb(n + 1, m) * share ** m * (1 - share) ** (n + 1 - m)
        out.append(m)
    return out


def plausible(a: np.ndarray, b: np.ndarray, left: np.ndarray, right: np.ndarray, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs (left[i], right[i]) of rows of ``a`` and ``b`` that no batch of values rules out, and how many values agree."""
    alive = np.arange(len(left))
    count = np.zeros(len(left), np.int32)
    for i in range(HASHES // STEP):
        if not len(alive):
            break
        cut = slice(i * STEP, (i + 1) * STEP)
        for s in range(0, len(alive), 1 << 15):
            part = alive[s:s + (1 << 15)]
            count[part] += (a[left[part], cut] == b[right[part], cut]).sum(1, dtype=np.int32)
        alive = alive[count[alive] >= least[i + 1]]
    return alive, count[alive]


def _matrix(binary: pa.Array) -> np.ndarray:
    data, _ = flat(binary)
    return data.view(np.uint16).reshape(len(binary), HASHES)


def _scan(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, most=1 << 20):
            sets = shingle_sets(*flat(column(batch, "text")), size)
            full = np.array([len(s) > 0 for s in sets])
            rows = signatures(sets)
            keys = np.zeros((2, len(sets)), np.uint64)
            for i, s in enumerate(sets):
                if len(s):
                    keys[0, i] = np.add.reduce(mixed(s)) + np.uint64(len(s))
                    keys[1, i] = np.bitwise_xor.reduce(mixed(s * MIX))
            raw, at = rows.tobytes(), iter(range(0, rows.nbytes, HASHES * 2))
            sig = [raw[(k := next(at)):k + HASHES * 2] if f else None for f in full.tolist()]
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys[0].view(np.int64)),
                 pa.array(keys[1].view(np.int64)), pa.array(sig, pa.binary())], ["doc_id", "n_shingles", "k1", "k2", "sig"])
    return run


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for s in range(0, batch.num_rows, 2048):
            part = batch.slice(s, 2048)
            h = _bands_of(_matrix(column(part, "sig")))
            ids = column(part, "id").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(h.ravel()), pa.array(np.repeat(ids, BANDS))], ["bucket", "id"])


def _compare(least: list[int]):
    """Pairs (id, sig, id2, sig2) that the signatures don't rule out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                row = np.arange(batch.num_rows)
                keep, _ = plausible(_matrix(column(batch, "sig_a")), _matrix(column(batch, "sig_b")), row, row, least)
                yield pa.RecordBatch.from_arrays([column(batch, n).take(pa.array(keep)) for n in ("a", "b")], ["a", "b"])
    return run


def _forest(left: np.ndarray, right: np.ndarray, component: np.ndarray, linked: Callable[[int], bool] = lambda n: True) -> list[int]:
    """Of pairs in order, those that are linked and join two components which no earlier one has joined."""
    root = {c: c for c in set(component.tolist())}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    keep, parts = [], len(root)
    for n, (i, j) in enumerate(zip(component[left].tolist(), component[right].tolist(), strict=True)):
        i, j = find(i), find(j)
        if i != j and linked(n):
            root[j] = i
            keep.append(n)
            if len(keep) == parts - 1:
                break
    return keep


def _bands_of(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(len(sig), BANDS, BAND_ROWS).astype(np.uint64)
    h = np.zeros(rows.shape[:2], np.uint64) + np.arange(BANDS, dtype=np.uint64)
    for r in range(BAND_ROWS):
        h = mixed(h * MIX + rows[:, :, r] + np.uint64(1))
    return h.view(np.int64)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of one bucket and pair of blocks at a time; they come sorted."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([column(batch, n).to_numpy() for n in ("bucket", "i", "j")])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
        if held and tuple(column(held[-1], n)[-1].as_py() for n in ("bucket", "i", "j")) != tuple(keys[:, 0].tolist()):
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        start = 0
        for cut in cuts.tolist():
            yield pa.Table.from_batches([*held, batch.slice(start, cut - start)]).combine_chunks()
            held, start = [], cut
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _open_pairs(rows: pa.Table, least: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Plausible pairs of rows between components, the most similar first; a pair that shares an earlier band is left to that band's bucket."""
    ids, component, side = (rows[n].to_numpy() for n in ("id", "component", "side"))
    if (component == component[0]).all():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), component
    sig = _matrix(rows["sig"].chunk(0))
    own = rows["i"][0] == rows["j"][0]
    left, right = np.nonzero((component[:, None] != component[None, :]) & ((ids[:, None] < ids[None, :]) if own else (side[:, None] < side[None, :])))
    keep, count = plausible(sig, sig, left, right, least)
    left, right = left[keep], right[keep]
    bands = _bands_of(sig)
    new = np.ones(len(left), bool)
    for b in range(int(np.flatnonzero(bands[0] == rows["bucket"][0].as_py())[0])):
        new &= bands[left, b] != bands[right, b]
    order = np.flatnonzero(new)[np.argsort(-count[new], kind="stable")]
    return left[order], right[order], component


def _pairs(ids: np.ndarray, left: np.ndarray, right: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[left], ids[right])), pa.array(np.maximum(ids[left], ids[right]))], ["a", "b"])


def _forests(least: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            left, right, component = _open_pairs(rows, least)
            keep = _forest(left, right, component)
            yield _pairs(rows["id"].to_numpy(), left[keep], right[keep])
    return run


def _undecided(least: list[int]):
    """Rows of blocks that have a plausible pair."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            left, right, _ = _open_pairs(rows, least)
            if len(left):
                yield from rows.take(pa.array(np.unique(np.concatenate([left, right])))).select(["bucket", "i", "j", "side", "id", "component"]).to_batches()
    return run


def _decided(least: list[int], percent: int):
    """Confirmed links of each block. A pair whose components an earlier link of the block has joined needs no look."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            left, right, component = _open_pairs(rows, least)
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows["hashes"].chunk(0)]
            keep = _forest(left, right, component, lambda n, left=left, right=right, sets=sets: _similar(sets[left[n]], sets[right[n]], percent))
            yield _pairs(rows["id"].to_numpy(), left[keep], right[keep])
    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, most=1 << 20):
            sets = shingle_sets(*flat(column(batch, "text")), size)
            yield pa.RecordBatch.from_arrays([column(batch, "id"), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "hashes"])
    return run


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    x, y = (x, y) if len(x) < len(y) else (y, x)
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [_similar(np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64), percent)
                    for a, b in zip(column(batch, "hashes_a"), column(batch, "hashes_b"), strict=True)]
            yield pa.RecordBatch.from_arrays([column(batch, n).filter(pa.array(keep, pa.bool_())) for n in ("a", "b")], ["a", "b"])
    return run


def _full_sets(ids: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """``id``, ``hashes``: the shingle sets of the given documents, as a written table."""
    ids = written(ids.distinct(), "ids")
    few = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    texts = docs.filter("doc_id is not null").select(F.col("doc_id").alias("id"), "text").join(few, "id", "left_semi")
    return written(texts.mapInArrow(_sets(size), "id long, hashes binary"), "sets")


def _confirmed(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (``a``, ``b``) whose full shingle sets reach the threshold."""
    sets = _full_sets(pairs.select(F.explode(F.array("a", "b")).alias("id")), docs, size)
    both = pairs.join(sets.toDF("a", "hashes_a"), "a").join(sets.toDF("b", "hashes_b"), "b")
    return both.mapInArrow(_confirm(percent), "a long, b long").distinct()


def _dealt(members: DataFrame) -> DataFrame:
    return members.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id``, ``kept`` of every row of ``docs`` (``doc_id`` long, ``text``).

    Two rows are linked if 100 * intersection >= ``percent`` * union of their shingle sets (words without white space, A-Z
    in lower case). ``component_id`` is the smallest id that links lead to, ``kept`` tells whether it is the row's own.
    A null text or one without words has an empty set and no links. Rows that repeat an id give a row each and are one document: what one of their
    texts is linked to, all are. A row without id takes no part (``component_id`` null, kept). Other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    least = least_matches(percent / 100)
    with released(spark):
        scanned = written(docs.mapInArrow(_scan(shingle), "doc_id long, n_shingles long, k1 long, k2 long, sig binary"), "signatures")
        part = scanned.filter("n_shingles > 0 and doc_id is not null")
        # Equal sets are one class; its signature is the same in all of its rows.
        classes = written(part.groupBy("k1", "k2").agg(F.min("doc_id").alias("id"), F.first("sig").alias("sig")), "classes")
        bands = classes.select("id", "sig").mapInArrow(_bands, "bucket long, id long")
        hubs = bands.groupBy("bucket").agg(F.min("id").alias("hub"), F.count("*").alias("n")).filter("n > 1")
        shared = written(bands.join(hubs, "bucket"), "buckets")
        sig = classes.select("id", "sig")
        pairs = shared.filter("hub <> id").groupBy(F.col("id").alias("b")).agg(F.min("hub").alias("a")).select("a", "b")
        rows = scanned.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("k1")).alias("k1"), "k2")
        rows = written(rows.join(classes.select("k1", "k2", "id"), ["k1", "k2"], "left").select("doc_id", "n_shingles", "id"), "rows")
        # Texts of one id are one document.
        same = rows.filter("id is not null").groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("b")).filter("a <> b")
        same = rows.join(same.select("doc_id", "a"), "doc_id").select("a", F.col("id").alias("b")).filter("a <> b")
        checked = written(pairs.join(sig.toDF("a", "sig_a"), "a").join(sig.toDF("b", "sig_b"), "b").mapInArrow(_compare(least), "a long, b long"), "pairs")
        links = written(_confirmed(checked, docs, shingle, percent).union(same), "links")
        found = written(components(links), "components")

        def opened(found: DataFrame, across: bool) -> DataFrame:
            """Members of buckets that hold several components, by pairs of blocks."""
            members = shared.join(found, "id", "left").select("bucket", "id", "n", F.coalesce("component", "id").alias("component"))
            several = members.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("bucket")
            blocks = F.ceil(F.col("n") / BLOCK)
            members = members.join(several, "bucket").join(sig, "id").withColumn("side", F.pmod(F.xxhash64("id"), blocks).cast("int"))
            members = members.withColumn("other", F.explode(F.sequence(F.lit(0), blocks.cast("int") - 1) if across else F.array("side")))
            return _dealt(members.select("bucket", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "id", "component", "sig"))

        more = opened(found, False).mapInArrow(_forests(least), "a long, b long").distinct().join(checked, ["a", "b"], "left_anti")
        links = written(links.union(_confirmed(written(more, "pairs"), docs, shingle, percent)), "links")
        found = written(components(links), "components")
        block = "bucket long, i int, j int, side int, id long, component long"
        rest = written(opened(found, True).mapInArrow(_undecided(least), block), "blocks")
        rest = rest.join(sig, "id").join(_full_sets(rest.select("id"), docs, shingle), "id")
        rest = _dealt(rest.select("bucket", "i", "j", "side", "id", "component", "sig", "hashes"))
        links = written(links.union(rest.mapInArrow(_decided(least, percent), "a long, b long")), "links")
        found = written(components(links), "components")
    component = F.coalesce("component", "id", "doc_id")
    rows = rows.join(found, "id", "left")
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
