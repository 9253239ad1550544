"""Codes of vectors: the parts of every vector as indexes into codebooks that are fitted by whole rounds of k-means, exactly.

The vectors are dealt into blocks, each a row of a written table with a metric tree for every part position. A tree grows from the middle: anchors each
take the points nearest to them, the farthest point of the widest anchor becomes the next one, until there are about as many as the root of the number of
points; anchors are merged upwards, nearest ball first, and divided in the same way downwards. Each ball caches its pivot, radius, count and sum.

A round walks each tree from its root with a list of candidate entries that every ball inherits from its parent. An entry goes from the list if some
other one is nearer to every point of the ball; a ball with one candidate left is wholly owned, and its cached sum and count are
added without looking at its points. Points of leaves are compared with the candidates left. All numbers are integers, so results are exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusloom.session import BROADCAST_KEY_BYTES, key_bytes, released, written

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
BLOCK_ROWS = 8_192
LEAF = 24
#: Components up to which squared distances of parts of up to 2**8 components fit 64 bits; larger ones are Python integers.
EXACT = 1 << 26
LONG = (1 << 63) - 1
#: Codebooks of all vector lengths together are sent to every task; more integers are refused.
MOST_INTEGERS = 4 << 20
LIMB = 32
BLOCKS = "dim int, wide boolean, ids binary, missing binary, labels binary, vectors binary, trees array<struct<points:binary,first:binary,last:binary,left:binary,right:binary,radius:binary>>"
SUMS = "dim int, part int, entry int, place int, limb int, value long"
SALTS = 32


def bounds(dim: int) -> list[tuple[int, int]]:
    """First component and end of each of the parts."""
    cut = [i * dim // PARTS for i in range(PARTS + 1)]
    return list(zip(cut[:-1], cut[1:], strict=True))


def _number(x: np.ndarray, wide: bool) -> np.ndarray:
    return x.astype(object) if wide else x.astype(np.int64)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return (d * d).sum(-1)


def _floats(x: np.ndarray, most: float) -> np.ndarray:
    """As floats, those of a larger size than ``most`` as that."""
    if x.dtype != object:
        return x.astype(np.float64)
    bound = int(most)
    return np.array([float(min(max(int(v), -bound), bound)) for v in x.ravel()]).reshape(x.shape)


def _root(squares: np.ndarray) -> np.ndarray:
    """Square roots from above; infinite beyond the range of floats."""
    if squares.dtype == object:
        return np.array([float(isqrt(int(v)) + 1) if int(v).bit_length() < 2000 else np.inf for v in squares.ravel()]).reshape(squares.shape)
    return np.sqrt(squares.astype(np.float64)) * (1 + 1e-12)


class Anchors:
    """The tree of one block's parts, as lists of balls; points are put in the order of the leaves."""

    def __init__(self, x: np.ndarray):
        self.x = x
        # Which points an anchor takes may rest on rounded distances; balls are measured exactly.
        self.rough = _floats(x, 1e100)
        self.order: list[np.ndarray] = []
        self.first, self.last, self.left, self.right, self.radius = [], [], [], [], []
        self.size = 0
        self.root = self._grow(np.arange(len(x)))

    def _ball(self, own: np.ndarray, first: int, left: int, right: int) -> int:
        pivot = self.pivot(own)
        self.first.append(first)
        self.last.append(first + len(own))
        self.left.append(left)
        self.right.append(right)
        self.radius.append(float(_root(_squares(self.x[own], pivot).max(keepdims=True))[0]))
        return len(self.first) - 1

    def pivot(self, own: np.ndarray) -> np.ndarray:
        return self.x[own].sum(0) // len(own)

    def _leaf(self, own: np.ndarray) -> int:
        self.order.append(own)
        self.size += len(own)
        return self._ball(own, self.size - len(own), -1, -1)

    def _grow(self, own: np.ndarray) -> int:
        """The ball of some points: anchors, their own balls, and the balls that join them."""
        if len(own) <= LEAF:
            return self._leaf(own)
        groups = self._anchors(own, max(2, isqrt(len(own))))
        if len(groups) == 1:
            # All points are equal.
            return self._leaf(own)
        return self._joined(groups)

    def _anchors(self, own: np.ndarray, n: int) -> list[np.ndarray]:
        x = self.rough[own]
        anchor = [int(np.argmax(((x - x[0]) ** 2).sum(1)))]
        owner, distance = np.zeros(len(own), np.int64), np.sqrt(((x - x[anchor[0]]) ** 2).sum(1))
        while len(anchor) < n:
            far = int(np.argmax(distance))
            if distance[far] == 0:
                break
            apart = np.sqrt(((x[anchor] - x[far]) ** 2).sum(1))
            # Only points farther from their anchor than half the way to the new one can change over.
            maybe = np.flatnonzero(distance > apart[owner] / 2)
            d = np.sqrt(((x[maybe] - x[far]) ** 2).sum(1))
            nearer = d < distance[maybe]
            owner[maybe[nearer]], distance[maybe[nearer]] = len(anchor), d[nearer]
            owner[far], distance[far] = len(anchor), 0.0
            anchor.append(far)
        groups = [own[owner == i] for i in range(len(anchor))]
        return [g for g in groups if len(g)]

    def _joined(self, groups: list[np.ndarray]) -> int:
        """Joins the two balls whose common ball would be smallest, until one is left, and only then grows them, so that each ball's points stand together."""
        center = np.array([self.rough[g].mean(0) for g in groups])
        radius = np.array([np.sqrt(((self.rough[g] - c) ** 2).sum(1).max()) for g, c in zip(groups, center, strict=True)])
        count = np.array([len(g) for g in groups], np.float64)
        shape: list = list(range(len(groups)))
        cost = np.sqrt(((center[:, None] - center[None]) ** 2).sum(2)) + radius[:, None] + radius[None]
        np.fill_diagonal(cost, np.inf)
        for _ in range(len(groups) - 1):
            a, b = sorted(divmod(int(np.argmin(cost)), len(groups)))
            apart = np.sqrt(((center[a] - center[b]) ** 2).sum())
            both = max(radius[a], radius[b], (apart + radius[a] + radius[b]) / 2)
            center[a] = (center[a] * count[a] + center[b] * count[b]) / (count[a] + count[b])
            radius[a], count[a], shape[a] = both, count[a] + count[b], (shape[a], shape[b])
            cost[b], cost[:, b] = np.inf, np.inf
            live = np.isfinite(cost[a])
            cost[a, live] = cost[live, a] = np.sqrt(((center[a] - center[live]) ** 2).sum(1)) + radius[a] + radius[live]
            top = a
        return self._placed(shape[top], groups)[0]

    def _placed(self, shape, groups: list[np.ndarray]) -> tuple[int, np.ndarray]:
        """Lays out a merged tree from left to right, without recursion as deep as a chain of merges."""
        work, done = [(shape, False)], []
        while work:
            node, ready = work.pop()
            if not isinstance(node, tuple):
                done.append((self._grow(groups[node]), groups[node]))
            elif ready:
                (b, own_b), (a, own_a) = done.pop(), done.pop()
                own = np.concatenate([own_a, own_b])
                done.append((self._ball(own, self.first[a], a, b), own))
            else:
                work += [(node, True), (node[1], False), (node[0], False)]
        return done[0]

    def row(self) -> dict:
        points = np.concatenate(self.order)
        kinds = {"first": np.int32, "last": np.int32, "left": np.int32, "right": np.int32, "radius": np.float64}
        return {"points": points.astype(np.int32).tobytes()} | {n: np.array(getattr(self, n), k).tobytes() for n, k in kinds.items()}


class Tree:
    """A stored tree over one part of a block's vectors."""

    def __init__(self, row: dict, x: np.ndarray):
        self.points = np.frombuffer(row["points"], np.int32)
        self.first, self.last, self.left, self.right = (np.frombuffer(row[n], np.int32) for n in ("first", "last", "left", "right"))
        self.radius = np.frombuffer(row["radius"], np.float64)
        self.x = x[self.points]
        total = np.concatenate([np.zeros((1, x.shape[1]), x.dtype), np.cumsum(self.x, 0)]) if len(x) else x
        #: The balls' cached sums and counts, from running sums over the points in the order of the leaves.
        self.sums = total[self.last] - total[self.first]
        self.counts = (self.last - self.first).astype(np.int64)
        self.pivots = self.sums // self.counts[:, None]

    def owners(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Balls that one entry owns wholly, and the entry of each; points (places in the leaves' order) that were compared, and the entry of each."""
        k = len(entries)
        apart = _root(_squares(entries[:, None], entries[None])) * (1 + 1e-9)
        # Of equal entries only the first can own anything.
        candidates = np.ones((1, k), bool)
        for i in range(k):
            candidates[0, i] = not any((entries[i] == entries[j]).all() for j in range(i))
        ball = np.array([len(self.first) - 1])
        owned, owner, points, nearest = [], [], [], []
        while len(ball):
            d = _squares(self.pivots[ball][:, None], entries[None])
            masked = np.where(candidates, d, d.max() + 1)
            best = masked.argmin(1)
            # An entry as far from the ball's pivot as this is farther than the best one from every point within the radius.
            further = _floats(d - d[np.arange(len(ball)), best][:, None], 1e300)
            with np.errstate(invalid="ignore"):
                candidates &= ~(further > 2 * self.radius[ball][:, None] * apart[best] * (1 + 1e-9))
            single = candidates.sum(1) == 1
            owned.append(ball[single])
            owner.append(candidates[single].argmax(1))
            ball, candidates = ball[~single], candidates[~single]
            leaf = self.left[ball] < 0
            for b, c in self._by_list(ball[leaf], candidates[leaf]):
                at = np.concatenate([np.arange(self.first[i], self.last[i]) for i in b])
                d = _squares(self.x[at][:, None], entries[c][None])
                points.append(at)
                nearest.append(c[d.argmin(1)])
            ball, candidates = ball[~leaf], candidates[~leaf]
            ball, candidates = np.concatenate([self.left[ball], self.right[ball]]), np.concatenate([candidates, candidates])
        none = np.zeros(0, np.int64)
        return tuple(np.concatenate(x) if x else none for x in (owned, owner, points, nearest))

    @staticmethod
    def _by_list(balls: np.ndarray, candidates: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Balls that have the same list of candidates, and the list."""
        if len(balls):
            lists, which = np.unique(candidates, axis=0, return_inverse=True)
            for i, own in enumerate(lists):
                yield balls[which.ravel() == i], np.flatnonzero(own)

    def totals(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum and count of the points of each entry."""
        owned, owner, points, nearest = self.owners(entries)
        sums, counts = np.zeros(entries.shape, self.x.dtype), np.zeros(len(entries), np.int64)
        np.add.at(sums, owner, self.sums[owned])
        np.add.at(counts, owner, self.counts[owned])
        np.add.at(sums, nearest, self.x[points])
        np.add.at(counts, nearest, 1)
        return sums, counts

    def codes(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry of each of the block's rows, and its squared distance."""
        owned, owner, points, nearest = self.owners(entries)
        code = np.empty(len(self.points), np.int64)
        code[points] = nearest
        for b, o in zip(owned.tolist(), owner.tolist(), strict=True):
            code[self.first[b]:self.last[b]] = o
        out, error = np.empty_like(code), np.empty(len(code), self.x.dtype)
        out[self.points], error[self.points] = code, _squares(self.x, entries[code])
        return out, error


def _whole(values: np.ndarray) -> tuple[np.ndarray, bool]:
    """floor(SCALE * x), and whether these are Python integers because some are too large."""
    scaled = np.floor(values.astype(np.float64) * SCALE)
    if np.isfinite(scaled).all():
        if not scaled.size or np.abs(scaled).max() <= EXACT:
            return scaled.astype(np.int64), False
        return np.array([int(v) for v in scaled.ravel()], object).reshape(scaled.shape), True
    # Finite doubles that are no longer so once scaled are whole numbers already.
    return np.array([int(v) * SCALE if abs(v) > 2.0 ** 60 else int(np.floor(v * SCALE)) for v in values.astype(np.float64).ravel().tolist()], object).reshape(values.shape), True


def _pack(vectors: np.ndarray, wide: bool) -> bytes:
    return ("\n".join(map(str, vectors.ravel())).encode() if wide else vectors.astype(np.int32).tobytes())


def _unpack(data: bytes, dim: int, wide: bool, rows: int) -> np.ndarray:
    if wide:
        return np.array([int(v) for v in data.decode().split("\n")], object).reshape(rows, dim)
    return np.frombuffer(data, np.int32).astype(np.int64).reshape(rows, dim)


def _block_row(dim: int, held: list[tuple]) -> dict:
    ids, labels, vectors = (np.concatenate(x) for x in zip(*held, strict=True))
    whole, wide = _whole(vectors)
    trees = [Anchors(whole[:, a:b]).row() for a, b in bounds(dim)]
    return {"dim": dim, "wide": wide, "ids": ids["value"].tobytes(), "missing": ids["missing"].tobytes(), "labels": labels.tobytes(), "vectors": _pack(whole, wide), "trees": trees}


_ID = np.dtype([("value", np.int64), ("missing", bool)])


def _blocks_of(kind: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        size: dict[int, int] = {}
        for batch in batches:
            lists = batch.column(2)
            counts = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            starts = np.cumsum(counts) - counts
            ids = np.zeros(batch.num_rows, _ID)
            ids["value"], ids["missing"] = batch.column(0).fill_null(0).to_numpy(), batch.column(0).is_null().to_numpy(zero_copy_only=False)
            labels = np.zeros(batch.num_rows, _ID)
            labels["value"], labels["missing"] = batch.column(1).fill_null(0).to_numpy(), batch.column(1).is_null().to_numpy(zero_copy_only=False)
            for dim in np.unique(counts).tolist():
                own = np.flatnonzero(counts == dim)
                for a in range(0, len(own), BLOCK_ROWS):
                    part = own[a:a + BLOCK_ROWS]
                    held.setdefault(dim, []).append((ids[part], labels[part], flat[starts[part][:, None] + np.arange(dim)]))
                    size[dim] = size.get(dim, 0) + len(part)
                    if size[dim] >= BLOCK_ROWS:
                        yield pa.RecordBatch.from_pylist([_block_row(dim, held.pop(dim))], kind)
                        size[dim] = 0
        for dim, parts in held.items():
            yield pa.RecordBatch.from_pylist([_block_row(dim, parts)], kind)
    return run


def _kind() -> pa.Schema:
    tree = pa.struct([(n, pa.binary()) for n in ("points", "first", "last", "left", "right", "radius")])
    return pa.schema([("dim", pa.int32()), ("wide", pa.bool_()), *((n, pa.binary()) for n in ("ids", "missing", "labels", "vectors")), ("trees", pa.list_(tree))])


def blocks(vectors: DataFrame) -> DataFrame:
    """Blocks of up to about ``BLOCK_ROWS`` vectors of one length, with their trees, as a written table.

    ``vectors``: ``vec_id`` (long), ``label`` (long), ``vector``; rows whose vector is null or holds a null or non-finite component are left out.
    """
    usable = F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return written(vectors.filter(usable).mapInArrow(_blocks_of(_kind()), BLOCKS), "blocks")


def _first_entries(vectors: DataFrame) -> dict[int, list[np.ndarray]]:
    """The codebooks to begin with, by length of vector and part: the parts of the smallest ids (nulls last, equal ones by vector)."""
    usable = F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.filter(usable).withColumn("dim", F.size("vector"))
    out: dict[int, list[np.ndarray]] = {}
    for dim in sorted(r.dim for r in rows.select("dim").distinct().collect()):
        seeds = rows.filter(F.col("dim") == dim).orderBy(F.asc_nulls_last("vec_id"), "vector").limit(ENTRIES).select("vector").collect()
        whole, wide = _whole(np.array([r.vector for r in seeds], np.float64).reshape(len(seeds), dim))
        out[dim] = [whole[:, a:b] for a, b in bounds(dim)]
        if sum(p.size for own in out.values() for p in own) > MOST_INTEGERS:
            raise ValueError(f"codebooks of more than {MOST_INTEGERS} integers")
    return out


def _loaded(row: dict, entries: dict[int, list[np.ndarray]]) -> Iterator[tuple[int, Tree, np.ndarray]]:
    """Each part's number, tree and entries, in integers that hold both."""
    dim, n = row["dim"], len(row["missing"])
    x = _unpack(row["vectors"], dim, row["wide"], n)
    for part, (a, b) in enumerate(bounds(dim)):
        own = entries[dim][part]
        wide = row["wide"] or own.dtype == object or b - a > 256
        yield part, Tree(row["trees"][part], _number(x[:, a:b], wide)), _number(own, wide)


def _round(entries: dict[int, list[np.ndarray]]):
    """Sums and counts of each entry over the blocks of one task, in limbs of 32 bits (``place`` -1: the count)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                for part, tree, own in _loaded(row, entries):
                    sums, counts = (x.astype(object) for x in tree.totals(own))
                    before = total.get((row["dim"], part), (0, 0))
                    total[row["dim"], part] = before[0] + sums, before[1] + counts
        out = []
        for (dim, part), (sums, counts) in total.items():
            for entry in np.flatnonzero(counts).tolist():
                for place, value in [(-1, counts[entry]), *enumerate(sums[entry])]:
                    out += [(dim, part, entry, place, limb, v) for limb, v in _limbs(int(value))]
        if out:
            names = [f.split(" ")[0] for f in SUMS.split(", ")]
            kinds = [pa.int64() if n == "value" else pa.int32() for n in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
    return run


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    """Digits to the base 2**32 of an integer; the last one carries its sign."""
    limb = 0
    while not -(1 << LIMB) < value < 1 << LIMB:
        yield limb, value & ((1 << LIMB) - 1)
        value >>= LIMB
        limb += 1
    yield limb, value


def _moved(entries: dict[int, list[np.ndarray]], rows: list) -> dict[int, list[np.ndarray]]:
    """The entries at the means (rounded down) of their points; one without points stays."""
    total: dict[tuple[int, int, int, int], int] = {}
    for r in rows:
        key = (r.dim, r.part, r.entry, r.place)
        total[key] = total.get(key, 0) + (int(r.value) << (LIMB * r.limb))
    out = {}
    for dim, parts in entries.items():
        out[dim] = []
        for part, own in enumerate(parts):
            new = own.astype(object)
            for e in range(len(own)):
                n = total.get((dim, part, e, -1))
                if n:
                    new[e] = [total.get((dim, part, e, i), 0) // n for i in range(own.shape[1])]
            small = not new.size or max(abs(int(v)) for v in new.ravel()) <= EXACT
            out[dim].append(new.astype(np.int64) if small else new)
    return out


def codebooks_text(parts: list[np.ndarray]) -> str:
    return ",".join(str(v) for part in parts for v in part.ravel().tolist())


def fit(vectors: DataFrame, trees: DataFrame, rounds: int = ROUNDS) -> dict[int, list[np.ndarray]]:
    """Codebooks by length of vector: an array of entries for each part position. Each round is one job; a task sends at most one sum for each entry."""
    entries = _first_entries(vectors)
    for _ in range(rounds):
        sums = trees.mapInArrow(_round(entries), SUMS).groupBy("dim", "part", "entry", "place", "limb").agg(F.sum("value").alias("value"))
        # As many rows as the codebooks have integers (times their limbs).
        entries = _moved(entries, sums.collect())
    return entries


def encode(trees: DataFrame, entries: dict[int, list[np.ndarray]]) -> DataFrame:
    """``vec_id``, ``label``, ``dim``, ``code`` (two hex digits for each part), ``error`` (squared distances, summed; at most the largest long)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                codes, errors = [], 0
                for _, tree, own in _loaded(row, entries):
                    code, error = tree.codes(own)
                    codes.append(code)
                    errors = errors + error.astype(object)
                n = len(row["missing"])
                labels = np.frombuffer(row["labels"], _ID)
                text = np.stack(codes, 1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.frombuffer(row["ids"], np.int64), mask=np.frombuffer(row["missing"], bool)), pa.array(labels["value"].copy(), mask=labels["missing"].copy()),
                    pa.array([row["dim"]] * n, pa.int32()), pa.array([bytes(t).hex() for t in text]), pa.array([min(int(e), LONG) for e in errors], pa.int64())],
                    ["vec_id", "label", "dim", "code", "error"])

    return trees.mapInArrow(run, "vec_id long, label long, dim int, code string, error long")


def compress(vectors: DataFrame) -> DataFrame:
    """``vec_id``, ``code``, ``error``, ``label_error`` (errors summed over equal labels, nulls together) and ``codebooks_sha256``.

    ``vectors``: ``vec_id`` (long), ``label`` (whole number), ``vector`` (array of float or double). Components become floor(4096 * x). Rows whose vector is null or holds a null or
    non-finite component are left out; all other rows are kept, repeated ids and rows without id or label included. The codebooks start from the smallest ids, nulls last and equal ids
    by vector. Vectors of different lengths have codebooks of their own, and sums of errors too; a length that eight does not divide has parts that differ by one component. Errors and
    their sums beyond the largest long are given as that. No rows give no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "vector")
    with released(spark):
        trees = blocks(vectors)
        entries = fit(vectors, trees)
        coded = written(encode(trees, entries), "codes")
        total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG).cast("decimal(38,0)")).cast("long")
        sums = written(coded.groupBy("label", "dim").agg(total.alias("label_error")), "errors")
    known = spark.createDataFrame([(d, hashlib.sha256(codebooks_text(p).encode()).hexdigest()) for d, p in entries.items()], "dim int, codebooks_sha256 string")
    sums = sums.join(F.broadcast(known), "dim").withColumnsRenamed({"label": "_label", "dim": "_dim"})
    same = F.col("label").eqNullSafe(F.col("_label")) & (F.col("dim") == F.col("_dim"))
    if key_bytes(sums) <= BROADCAST_KEY_BYTES:
        rows = coded.join(F.broadcast(sums), same)
    else:
        # A label may hold a third of all rows: its rows are dealt over several tasks, and its sum goes to each of them.
        sums = sums.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = coded.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int")).join(sums, same & (F.col("salt") == F.col("_salt")))
    return rows.select("vec_id", "code", "error", "label_error", "codebooks_sha256")
