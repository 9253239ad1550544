"""Exact top-k by inner product with M-trees.

The vectors are dealt into trees of bounded size, each a row of a written table. A tree's pages are metric nodes: every node
has a routing vector, a covering radius and its distance to its parent's routing vector. Inner products become distances by one more
component that gives all vectors of a tree the same length, so the nearest vector has the largest product.

Each query walks a tree best node first, and many queries walk together: those that
are about to visit the same node are one numpy step. A child or an entry whose stored distance to its parent already rules it out, by the
triangle inequality, is passed over without computing its distance. Products are integers; bounds carry a small slack, so results are exact. Components beyond
2**23 go the same way, with products as Python integers and distances in units of the largest component.

Trees and queries are rows of one plan: the queries go, in batches, to every group of about one tree, and none of them to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.session import released, written

TREE_ROWS = 16_384
PAGE = 64
FANOUT = 16
#: Queries that are searched for together in one tree.
TOGETHER = 512
#: Components up to which products of vectors of up to 64 components are exact as doubles.
LARGEST = 1 << 23
LONG = (1 << 63) - 1
TREE = ("dim int, wide boolean, unit double, vectors binary, id_counts binary, ids binary, entry_distance binary, center binary, radius binary, "
        "parent_distance binary, first binary, last binary, leaves int")
_KINDS = {"vectors": np.float64, "id_counts": np.int32, "ids": np.int64, "entry_distance": np.float64, "center": np.int32, "radius": np.float64,
          "parent_distance": np.float64, "first": np.int32, "last": np.int32}


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component, as double; null if the vector is null or has a component that is null or not finite."""
    def whole(x: Column) -> Column:
        y = F.lit(float(scale)) * x.cast("double")
        # From 2**52 on a double has no fraction.
        return F.when(F.abs(y) < float(1 << 52), F.floor(y).cast("double")).otherwise(y)

    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(F.lit(float(scale)) * x.cast("double")) < float("inf")))
    return F.when(good, F.transform(vector, whole))


def _is_wide(vectors: np.ndarray) -> bool:
    """Whether products of these vectors may leave the integers that doubles hold."""
    return vectors.size > 0 and float(np.abs(vectors).max()) > LARGEST * 8 / max(vectors.shape[1], 1) ** 0.5


def _unit(vectors: np.ndarray) -> float:
    return max(1.0, float(np.abs(vectors).max())) if vectors.size else 1.0


def _integers(vectors: np.ndarray) -> np.ndarray:
    return np.array([int(v) for v in vectors.ravel().tolist()], object).reshape(vectors.shape)


def _lengthened(vectors: np.ndarray) -> tuple[np.ndarray, float]:
    norm = (vectors ** 2).sum(1)
    most = float(norm.max()) if len(norm) else 0.0
    return np.concatenate([vectors, np.sqrt(most - norm)[:, None]], 1), most


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(((a - b) ** 2).sum(1))


def grow(vectors: np.ndarray, ids: np.ndarray) -> list:
    """One tree as a row of ``TREE``. Equal vectors are one entry with its ids in order."""
    order = np.lexsort((ids, *vectors.T))
    vectors, ids = vectors[order], ids[order]
    new = np.append(True, (vectors[1:] != vectors[:-1]).any(1))
    counts = np.diff(np.append(np.flatnonzero(new), len(ids)))
    starts = np.flatnonzero(new)
    vectors = vectors[new]
    wide = _is_wide(vectors)
    unit = _unit(vectors) if wide else 1.0
    x, _ = _lengthened(vectors / unit)
    pages: list[np.ndarray] = []
    work = [np.arange(len(x))]
    while work:
        own = work.pop()
        if len(own) <= PAGE:
            pages.append(own)
            continue
        a = own[np.argmax(_distances(x[own], x[own[0]]))]
        da = _distances(x[own], x[a])
        b = own[np.argmax(da)]
        own = own[np.argsort(da - _distances(x[own], x[b]), kind="stable")]
        # Halves of whole pages, so that nearly all pages are full.
        half = max(PAGE, len(own) // 2 // PAGE * PAGE)
        work += [own[half:], own[:half]]

    def middle(members: np.ndarray) -> int:
        return int(members[np.argmin(_distances(x[members], x[members].mean(0)))])

    center = [middle(p) for p in pages]
    to_center = [_distances(x[p], x[c]) for p, c in zip(pages, center, strict=True)]
    radius = [float(d.max()) for d in to_center]
    ends = np.cumsum([len(p) for p in pages])
    first, last = [0, *ends[:-1].tolist()], ends.tolist()
    parent_distance, low = [0.0] * len(pages), 0
    while len(center) - low > 1:
        high = len(center)
        for a in range(low, high, FANOUT):
            b = min(a + FANOUT, high)
            members = np.array(center[a:b])
            c = middle(members)
            d = _distances(x[members], x[c])
            parent_distance[a:b] = d.tolist()
            center.append(c)
            radius.append(float((d + np.array(radius[a:b])).max()))
            parent_distance.append(0.0)
            first.append(a)
            last.append(b)
        low = high
    entries = np.concatenate(pages)
    place = np.empty(len(entries), np.int32)
    place[entries] = np.arange(len(entries))
    listed = np.concatenate([ids[s:s + c] for s, c in zip(starts[entries], counts[entries], strict=True)])
    arrays = {"vectors": vectors[entries], "id_counts": counts[entries], "ids": listed, "entry_distance": np.concatenate(to_center),
              "center": place[center], "radius": radius, "parent_distance": parent_distance, "first": first, "last": last}
    return [vectors.shape[1], wide, unit, *(np.asarray(arrays[n], k if n != "vectors" or wide else np.int32).tobytes() for n, k in _KINDS.items()), len(pages)]


class Tree:
    def __init__(self, row: dict, wide: bool = False):
        """``wide``: for queries whose products leave the integers of doubles, even if those of the tree's own vectors don't."""
        self.wide = wide or row["wide"]
        for name, kind in _KINDS.items():
            setattr(self, name, np.frombuffer(row[name], kind if name != "vectors" or row["wide"] else np.int32))
        self.leaves = row["leaves"]
        exact = self.vectors.reshape(len(self.id_counts), row["dim"]).astype(np.float64)
        self.unit = _unit(exact) if self.wide else 1.0
        shrunk = row["unit"] / self.unit
        if shrunk != 1.0:
            self.entry_distance, self.radius, self.parent_distance = (a * shrunk for a in (self.entry_distance, self.radius, self.parent_distance))
        self.x, self.norm = _lengthened(exact / self.unit)
        self.exact = _integers(exact) if self.wide else exact
        self.id_starts = np.cumsum(self.id_counts) - self.id_counts
        self.precision = 1e-6 if self.wide else 1e-9

    def search(self, queries: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Number of the query, id and product of the best k vectors of each query (``own``: its id, which is left out)."""
        n, nodes = len(queries), len(self.center)
        units = np.maximum(np.abs(queries).max(1), 1.0) if self.wide and queries.size else np.ones(n)
        near_queries = queries / units[:, None]
        products = _integers(queries) if self.wide else queries
        q = np.concatenate([near_queries, np.zeros((n, 1))], 1)
        length = (near_queries ** 2).sum(1)
        slack = self.precision * (1.0 + np.sqrt(self.norm) + np.sqrt(length))
        # Lower bound of each node that a query may still visit, and the distance to its routing vector.
        bound, distance = np.full((n, nodes), np.inf), np.zeros((n, nodes))
        root = nodes - 1
        distance[:, root] = _distances(q, self.x[self.center[root]])
        bound[:, root] = np.maximum(distance[:, root] - self.radius[root], 0)
        reach = np.full(n, np.inf)
        best_score, best_id = np.full((n, k), -np.inf, object if self.wide else np.float64), np.full((n, k), np.iinfo(np.int64).max)
        live = np.arange(n)
        while len(live):
            node = bound[live].argmin(1)
            going = np.isfinite(bound[live, node]) & (bound[live, node] <= reach[live] + slack[live])
            live, node = live[going], node[going]
            if not len(live):
                break
            order = np.argsort(node, kind="stable")
            cuts = np.flatnonzero(np.diff(node[order], prepend=-1)).tolist()
            for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
                at, who = int(node[order[a]]), live[order[a:b]]
                bound[who, at] = np.inf
                first, last = int(self.first[at]), int(self.last[at])
                leaf = at < self.leaves
                known = (self.entry_distance if leaf else self.parent_distance)[first:last]
                spread = 0.0 if leaf else self.radius[first:last]
                near = np.abs(distance[who, at][:, None] - known) - spread <= (reach[who] + slack[who])[:, None]
                needed = first + np.flatnonzero(near.any(0))
                if not len(needed):
                    continue
                near = near[:, needed - first]
                if not leaf:
                    c = self.x[self.center[needed]]
                    d = np.sqrt(np.maximum((q[who] ** 2).sum(1)[:, None] + (c ** 2).sum(1) - 2 * q[who] @ c.T, 0))
                    distance[np.ix_(who, needed)] = d
                    bound[np.ix_(who, needed)] = np.where(near, np.maximum(d - self.radius[needed], 0), np.inf)
                    continue
                self._take(who, needed, products[who] @ self.exact[needed].T, near, own, k, best_score, best_id)
                worst = self._scaled(best_score[who, k - 1], units[who])
                reach[who] = np.where(np.isfinite(worst), np.sqrt(np.maximum(length[who] + self.norm - 2 * np.where(np.isfinite(worst), worst, 0), 0)), np.inf)
        who, place = np.nonzero(best_score != -np.inf)
        return who, best_id[who, place], [int(s) for s in best_score[who, place]]

    def _scaled(self, score: np.ndarray, units: np.ndarray) -> np.ndarray:
        """Products in the units of the distances."""
        if not self.wide:
            return score
        return np.array([-np.inf if s == -np.inf else s / (int(u) * int(self.unit)) for s, u in zip(score, units.tolist(), strict=True)])

    def _take(self, who: np.ndarray, entries: np.ndarray, score: np.ndarray, near: np.ndarray, own: np.ndarray, k: int, best_score: np.ndarray, best_id: np.ndarray) -> None:
        """Puts the ids of the entries that are ``near`` enough among the best of each query; of equal scores the smaller id is better."""
        # k + 1 ids of an entry are enough: they are in order, and one may be the query's own.
        ids, of = [], []
        for j, (s, c) in enumerate(zip(self.id_starts[entries].tolist(), self.id_counts[entries].tolist(), strict=True)):
            ids.append(self._smallest(s, c, k, own, who))
            of += [j] * len(ids[-1])
        ids, of = np.concatenate(ids), np.array(of)
        score = score[:, of]
        better = near[:, of] & (ids[None, :] != own[who][:, None]) & (score >= best_score[who, k - 1][:, None]).astype(bool)
        for r in np.flatnonzero(better.any(1)).tolist():
            cols = np.flatnonzero(better[r])
            s = np.concatenate([best_score[who[r]], score[r, cols]])
            i = np.concatenate([best_id[who[r]], ids[cols]])
            top = (sorted(range(len(s)), key=lambda j: (-s[j], i[j])) if self.wide else np.lexsort((i, -s)))[:k]
            best_score[who[r]], best_id[who[r]] = s[top], i[top]

    def _smallest(self, start: int, count: int, k: int, own: np.ndarray, who: np.ndarray) -> np.ndarray:
        if count <= k + 1:
            return self.ids[start:start + count]
        # Rows that repeat the query's own id may fill the first places: as many more are looked at.
        ids = self.ids[start:start + count]
        repeats = int(np.bincount(np.searchsorted(np.unique(own[who]), ids[np.isin(ids, own[who])])).max(initial=0))
        return ids[:k + repeats]


def _rows(rows: list[list]) -> pa.RecordBatch:
    fields = [f.strip().split(" ") for f in TREE.split(",")]
    kinds = {"int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)],
                                      [n for n, _ in fields])


def _grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    size: dict[int, int] = {}
    for batch in batches:
        lists = batch.column(1)
        counts = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten().to_numpy()
        starts = np.cumsum(counts) - counts
        ids = batch.column(0).to_numpy()
        for dim in np.unique(counts).tolist():
            own = np.flatnonzero(counts == dim)
            held.setdefault(dim, []).append((flat[starts[own][:, None] + np.arange(dim)], ids[own]))
            size[dim] = size.get(dim, 0) + len(own)
            while size[dim] >= TREE_ROWS:
                vectors, numbers = (np.concatenate(x) for x in zip(*held[dim], strict=True))
                yield _rows([grow(vectors[:TREE_ROWS], numbers[:TREE_ROWS])])
                held[dim], size[dim] = [(vectors[TREE_ROWS:], numbers[TREE_ROWS:])], size[dim] - TREE_ROWS
    for dim, parts in held.items():
        if size[dim]:
            yield _rows([grow(*(np.concatenate(x) for x in zip(*parts, strict=True)))])


def build(vectors: DataFrame) -> DataFrame:
    """The trees of ``vec_id`` (long), ``vector`` (array of whole numbers, as doubles), as a written table. Rows with a null are left out."""
    spark = vectors.sparkSession
    vectors = vectors.filter("vec_id is not null and vector is not null").select(F.col("vec_id").cast("long"), F.col("vector").cast("array<double>"))
    with released(spark):
        vectors = written(vectors, "vectors")
        trees = max(1, round(vectors.count() / TREE_ROWS))
        return written(vectors.repartition(trees, F.xxhash64("vec_id", "vector")).mapInArrow(_grown, TREE), "trees")


def _searched(k: int):
    """Rows of one group after the other, its trees before its queries."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, trees, made = None, [], {}
        for batch in batches:
            for rows in _runs(batch):
                if (now := rows.column("group")[0].as_py()) != group:
                    group, trees, made = now, [], {}
                if rows.column("vector").null_count == rows.num_rows:
                    trees += rows.to_pylist()
                    continue
                for own in _by_length(rows):
                    vectors = own.column("vector").combine_chunks().flatten().to_numpy().reshape(own.num_rows, -1)
                    for i, row in enumerate(trees):
                        if row["dim"] != vectors.shape[1]:
                            continue
                        wide = _is_wide(vectors)
                        if (i, wide) not in made:
                            made[i, wide] = Tree(row, wide)
                        who, vec, score = made[i, wide].search(vectors, own.column("query_id").to_numpy(), k)
                        columns = [pa.array(own.column(n).to_numpy()[who]) for n in ("query_id", "number")]
                        columns += [pa.array(vec), pa.array([min(max(s, -LONG - 1), LONG) for s in score], pa.int64()), pa.array(map(_sortable, score), pa.string())]
                        yield pa.RecordBatch.from_arrays(columns, ["query_id", "number", "vec_id", "score", "exact"])
    return run


def _sortable(score: int) -> str:
    """Strings in the order of the integers: sign, number of digits and digits; those of a negative one are counted down from nine."""
    text = f"{len(str(abs(score))):04d}{abs(score)}"
    return "1" + text if score >= 0 else "0" + text.translate(_NINES)


_NINES = str.maketrans("0123456789", "9876543210")


def _runs(batch: pa.RecordBatch) -> Iterator[pa.Table]:
    """Rows of one group that are all trees, or up to ``TOGETHER`` queries."""
    key = batch.column("group").to_numpy() * 2 + batch.column("vector").is_valid().to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(key)], strict=True):
        for start in range(a, b, TOGETHER):
            yield pa.Table.from_batches([batch.slice(start, min(TOGETHER, b - start))])


def _by_length(rows: pa.Table) -> Iterator[pa.Table]:
    length = np.diff(rows.column("vector").combine_chunks().offsets.to_numpy())
    for dim in np.unique(length).tolist():
        yield rows.take(pa.array(np.flatnonzero(length == dim)))


def top_k(trees: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score`` of the best k vectors for each query (``vec_id``, ``vector``), best first.

    The score is the inner product; one beyond a long ranks by its true value and is given as the largest (or smallest) long; ties go to the smaller ``vec_id``; rows with the query's own id are left out. Only vectors of as many
    components are compared. Queries with a null take no part; equal query rows count once; a repeated row of the trees is a candidate of its own.
    Without vectors or queries the result is empty.
    """
    queries = queries.filter("vec_id is not null and vector is not null").select(F.col("vec_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>")).distinct()
    queries = written(queries.withColumn("number", F.monotonically_increasing_id()), "queries")
    groups = max(1, trees.count())
    asked = queries.withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    held = trees.withColumn("group", F.pmod(F.xxhash64("ids", "vectors"), F.lit(groups).cast("long")))
    both = held.unionByName(asked, allowMissingColumns=True).repartition(groups, "group").sortWithinPartitions("group", F.col("vector").isNotNull())
    rows = both.mapInArrow(_searched(k), "query_id long, number long, vec_id long, score long, exact string")
    order = Window.partitionBy("query_id", "number").orderBy(F.desc("exact"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
