"""Nearest neighbours with a vantage-point tree for each shard.

Each vector goes to the region of its nearest pivot (pivots are vectors drawn by a hash of
their ids), and a region of more than ``shard`` vectors is dealt to several shards by id. A
shard's tree is built once and stored. Each query is searched in the shard of its own region
first; then only in those that the distance to their pivot, less the region's radius, does not
rule out by the worst of the neighbours found so far. Inside a tree a subtree is skipped when
the triangle inequality shows the same. Both bounds are multiplied by ``factor``: factor 1 is
exact; larger factors skip more and may miss neighbours.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType
from pyspark.sql.window import Window

from keystrata.llm.shared import materialize, ship

#: Vectors in a shard, about; vectors in a leaf.
SHARD, LEAF = 16_384, 256
#: Bytes of a shard's vectors and of all pivots, at most about; pivots at most.
SHARD_BYTES, PIVOT_BYTES, PIVOTS = 16 << 20, 8 << 20, 1_024
#: Relative error that rough distances may have: they decide what is looked at, exact ones the result.
SLACK = 1e-9
#: Rows of an output batch.
OUT = 1_024


def distances(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, summed dimension by dimension, so that equal vectors get equal values."""
    total = np.zeros(len(rows))
    for k in range(rows.shape[1]):
        d = rows[:, k] - query[k]
        total += d * d
    return np.sqrt(total)


def _rough(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Distances in one pass; they can differ from ``distances`` in the last digits."""
    d = rows - query
    return np.sqrt(np.einsum("ij,ij->i", d, d))


def _gap(d: float, low: float, high: float) -> float:
    """What lies ``low`` to ``high`` from a point that is ``d`` away is at least this far off, rounding errors allowed for."""
    return max(0.0, low - d - SLACK * (low + d), d - high - SLACK * (d + high))


class VPTree:
    """A vantage-point tree over the rows of ``points``; ``ids`` must differ.

    Rows are stored in the order of the leaves, each node's vantage point first, so a leaf is a slice.
    """

    def __init__(self, ids: np.ndarray, points: np.ndarray) -> None:
        self.nodes: list[tuple] = []
        self._order: list[np.ndarray] = []
        self._placed = 0
        self._points = np.ascontiguousarray(points)
        self.root = self._build(np.arange(len(ids)))
        order = np.concatenate(self._order)
        self.ids, self.points = np.asarray(ids)[order], self._points[order]
        del self._order, self._points

    def _place(self, members: np.ndarray) -> int:
        at = self._placed
        self._order.append(members)
        self._placed += len(members)
        return at

    def _build(self, members: np.ndarray) -> int:
        """Halves are cut by rank, not by value, so equal vectors can't make the tree deep."""
        at = len(self.nodes)
        if len(members) <= LEAF:
            first = self._place(members)
            self.nodes.append((True, first, first + len(members)))
            return at
        self.nodes.append(())
        vantage, rest = self._place(members[:1]), members[1:]
        d = _rough(self._points[rest], self._points[members[0]])
        order = np.argsort(d, kind="stable")
        half = len(rest) // 2
        near, far = order[:half], order[half:]
        left, right = self._build(rest[near]), self._build(rest[far])
        self.nodes[at] = (False, vantage, left, float(d[near].max()), right, float(d[far].min()), float(d.max()))
        return at

    def pack(self, dtype: str) -> bytes:
        """The tree as bytes; ``dtype`` must hold the points without loss."""
        out, width = io.BytesIO(), 7
        nodes = np.array([[*map(float, n), *[0.0] * (width - len(n))] for n in self.nodes])
        for a in (self.ids, self.points.astype(dtype), nodes):
            np.save(out, a)
        return out.getvalue()

    @classmethod
    def unpack(cls, packed: bytes) -> VPTree:
        tree, source = cls.__new__(cls), io.BytesIO(packed)
        tree.ids, points, nodes = (np.load(source) for _ in range(3))
        tree.points, tree.root = points.astype(np.float64), 0
        tree.nodes = [(True, int(n[1]), int(n[2])) if n[0] else (False, int(n[1]), int(n[2]), n[3], int(n[4]), n[5], n[6]) for n in nodes.tolist()]
        return tree

    def search(self, query: np.ndarray, k: int, exclude: int | None = None, factor: float = 1.0, within: float = np.inf) -> list[tuple[float, int]]:
        """The ``k`` nearest, at most ``within`` away, as (distance, id), nearest first, ties to the smaller id."""
        slack = 1 + SLACK
        rows, found, worst = np.empty(0, np.int64), np.empty(0), within

        def offer(at: np.ndarray, d: np.ndarray) -> None:
            nonlocal rows, found, worst
            close = d <= worst * slack
            if not close.any():
                return
            at, d = at[close], d[close]
            if exclude is not None:
                own = self.ids[at] == exclude
                at, d = at[~own], d[~own]
            rows, found = np.concatenate([rows, at]), np.concatenate([found, d])
            if len(found) >= k:
                worst = min(worst, float(np.partition(found, k - 1)[k - 1]))
                keep = found <= worst * slack
                rows, found = rows[keep], found[keep]
                if len(rows) > 4 * k + LEAF:  # many ties: the exact order tells which can stay
                    best = np.lexsort((self.ids[rows], distances(self.points[rows], query)))[:k]
                    rows, found = rows[best], found[best]

        stack = [(0.0, self.root)]
        while stack:
            bound, at = stack.pop()
            if bound * factor > worst * slack:
                continue
            node = self.nodes[at]
            if node[0]:
                offer(np.arange(node[1], node[2]), _rough(self.points[node[1] : node[2]], query))
                continue
            _, vantage, left, near_max, right, far_min, far_max = node
            d = _rough(self.points[vantage : vantage + 1], query)
            offer(np.array([vantage]), d)
            d = float(d[0])
            below = (_gap(d, 0.0, near_max), left)
            above = (_gap(d, far_min, far_max), right)
            stack += [above, below] if below[0] <= above[0] else [below, above]
        exact = distances(self.points[rows], query)
        best = np.lexsort((self.ids[rows], exact))[:k]
        return [(float(exact[b]), int(self.ids[rows[b]])) for b in best]


class _Regions:
    """Pivots by the length of their vectors; regions over ``shard`` vectors have several shards."""

    def __init__(self, pivots: dict[int, np.ndarray], shards: dict[tuple[int, int], int]) -> None:
        self.pivots, self.shards = pivots, shards

    def distances(self, points: np.ndarray) -> np.ndarray:
        """To each pivot, dimension by dimension: the same in each attempt at a task, however its rows are batched."""
        pivots = self.pivots[points.shape[1]]
        total = np.zeros((len(points), len(pivots)))
        for k in range(points.shape[1]):
            d = points[:, k, None] - pivots[None, :, k]
            total += d * d
        return np.sqrt(total)

    def place(self, ids: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Region, shard of the region, and distance to the pivot (0 in the one region of a length without pivots)."""
        dim, n = points.shape[1], len(points)
        region, away = np.zeros(n, np.int32), np.zeros(n)
        if dim in self.pivots:
            for i in range(0, n, 256):
                d = self.distances(points[i : i + 256])
                region[i : i + 256], away[i : i + 256] = d.argmin(axis=1), d.min(axis=1)
        parts = np.array([self.shards.get((dim, int(r)), 1) for r in region], np.uint64)
        mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        return region, (mixed % parts).astype(np.int32), away


_PLACE = "dim int, region int, part int, kind int, id long"


def _placed(df: DataFrame, regions: _Regions, kind: int, dtype: str) -> DataFrame:
    """Rows ``id, v`` with their shard; ``v`` becomes bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = pc.list_value_length(b.column("v")).to_numpy(zero_copy_only=False)
            flat, starts = b.column("v").flatten().to_numpy(zero_copy_only=False), np.cumsum(dims) - dims
            ids = b.column("id").to_numpy()
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                points = flat[starts[at][:, None] + np.arange(dim)]
                region, part, away = regions.place(ids[at], points.astype(np.float64))
                same = lambda x, n=len(at): pa.array(np.full(n, x, np.int32))
                cells = [same(dim), pa.array(region), pa.array(part), same(kind), pa.array(ids[at]), pa.array([p.tobytes() for p in points.astype(dtype)], pa.binary()), pa.array(away)]
                yield pa.RecordBatch.from_arrays(cells, ["dim", "region", "part", "kind", "id", "v", "away"])

    return df.select("id", "v").mapInArrow(run, f"{_PLACE}, v binary, away double")


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int, int], int, pa.RecordBatch]]:
    """Runs of rows of one shard and kind, in the order in which they come."""
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([b.column(c).to_numpy() for c in ("dim", "region", "part", "kind")], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), b.num_rows]
        for i, j in zip(cuts, cuts[1:], strict=False):
            yield tuple(keys[i, :3].tolist()), int(keys[i, 3]), b.slice(i, j - i)


def _batched(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == OUT or isinstance(row[-1], bytes):  # a tree is a batch by itself, or ends one
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _in_shards(rows: DataFrame, shards: int, run: Callable, schema: str) -> DataFrame:
    """A shard's vectors or tree (kind 0), then its queries (kind 1), which stream past it: no group of queries is held."""
    return rows.repartition(shards, "dim", "region", "part").sortWithinPartitions("dim", "region", "part", "kind").mapInArrow(run, schema)


def _built(k: int, factor: float, dtype: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each shard its tree, and for each query at home in it what it finds there."""
    kinds = [pa.int32()] * 4 + [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.float64(), pa.float64(), pa.binary()]
    schema = pa.schema(list(zip(["dim", "region", "part", "kind", "id", "v", "near", "scores", "low", "high", "tree"], kinds, strict=True)))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        at, tree = None, None
        ids: list[np.ndarray] = []
        points: list[np.ndarray] = []
        low, high = np.inf, 0.0

        def grown() -> Iterator[tuple]:
            nonlocal tree
            if ids and tree is None:
                all_ids, all_points = np.concatenate(ids), np.concatenate(points)
                order = np.argsort(all_ids, kind="stable")  # the same tree in each attempt
                tree = VPTree(all_ids[order], all_points[order])
                ids.clear()
                points.clear()
                yield (*at, 0, None, None, None, None, low, high, tree.pack(dtype))

        for key, kind, b in _by_shard(batches):
            if key != at:
                yield from grown()
                at, tree, low, high = key, None, np.inf, 0.0
            if kind == 0:
                away = b.column("away").to_numpy()
                low, high = min(low, float(away.min())), max(high, float(away.max()))
                ids.append(b.column("id").to_numpy().copy())
                points.append(np.frombuffer(b"".join(b.column("v").to_pylist()), dtype).reshape(b.num_rows, -1).astype(np.float64))
                continue
            yield from grown()
            for q, v in zip(b.column("id").to_pylist(), b.column("v").to_pylist(), strict=True):
                hits = tree.search(np.frombuffer(v, dtype).astype(np.float64), k, q, factor) if tree else []
                yield (*key, 1, q, v, [i for _, i in hits], [d for d, _ in hits], None, None, None)
        yield from grown()

    return lambda batches: _batched(rows(batches), schema)


def _routed(k: int, factor: float, dtype: str, regions: _Regions, spans: dict[int, list[tuple[int, int, float, float]]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each query once for each shard, but its home, that may hold something nearer than its worst so far."""
    kinds = [pa.int32()] * 4 + [pa.int64(), pa.binary(), pa.float64(), pa.binary()]
    schema = pa.schema(list(zip(["dim", "region", "part", "kind", "id", "v", "within", "tree"], kinds, strict=True)))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for (dim, region, part), _, b in _by_shard(batches):
            for q, v, scores in zip(*(b.column(c).to_pylist() for c in ("id", "v", "scores")), strict=True):
                within = scores[-1] if len(scores) >= k else np.inf
                to_pivots = regions.distances(np.frombuffer(v, dtype).astype(np.float64)[None])[0].tolist() if dim in regions.pivots else [0.0]
                for other, parts, low, high in spans.get(dim, []):
                    if _gap(to_pivots[other], low, high) * factor <= within * (1 + SLACK):
                        yield from ((dim, other, p, 1, q, v, within, None) for p in range(parts) if (other, p) != (region, part))

    return lambda batches: _batched(rows(batches), schema)


def _visited(k: int, factor: float, dtype: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        at, tree, packed = None, None, None
        for key, kind, b in _by_shard(batches):
            if key != at:
                at, tree, packed = key, None, None
            if kind == 0:
                packed = b.column("tree")[0].as_py()
                continue
            if packed is not None:
                tree, packed = VPTree.unpack(packed), None
            if tree is not None:
                for q, v, within in zip(*(b.column(c).to_pylist() for c in ("id", "v", "within")), strict=True):
                    yield from ((q, i, d) for d, i in tree.search(np.frombuffer(v, dtype).astype(np.float64), k, q, factor, within))

    return lambda batches: _batched(rows(batches), schema)


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 10, factor: float = 1.0, shard: int = SHARD, pivots: int = PIVOTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` nearest of all vectors but those with its own id.

    Vectors (and queries) that are null, zero, or hold null or non-finite components, and rows
    without an id, take no part. Rows that repeat an id count once (the smallest
    vector). Vectors of different lengths never meet. All candidates come back if there
    are fewer than ``k``. Other columns are ignored. The driver holds the pivots and a few
    numbers for each region: at most ``pivots`` regions, and one for each further length.
    """
    ship(vectors.sparkSession)

    def shape(df: DataFrame) -> DataFrame:
        v = F.col(vector_col)
        finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        fit = F.col(id_col).isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0)
        return df.where(F.coalesce(fit, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), v.cast(f"array<{number}>").alias("v"))

    def once(df: DataFrame, ids: int, rows: int) -> DataFrame:
        return df if ids == rows else df.groupBy("id").agg(F.min("v").alias("v"))

    held = [df.schema[vector_col].dataType for df in (vectors, queries)]
    number, dtype = ("float", "<f4") if all(isinstance(t, ArrayType) and isinstance(t.elementType, FloatType) for t in held) else ("double", "<f8")
    count = [F.count_distinct("id").alias("ids"), F.count("*").alias("rows"), F.max(F.size("v")).alias("dim")]
    points, asked = shape(vectors), shape(queries)
    n, m = points.agg(*count).first(), asked.agg(*count).first()
    points, asked = once(points, n["ids"], n["rows"]), once(asked, m["ids"], m["rows"])
    width = 8 * (n["dim"] or 1)
    shard = max(1, min(shard, SHARD_BYTES // width))
    wanted = min(pivots, -(-n["ids"] // shard), max(1, PIVOT_BYTES // width))
    regions = _Regions({}, {})
    if n["ids"] > shard:
        # about twice as many as wanted, the first of them by hash
        drawn = F.pmod(F.xxhash64("id"), F.lit(1 << 40))
        sample = points.where(drawn < int((1 << 40) * min(1.0, (2 * wanted + 64) / n["ids"]))).select(drawn.alias("h"), "id", "v")
        chosen = [r["v"] for r in sample.orderBy("h", "id").limit(wanted).collect()]
        lengths = {len(v) for v in chosen}
        regions = _Regions({d: np.unique(np.array([v for v in chosen if len(v) == d], np.float64), axis=0) for d in lengths}, {})
        sizes = _placed(points, regions, 0, dtype).groupBy("dim", "region").count().collect()
        regions = _Regions(regions.pivots, {(r["dim"], r["region"]): -(-r["count"] // shard) for r in sizes})
    shards = max(1, sum(regions.shards.values()))
    rows = _placed(points, regions, 0, dtype).union(_placed(asked, regions, 1, dtype))
    state = materialize(_in_shards(rows, shards, _built(k, factor, dtype), f"{_PLACE}, v binary, near array<long>, scores array<double>, low double, high double, tree binary"), "trees")
    trees, home = state.where("kind = 0"), state.where("kind = 1")
    found = home.selectExpr("id as query_id", "inline(arrays_zip(near, scores)) as (vec_id, score)")
    if shards > 1:
        spans: dict[int, list[tuple[int, int, float, float]]] = {}
        for r in trees.groupBy("dim", "region").agg(F.max("part").alias("part"), F.min("low").alias("low"), F.max("high").alias("high")).collect():
            spans.setdefault(r["dim"], []).append((r["region"], r["part"] + 1, r["low"], r["high"]))
        schema = f"{_PLACE}, v binary, within double, tree binary"
        sent = home.select("dim", "region", "part", "kind", "id", "v", "scores").mapInArrow(_routed(k, factor, dtype, regions, spans), schema)
        stored = trees.selectExpr("dim", "region", "part", "kind", "id", "v", "cast(null as double) as within", "tree")
        found = found.union(_in_shards(stored.union(sent), shards, _visited(k, factor, dtype), "query_id long, vec_id long, score double"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
