"""Centroid clustering of integer vectors by ball-tree filtering.

Vectors become integer points, floor(scale * component), so that every sum and squared distance is exact. Each task
grows metric trees over blocks of its own points, once; a node of a tree is a ball and stores its centre, radius,
number of points and their integer sum. A round sends the centroids to the trees: a ball whose points are all nearest
to one centroid by the triangle inequality is assigned as a whole, by its count and sum; otherwise its children are
looked at, and at a leaf the points themselves, exactly. Points are never shuffled; a task returns one row of sums a
cluster, and these are added up before the driver sees k of them.

Defined results: vectors that are null, of another number of dimensions, with a null or non-finite component or one
whose integer does not fit a signed 64-bit number take no part; equal rows are points of their own; ties go to the
smaller centroid; start centroids of equal hash go by their components, rows without an id come last among them; fewer
points than centroids give as many centroids as points; an empty centroid stays where it is; a distance or inertia
beyond a signed 64-bit number is given as the largest one; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signal_engine.llm.common import Scratch, tidy

BLOCK, LEAF = 512, 16  # points of a tree, of a leaf
LONGEST = (1 << 63) - 1
_TREE = "ids array<long>, points binary, wide boolean, start array<int>, stop array<int>, child array<int>, centre binary, radius array<double>, total binary"


def usable(vector: Column, dimensions: int, scale: float) -> Column:
    """Whether a vector takes part (NaN and infinity are above every bound)."""
    return F.coalesce((F.size(vector) == dimensions) & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x * F.lit(scale)) < F.lit(float(1 << 63)))), F.lit(False))


def to_points(vectors: np.ndarray, scale: float) -> np.ndarray:
    return np.floor(np.asarray(vectors, np.float64) * scale).astype(np.int64)


def narrow_bound(dimensions: int) -> int:
    """Components below this give squared distances that doubles hold exactly."""
    return 1 << ((53 - 2 - max(dimensions - 1, 1).bit_length()) // 2)


def squared_distances(points: np.ndarray, centroids: list[list[int]]) -> np.ndarray:
    """points x centroids: int64 where a double is exact throughout, else Python integers."""
    bound = narrow_bound(points.shape[1])
    if len(points) == 0 or (np.abs(points).max(initial=0) < bound and points.min(initial=0) > -(1 << 63) and all(abs(x) < bound for c in centroids for x in c)):
        p, c = points.astype(np.float64), np.asarray(centroids, np.float64)
        return ((p * p).sum(1)[:, None] - 2 * (p @ c.T) + (c * c).sum(1)[None]).astype(np.int64)
    out = np.empty((len(points), len(centroids)), object)
    for j, c in enumerate(centroids):
        out[:, j] = ((points.astype(object) - np.asarray(c, object)) ** 2).sum(1)
    return out


class BallTree:
    """One block's tree. Points are kept in tree order, so that a node is the range [start, stop) of them."""

    def __init__(self, ids, points, start, stop, child, centre, radius, total):
        self.ids, self.points, self.start, self.stop, self.child, self.centre, self.radius, self.total = ids, points, start, stop, child, centre, radius, total

    @classmethod
    def grow(cls, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF) -> BallTree:
        order, nodes, child = np.arange(len(points)), [(0, len(points))], []
        centre, radius, total = [], [], []
        for start, stop in nodes:  # grows while it is walked
            own = points[order[start:stop]]
            total.append(own.sum(0))
            centre.append(total[-1] // (stop - start))
            from_centre = ((own - centre[-1]) ** 2).sum(1)
            radius.append(float(np.sqrt(from_centre.max())) * (1 + 1e-9))
            if stop - start <= leaf or radius[-1] == 0:
                child.append(-1)
                continue
            one = own[from_centre.argmax()]
            away = ((own - one) ** 2).sum(1)
            other = own[away.argmax()]
            lean = away - ((own - other) ** 2).sum(1)
            order[start:stop] = order[start:stop][np.argsort(lean, kind="stable")]
            child.append(len(nodes))
            # by the nearer of the two, or in halves where that leaves one side with few points
            cut = int((lean <= 0).sum())
            middle = start + (cut if min(cut, stop - start - cut) * 8 >= stop - start else (stop - start) // 2)
            nodes += [(start, middle), (middle, stop)]
        start, stop = np.asarray(nodes, np.int32).reshape(-1, 2).T
        return cls(ids[order], points[order], start, stop, np.asarray(child, np.int32), np.asarray(centre, np.int64), np.asarray(radius), np.asarray(total, np.int64))

    def settle(self, centroids: list[list[int]]) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray, np.ndarray]:
        """(balls assigned whole as (node, cluster), other points' places, their clusters, their squared distances)."""
        whole, leaves, open_nodes = [], [], np.zeros(1, np.int64)
        while len(open_nodes):
            near = np.sqrt(squared_distances(self.centre[open_nodes], centroids).astype(np.float64))
            best = near.argmin(1)
            first = near[np.arange(len(near)), best]
            near[np.arange(len(near)), best] = np.inf
            second = near.min(1)
            # a point's nearest is `best` if first + radius < second - radius; the margin covers rounding
            sure = first + 2 * self.radius[open_nodes] + 1e-6 * (1 + first) < second
            whole += zip(open_nodes[sure].tolist(), best[sure].tolist(), strict=True)
            rest = open_nodes[~sure]
            at_leaf = self.child[rest] < 0
            leaves.append(rest[at_leaf])
            left = self.child[rest[~at_leaf]].astype(np.int64)
            open_nodes = np.concatenate([left, left + 1])
        nodes = np.concatenate(leaves) if leaves else np.zeros(0, np.int64)
        places = np.concatenate([np.arange(self.start[v], self.stop[v]) for v in nodes.tolist()] or [np.zeros(0, np.int64)])
        distance = squared_distances(self.points[places], centroids)
        cluster = distance.argmin(1) if len(places) else np.zeros(0, np.int64)
        return whole, places, cluster, distance[np.arange(len(places)), cluster]

    def sums(self, centroids: list[list[int]], into: list[list[int]]) -> None:
        """Add every cluster's count and component sums to ``into``."""
        whole, places, cluster, _ = self.settle(centroids)
        for node, c in whole:
            into[c][0] += int(self.stop[node] - self.start[node])
            into[c][1:] = [a + b for a, b in zip(into[c][1:], self.total[node].tolist(), strict=True)]
        for c in np.unique(cluster).tolist():
            own = self.points[places[cluster == c]]
            into[c][0] += len(own)
            into[c][1:] = [a + b for a, b in zip(into[c][1:], own.sum(0).tolist(), strict=True)]

    def clusters(self, centroids: list[list[int]]) -> tuple[np.ndarray, list[int]]:
        """(cluster, squared distance) of every point, in tree order."""
        whole, places, own, found = self.settle(centroids)
        cluster, distance = np.zeros(len(self.points), np.int32), np.zeros(len(self.points), object)
        cluster[places], distance[places] = own, found
        for node, c in whole:
            at = slice(self.start[node], self.stop[node])
            cluster[at], distance[at] = c, squared_distances(self.points[at], centroids[c : c + 1])[:, 0]
        return cluster, distance.tolist()


class WidePoints:
    """Points with components that doubles can't square exactly: looked at one by one, in Python integers."""

    def __init__(self, ids: np.ndarray, points: np.ndarray):
        self.ids, self.points = ids, points

    def clusters(self, centroids: list[list[int]]) -> tuple[np.ndarray, list[int]]:
        distance = squared_distances(self.points, centroids)
        cluster = np.asarray([row.tolist().index(min(row.tolist())) for row in distance], np.int32)
        return cluster, [int(distance[i, c]) for i, c in enumerate(cluster)]

    def sums(self, centroids: list[list[int]], into: list[list[int]]) -> None:
        for c, point in zip(self.clusters(centroids)[0].tolist(), self.points.tolist(), strict=True):
            into[c] = [a + b for a, b in zip(into[c], [1, *point], strict=True)]


def _grow_trees(dimensions: int, scale: float):
    def row(ids, points, wide):
        if wide:
            values = [ids, points.astype("<i8").tobytes(), True, None, None, None, None, None, None]
        else:
            t = BallTree.grow(ids, points)
            values = [t.ids, t.points.astype("<i4").tobytes(), False, t.start, t.stop, t.child, t.centre.astype("<i8").tobytes(), t.radius, t.total.astype("<i8").tobytes()]
            ids = t.ids
        values[0] = [None if x is None else int(x) for x in ids]
        types = [pa.list_(pa.int64()), pa.binary(), pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.float64()), pa.binary()]
        names = ["ids", "points", "wide", "start", "stop", "child", "centre", "radius", "total"]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names)

    def run(batches):
        waiting = {False: [], True: []}
        for batch in batches:
            ids = np.asarray(batch.column(0).to_pylist(), object)
            points = to_points(np.asarray(batch.column(1).flatten()).reshape(-1, dimensions), scale)
            is_wide = (np.abs(points.astype(np.float64)) >= narrow_bound(dimensions)).any(1)
            for wide in (False, True):
                if not (mine := is_wide == wide).any():
                    continue
                waiting[wide].append((ids[mine], points[mine]))
                if sum(len(x) for x, _ in waiting[wide]) >= BLOCK:
                    i, p = (np.concatenate(x) for x in zip(*waiting[wide], strict=True))
                    full = len(i) // BLOCK * BLOCK
                    for at in range(0, full, BLOCK):
                        yield row(i[at : at + BLOCK], p[at : at + BLOCK], wide)
                    waiting[wide] = [(i[full:], p[full:])] if full < len(i) else []
        for wide, left in waiting.items():
            if left:
                yield row(*(np.concatenate(x) for x in zip(*left, strict=True)), wide)

    return tidy(run)


def _blocks(batch: pa.RecordBatch, dimensions: int):
    """The trees of written rows, one at a time."""
    for i in range(batch.num_rows):
        ids, points, wide, start, stop, child, centre, radius, total = (c[i] for c in batch.columns)
        kind = "<i8" if wide.as_py() else "<i4"
        p = np.frombuffer(points.as_buffer(), kind).astype(np.int64).reshape(-1, dimensions)
        if wide.as_py():
            yield WidePoints(ids.values, p)
        else:
            c, t = (np.frombuffer(x.as_buffer(), "<i8").reshape(-1, dimensions) for x in (centre, total))
            yield BallTree(ids.values, p, np.asarray(start.values), np.asarray(stop.values), np.asarray(child.values), c, np.asarray(radius.values), t)


def start_centroids(vectors: DataFrame, k: int, seed: int, dimensions: int, scale: float) -> list[list[int]]:
    """The k points (id, v) with the smallest sha256 of ``seed:id``."""
    hashed = vectors.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).alias("h"), "v")
    first = hashed.orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()
    return to_points(np.asarray([r["v"] for r in first], np.float64).reshape(-1, dimensions), scale).tolist()


def _round(trees: DataFrame, centroids: list[list[int]], dimensions: int) -> list[list[int]]:
    """Every cluster's count and component sums."""
    k = len(centroids)

    def run(batches):
        into = [[0] * (dimensions + 1) for _ in range(k)]
        for batch in batches:
            for block in _blocks(batch, dimensions):
                block.sums(centroids, into)
        found = [c for c in range(k) if into[c][0]]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array([[Decimal(x) for x in into[c]] for c in found], pa.list_(pa.decimal128(38, 0)))], ["cluster", "sums"])

    parts = trees.mapInArrow(tidy(run), "cluster int, sums array<decimal(38,0)>")
    total = [[0] * (dimensions + 1) for _ in range(k)]
    for r in parts.select("cluster", F.posexplode("sums")).groupBy("cluster", "pos").agg(F.sum("col").alias("s")).collect():
        total[r["cluster"]][r["pos"]] = int(r["s"])
    return total


def cluster(vectors: DataFrame, scratch: Scratch, k: int, rounds: int, seed: int, id_col: str = "vec_id", vector_col: str = "embedding", dimensions: int = 64, scale: float = 1024.0) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that takes part, after
    ``rounds`` rounds of exact Lloyd steps and a last assignment."""
    spark = scratch.spark
    doubles = F.col(vector_col).cast("array<double>")
    used = vectors.where(usable(doubles, dimensions, scale)).select(F.col(id_col).cast("long").alias("id"), doubles.alias("v"))
    trees = scratch.write(used.mapInArrow(_grow_trees(dimensions, scale), _TREE), "trees")
    centroids = start_centroids(used, k, seed, dimensions, scale)
    out = f"{id_col} long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not centroids:
        return spark.createDataFrame([], out)
    for _ in range(rounds):
        sums = _round(trees, centroids, dimensions)
        centroids = [[x // s[0] for x in s[1:]] if s[0] else c for s, c in zip(sums, centroids, strict=True)]

    def assign(batches):
        for batch in batches:
            for block in _blocks(batch, dimensions):
                own, distance = block.clusters(centroids)
                yield pa.RecordBatch.from_arrays([block.ids, pa.array(own, pa.int32()), pa.array([min(d, LONGEST) for d in distance], pa.int64())], ["id", "cluster", "distance"])

    placed = scratch.write(trees.mapInArrow(tidy(assign), "id long, cluster int, distance long"), "placed")
    sums = {r["cluster"]: int(r["s"]) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    # one row a cluster, so k rows
    facts = spark.createDataFrame([(c, min(s, LONGEST), min(sum(sums.values()), LONGEST), digest[c]) for c, s in sums.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(facts), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
