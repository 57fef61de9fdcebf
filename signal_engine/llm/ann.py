"""Approximate nearest neighbours: a forest of random-projection trees.

Trees are grown on a bounded sample of the rows (``sample_rows``, chosen by a hash of the id): a node splits
at the median of the projection on the line through two of its rows. Equal vectors are one point, with the k + 1
smallest of their ids (no query needs more of them). Every point is dealt to its leaf in every tree. A query walks
all trees through one shared priority queue, ordered by the sum of the squared margins by which a leaf's path departs
from the query's, until the leaves it took
hold ``search_points`` points (counted with repeats across trees).

That budget is measured, not given: ``probes`` of the queries are compared with every point, and the
budget is the least one at which the queue's order would have met the share ``recall`` of their k nearest. So it
follows the table's size and shape: it stays small where the vectors have structure and is a large share of the table
where they have none. The probes cost one pass over the points.

Points stay where they are: the queries are taken in blocks of at most ``block_queries``, each block is broadcast
with the leaves its queries took, and every task ranks its own points of those leaves by exact distance on the
original vectors. The best k of all tasks remain.

Defined results: vectors that are null, zero, of another length than most of the sample, or that hold null
or non-finite components take no part; neither do rows without an id; rows with the query's own id are not
candidates; a repeated id counts once, at its smallest distance; ties go to the smaller id; fewer than k candidates
give fewer rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signal_engine.llm.common import Scratch

#: Points that a task holds at once.
CHUNK = 30_000


@dataclass(frozen=True)
class Forest:
    dim: int
    normals: np.ndarray  # inner nodes x dim, float32
    offsets: np.ndarray
    children: np.ndarray  # inner nodes x 2: node number, or -1 - leaf number
    roots: tuple[int, ...]  # one for each tree, numbered as children
    leaf_tree: np.ndarray  # tree of each leaf


def grow_forest(sample: np.ndarray, trees: int, leaf_rows: int, seed: int = 7) -> Forest:
    rng = np.random.default_rng(seed)
    normals, offsets, children, roots, leaf_tree = [], [], [], [], []

    def build(rows: np.ndarray, tree: int) -> int:
        if len(rows) > leaf_rows:
            for _ in range(8):
                a, b = sample[rng.choice(rows, 2, replace=False)].astype(np.float64)
                length = np.linalg.norm(a - b)
                if length == 0:
                    continue
                normal = ((a - b) / length).astype(np.float32)
                at = sample[rows] @ normal
                cut = np.float32(np.median(at))
                high = at >= cut
                if 0 < high.sum() < len(rows):
                    node = len(normals)
                    normals.append(normal)
                    offsets.append(cut)
                    children.append([0, 0])
                    children[node] = [build(rows[~high], tree), build(rows[high], tree)]
                    return node
        leaf_tree.append(tree)
        return -len(leaf_tree)

    for tree in range(trees):
        roots.append(build(np.arange(len(sample)), tree))
    dim = sample.shape[1]
    return Forest(dim, np.asarray(normals, np.float32).reshape(-1, dim), np.asarray(offsets, np.float32), np.asarray(children, np.int64).reshape(-1, 2), tuple(roots), np.asarray(leaf_tree, np.int32))


def leaves_of(forest: Forest, rows: np.ndarray) -> np.ndarray:
    """rows x trees: the leaf of each row in each tree."""
    out = np.empty((len(rows), len(forest.roots)), np.int32)
    for tree, root in enumerate(forest.roots):
        node = np.full(len(rows), root, np.int64)
        while (inner := np.flatnonzero(node >= 0)).size:
            at = node[inner]
            high = np.einsum("ij,ij->i", rows[inner], forest.normals[at]) >= forest.offsets[at]
            node[inner] = forest.children[at, high.astype(np.int64)]
        out[:, tree] = -1 - node
    return out


def search(forest: Forest, query: np.ndarray, sizes: np.ndarray, budget: float) -> list[int]:
    """Leaves in the order of the shared queue, until they hold ``budget`` entries."""
    margins = (forest.normals @ query - forest.offsets).astype(np.float64).tolist() if len(forest.normals) else []
    children, taken, held = forest.children, [], 0.0
    queue = [(0.0, root) for root in forest.roots]
    heapq.heapify(queue)
    while queue and held < budget:
        priority, node = heapq.heappop(queue)
        if node < 0:
            taken.append(-1 - node)
            held += sizes[-1 - node]
            continue
        m = margins[node]
        low, high = int(children[node, 0]), int(children[node, 1])
        near, far = (low, high) if m < 0 else (high, low)
        heapq.heappush(queue, (priority, near))
        heapq.heappush(queue, (priority + m * m, far))
    return taken


def leaf_priorities(forest: Forest, query: np.ndarray) -> np.ndarray:
    """The priority with which the shared queue gives each leaf."""
    out = np.empty(len(forest.leaf_tree))
    margins = (forest.normals @ query - forest.offsets).astype(np.float64) if len(forest.normals) else np.zeros(0)
    node, priority = np.asarray(forest.roots, np.int64), np.zeros(len(forest.roots))
    while len(node):
        leaf = node < 0
        out[-1 - node[leaf]] = priority[leaf]
        node, priority = node[~leaf], priority[~leaf]
        m = margins[node]
        below = priority + np.where(m >= 0, m * m, 0), priority + np.where(m < 0, m * m, 0)
        node, priority = forest.children[node].T.ravel(), np.concatenate(below)
    return out


def needed_points(forest: Forest, query: np.ndarray, sizes: np.ndarray, leaves: np.ndarray) -> np.ndarray:
    """The budget from which on a search takes one of each point's leaves (points x trees)."""
    order = np.argsort(leaf_priorities(forest, query), kind="stable")
    before = np.empty(len(order))
    before[order] = np.cumsum(sizes[order]) - sizes[order]
    return before[leaves].min(1) + 1


def budget_for(needed: np.ndarray, recall: float) -> int:
    """The least budget that meets the share ``recall`` of the probes' neighbours."""
    return int(np.sort(needed)[max(0, int(np.ceil(recall * len(needed))) - 1)]) if len(needed) else 1


def best_of(query: np.ndarray, vec: np.ndarray, dist: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k nearest, nearest first, each id once; ties to the smaller id."""
    order = np.lexsort((dist, vec, query))
    q, i = query[order], vec[order]
    order = order[np.concatenate([[True], (q[1:] != q[:-1]) | (i[1:] != i[:-1])])] if len(order) else order
    order = order[np.lexsort((vec[order], dist[order], query[order]))]
    starts = np.flatnonzero(np.diff(query[order], prepend=-1))
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return order[rank < k]


@dataclass(frozen=True)
class Block:
    """A block of queries: ids, vectors, and for each leaf the queries that took it."""

    ids: np.ndarray
    vectors: np.ndarray
    first: np.ndarray  # leaf -> first place in takers
    takers: np.ndarray


def block_of(ids: np.ndarray, vectors: np.ndarray, taken: list[np.ndarray], leaves: int) -> Block:
    leaf = np.concatenate([*taken, np.zeros(0, np.int32)]).astype(np.int64)
    who = np.repeat(np.arange(len(taken)), [len(t) for t in taken])
    order = np.argsort(leaf, kind="stable")
    return Block(ids, vectors, np.searchsorted(leaf[order], np.arange(leaves + 1)), who[order])


def _squares(vectors: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", vectors, vectors)


def _near(a: np.ndarray, b: np.ndarray, a2: np.ndarray, b2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(squared distances by a matrix product, how far off they may be)."""
    return a2[:, None] + b2[None] - 2 * (a @ b.T), 1e-12 * (a2 + b2.max(initial=0.0))


def rank_points(block: Block, vectors: np.ndarray, leaf: np.ndarray, ids: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, distance): the k nearest of the points (rows of vectors) in the leaves that each query took. Matrix
    products choose what can be among them, within their error; the distances given are then taken exactly."""
    query, point, near, none = [], [], [], np.zeros(0, np.int64)
    of_block, of_points = _squares(block.vectors), _squares(vectors)

    def best(q, p, d):
        """Each pair once, and of a query those that can still be among the k + 1 nearest."""
        order = np.lexsort((p, q))
        a, b = q[order], p[order]
        order = order[np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])] if len(order) else order
        order = order[np.lexsort((d[order], q[order]))]
        starts = np.flatnonzero(np.diff(q[order], prepend=-1))
        sizes = np.diff(np.append(starts, len(order)))
        last = d[order][np.minimum(starts + k, starts + sizes - 1)]
        slack = 4e-12 * (of_block[q[order][starts]] + of_points.max(initial=0.0)) if len(starts) else last
        order = order[d[order] <= np.repeat(last + slack, sizes)]
        return q[order], p[order], d[order]

    for tree in range(leaf.shape[1]):
        order = np.argsort(leaf[:, tree], kind="stable")
        own = leaf[order, tree]
        cuts = np.flatnonzero(np.diff(own, prepend=-1))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(own)], strict=True):
            takers, rows = block.takers[block.first[own[a]] : block.first[own[a] + 1]], order[a:b]
            step = max(1, 2_000_000 // (b - a))
            for i in range(0, len(takers), step):
                part = takers[i : i + step]
                d, off = _near(block.vectors[part], vectors[rows], of_block[part], of_points[rows])
                if len(rows) > k + 1:
                    bound = np.partition(d, k, axis=1)[:, k]
                    x, y = np.nonzero(d <= (bound + 2 * off)[:, None])  # the k + 1 nearest and all that may tie with them
                else:
                    x, y = np.nonzero(np.ones(d.shape, bool))
                query.append(part[x])
                point.append(rows[y])
                near.append(d[x, y])
        if sum(map(len, query)) > 4_000_000 or tree == leaf.shape[1] - 1:
            query, point, near = ([x] for x in best(np.concatenate([none, *query]), np.concatenate([none, *point]), np.concatenate([np.zeros(0), *near])))
    query, point = query[0], point[0]
    if not len(query):
        return none, none, np.zeros(0)
    dist = np.concatenate([np.sqrt(((block.vectors[query[i : i + 100_000]] - vectors[point[i : i + 100_000]]) ** 2).sum(1)) for i in range(0, len(query), 100_000)])
    sizes = np.fromiter((len(ids[p]) for p in point), np.int64, len(point))
    query, dist, vec = np.repeat(query, sizes), np.repeat(dist, sizes), np.concatenate([ids[p] for p in point])
    other = block.ids[query] != vec
    query, vec, dist = query[other], vec[other], dist[other]
    at = best_of(query, vec, dist, k)
    return block.ids[query[at]], vec[at], dist[at]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def valid_vector(v: Column) -> Column:
    """Not null, not zero, every component finite."""
    d = v.cast("array<double>")
    bad = F.exists(d, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~bad & F.exists(d, lambda x: x != 0)


def _lists(column: pa.Array) -> list[np.ndarray]:
    ends = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(column)).astype(np.int64))])
    flat = np.asarray(column.flatten()).astype(np.int64)
    return [flat[x:y] for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def _probe(dealt: DataFrame, ids: np.ndarray, probes: np.ndarray, k: int) -> DataFrame:
    """(probe, distance, leaves): the k nearest points of each probe that hold another id, among all points."""
    shared = dealt.sparkSession.sparkContext.broadcast((ids, probes, _squares(probes)))

    def nearest(batches):
        own, q, q2 = shared.value
        kept = None
        for batch in batches:
            v, leaves, held = _matrix(batch.column(0), q.shape[1]), np.asarray(batch.column(2).flatten()).reshape(batch.num_rows, -1), _lists(batch.column(1))
            sole = np.asarray([x[0] for x in held])
            alone = np.asarray([len(x) == 1 for x in held])
            for i in range(0, len(v), 4000):
                part = slice(i, i + 4000)
                d, _ = _near(q, v[part], q2, _squares(v[part]))
                d = np.where((own[:, None] == sole[part][None]) & alone[part][None], np.inf, np.maximum(d, 0))
                at = np.argsort(d, axis=1, kind="stable")[:, :k]
                d, found = np.take_along_axis(d, at, 1), leaves[part][at]
                if kept is not None:
                    d, found = np.concatenate([kept[0], d], 1), np.concatenate([kept[1], found], 1)
                    at = np.argsort(d, axis=1, kind="stable")[:, :k]
                    d, found = np.take_along_axis(d, at, 1), np.take_along_axis(found, at[..., None], 1)
                kept = d, found
        if kept is not None:
            x, y = np.nonzero(np.isfinite(kept[0]))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32()), pa.array(kept[0][x, y]), pa.array(kept[1][x, y].tolist(), pa.list_(pa.int32()))], ["probe", "distance", "leaves"])

    near = dealt.mapInArrow(nearest, "probe int, distance double, leaves array<int>")
    return near.withColumn("r", F.row_number().over(Window.partitionBy("probe").orderBy("distance", "leaves"))).where(F.col("r") <= k)


def neighbours(
    rows: DataFrame,
    is_query: Column,
    scratch: Scratch,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    trees: int = 24,
    leaf_rows: int = 400,
    sample_rows: int = 40_000,
    recall: float = 0.95,
    probes: int = 200,
    search_points: int | None = None,
    block_leaves: int = 8_000_000,
    report: dict | None = None,
) -> DataFrame:
    """(query_id, rank, vec_id, score) with the k nearest found of every row for which is_query holds. search_points
    sets the budget instead of measuring it. block_leaves bounds what is broadcast at once: the leaves that a block of
    queries took. report gets the points, the budget and the share of points that a query read on average."""
    spark = rows.sparkSession
    good = rows.where(valid_vector(F.col(vector_col))).where(F.col(id_col).isNotNull())
    vectors = good.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    n = vectors.count()
    sample = vectors.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample_rows / max(1, n)))) if n > sample_rows else vectors
    found = sample.select("v").toArrow()["v"].combine_chunks()
    result = "query_id long, rank int, vec_id long, score double"
    if not len(found):
        return spark.createDataFrame([], result)
    dim = sorted(Counter(pc.list_value_length(found).to_pylist()).items(), key=lambda x: (-x[1], x[0]))[0][0]
    fitted = np.unique(_matrix(found.filter(pc.equal(pc.list_value_length(found), dim)), dim).astype(np.float32), axis=0)
    # a leaf's share of the sample is its share of the rows; at least 4 sampled rows in a leaf
    forest = grow_forest(fitted, trees, max(4, int(leaf_rows * min(1.0, sample_rows / n))))
    shared = spark.sparkContext.broadcast(forest)

    # a point for each distinct vector, with its k + 1 smallest ids; Spark limits a group before the shuffle, too
    fit = vectors.where(F.size("v") == dim)
    few = fit.select("id", "v").distinct().withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("r") <= k + 1)
    points = few.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))

    def deal(batches):
        f = shared.value
        for batch in batches:
            m = _matrix(batch.column(0), f.dim)
            for i in range(0, len(m), 4000):
                leaf = leaves_of(f, m[i : i + 4000].astype(np.float32))
                part = batch.slice(i, 4000)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(leaf.tolist(), pa.list_(pa.int32()))], ["v", "ids", "leaves"])

    dealt = scratch.write(points.mapInArrow(deal, "v array<double>, ids array<long>, leaves array<int>"), "dealt")
    sizes = np.zeros(len(forest.leaf_tree), np.int64)
    for r in dealt.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count().collect():  # one row for each leaf of the model
        sizes[r["leaf"]] = r["count"]
    held = spark.sparkContext.broadcast(sizes)
    queries = fit.where("q").select("id", "v").distinct()

    if search_points is None:
        few = queries.orderBy(F.xxhash64("id"), "id", "v").limit(probes).toArrow()
        if not len(few):
            return spark.createDataFrame([], result)
        asking = _matrix(few["v"].combine_chunks(), dim)
        near = _probe(dealt, np.asarray(few["id"]), asking, k).select("probe", "leaves").collect()  # at most k x probes rows
        by_probe: dict[int, list] = {}
        for r in near:
            by_probe.setdefault(r["probe"], []).append(r["leaves"])
        needed = [needed_points(forest, asking[p].astype(np.float32), sizes, np.asarray(leaves)) for p, leaves in sorted(by_probe.items())]
        search_points = budget_for(np.concatenate([np.zeros(0), *needed]), recall)

    def walk(batches):
        f, size = shared.value, held.value
        for batch in batches:
            m = _matrix(batch.column(1), f.dim)
            taken = [search(f, q.astype(np.float32), size, search_points) for q in m]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(taken, pa.list_(pa.int32()))], ["id", "v", "taken"])

    asked = scratch.write(queries.mapInArrow(walk, "id long, v array<double>, taken array<int>"), "asked")
    amount = asked.agg(F.count("*").alias("n"), F.sum(F.size("taken") + 2 * dim).alias("leaves")).first()
    blocks = -(-(amount["leaves"] or 0) // block_leaves)
    near = None
    for b in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toArrow()
        block = spark.sparkContext.broadcast(block_of(np.asarray(own["id"]), _matrix(own["v"].combine_chunks(), dim), _lists(own["taken"].combine_chunks()), len(sizes)))

        def ranked(batches, block=block):
            kept: list[pa.RecordBatch] = []

            def out():
                points = pa.Table.from_batches(kept).combine_chunks()
                kept.clear()
                leaf = np.asarray(points["leaves"].combine_chunks().flatten()).reshape(len(points), -1)
                q, i, d = rank_points(block.value, _matrix(points["v"].combine_chunks(), dim), leaf, _lists(points["ids"].combine_chunks()), k)
                return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(d, pa.float64())], ["query_id", "vec_id", "score"])

            for batch in batches:
                kept.append(batch)
                if sum(x.num_rows for x in kept) >= CHUNK:
                    yield out()
            if kept:
                yield out()

        part = dealt.mapInArrow(ranked, "query_id long, vec_id long, score double")
        near = part if near is None else near.unionByName(part)
    if near is None:
        return spark.createDataFrame([], result)
    if report is not None:
        report |= {"rows": n, "budget": search_points, "leaves": len(sizes), "leaves_a_query": amount["leaves"] / amount["n"] - 2 * dim}
    once = near.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
