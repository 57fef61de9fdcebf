"""Directed graphs as edge tables: reachability from seeds and order by levels, in rounds of joins with durable cuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signal_engine.operators.ordered import cut_lineage


def closure(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, node, depth): nodes that edges (a, b) lead to from each seed (seed), with the fewest steps; a seed itself
    only if a cycle leads back to it. Semi-naive: a round joins only the pairs found in the round before, and drops
    those known."""
    steps = cut_lineage(edges.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b").distinct())
    front = seeds.where("seed IS NOT NULL").select("seed", F.col("seed").alias("node")).distinct()
    found, depth = None, 0
    while True:
        depth += 1
        new = front.join(steps, front["node"] == steps["a"]).select("seed", F.col("b").alias("node")).distinct()
        if found is not None:
            new = new.join(found, ["seed", "node"], "left_anti")
        front = cut_lineage(new.withColumn("depth", F.lit(depth)))
        found = front if found is None else found.unionByName(front)
        if not front.head(1):
            return found
        if depth % 8 == 0:
            found = cut_lineage(found)


def _peel(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((node, level) of the nodes that can be ordered, (node) of the rest), taking off nodes without a predecessor
    round by round. Edges are distinct and join given nodes."""
    counts = edges.groupBy(F.col("b").alias("node")).agg(F.count("*").alias("before"))
    left = cut_lineage(nodes.join(counts, "node", "left").select("node", F.coalesce("before", F.lit(0)).cast("long").alias("before")))
    done, level = None, 0
    while True:
        free = cut_lineage(left.where("before = 0").select("node", F.lit(level).alias("level")))
        if not free.head(1):
            empty = free.select("node", "level")
            return (empty if done is None else done), left.select("node")
        done = free if done is None else done.unionByName(free)
        gone = edges.join(free.select(F.col("node").alias("a")), "a").groupBy(F.col("b").alias("node")).agg(F.count("*").alias("gone"))
        left = cut_lineage(left.where("before > 0").join(gone, "node", "left").select("node", (F.col("before") - F.coalesce("gone", F.lit(0))).alias("before")))
        level += 1
        if level % 8 == 0:
            done = cut_lineage(done)


def causal_order(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, level, status) for edges (a before b): ``ordered`` nodes have the level one above their highest
    predecessor's (0 without one); ``cyclic`` ones lie on a cycle or between two; ``blocked`` ones come after a cycle.
    The latter two have no level. Sorting by (level, node) puts every predecessor first."""
    steps = cut_lineage(edges.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b").distinct())
    every = steps.select(F.col("a").alias("node")).unionByName(steps.select(F.col("b").alias("node")))
    every = (every if nodes is None else every.unionByName(nodes.select("node").where("node IS NOT NULL"))).distinct()
    ordered, rest = _peel(steps, every)
    rest = cut_lineage(rest)
    inner = steps.join(rest.withColumnRenamed("node", "a"), "a").join(rest.withColumnRenamed("node", "b"), "b")
    blocked, cyclic = _peel(inner.select(F.col("b").alias("a"), F.col("a").alias("b")), rest)
    none = F.lit(None).cast("int").alias("level")
    return ordered.select("node", "level", F.lit("ordered").alias("status")).unionByName(cyclic.select("node", none, F.lit("cyclic").alias("status"))).unionByName(blocked.select("node", none, F.lit("blocked").alias("status")))
