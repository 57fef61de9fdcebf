"""Ranks, fusion of rankings, rerank blends, and running limits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signal_engine.operators.ordered import cut_lineage, fold_in_order


def rank_all(df: DataFrame, *order: str | Column) -> DataFrame:
    """Global 1-based rank without a single-partition window: range partitions are ranked apart and offset by
    the sizes of those before them. ``order`` must be total. The partitioned rows are written once, as two reads of a
    range partitioning may sample other bounds."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = cut_lineage(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    within = parts.withColumn("_rn", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    sizes = within.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return within.join(before.select("_part", "_before"), "_part").withColumn("rank", F.col("_before") + F.col("_rn")).drop("_part", "_rn", "_before")


def top_per_group(df: DataFrame, group: str | Sequence[str], n: int, *order: str | Column) -> DataFrame:
    """The first n rows of each group, with their rank."""
    keys = [group] if isinstance(group, str) else list(group)
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def reciprocal_rank_fusion(ranks: DataFrame, weights: Mapping[str, float] | None = None, k: int = 60) -> DataFrame:
    """Fuse (route, item, rank): the sum of weight / (k + rank); an item counts once per route, at its best rank.
    Columns: item, score, normalized (by the best possible score), best_rank."""
    best = ranks.groupBy("route", "item").agg(F.min("rank").alias("rank"))
    weight = F.lit(1.0)
    if weights:
        weight = F.coalesce(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("route")], F.lit(1.0))
    routes = best.select("route").distinct().select(F.sum(weight).alias("top"))
    fused = best.groupBy("item").agg(F.sum(weight / (k + F.col("rank"))).alias("score"), F.min("rank").alias("best_rank"))
    return fused.join(routes, F.lit(True)).select("item", "score", (F.col("score") * (k + 1) / F.col("top")).alias("normalized"), "best_rank")


def diversify(df: DataFrame, route: str, author: str, score: str, item: str, reserve: int = 2, per_author: int = 3, floor: float = 0.25) -> DataFrame:
    """Reserve each route's best rows of at least floor, cap rows per author; reserved rows come first."""
    by_route = F.row_number().over(Window.partitionBy(route).orderBy(F.desc(score), item))
    marked = df.withColumn("reserved", (by_route <= reserve) & (F.col(score) >= floor))
    by_author = F.row_number().over(Window.partitionBy(author).orderBy(F.desc("reserved"), F.desc(score), item))
    return marked.withColumn("_a", by_author).where(F.col("_a") <= per_author).drop("_a")


def normalize_engagement(df: DataFrame, group: str, value: str) -> DataFrame:
    """Min-max of log1p within the group; 0.5 if flat, null for values that are not positive."""
    logged = F.when(F.col(value) > 0, F.log1p(value))
    w = Window.partitionBy(group)
    low, high = F.min(logged).over(w), F.max(logged).over(w)
    return df.withColumn("engagement", F.when(logged.isNotNull(), F.when(high == low, 0.5).otherwise(F.try_divide(logged - low, high - low))))


#: Weights and penalties of the rerank policies.
ENTITY_MISS, ENTITY_MISS_OF_RESEARCH = 0.25, 0.2  # the second comes on top of the first
POLICIES = {
    "research": {
        "weights": {"model": 0.6, "rrf": 0.2, "relevance": 0.0, "freshness": 0.1, "source_quality": 0.05, "engagement": 0.05, "verification": 0.0, "corroboration": 0.0},
        "entity_miss": ENTITY_MISS + ENTITY_MISS_OF_RESEARCH, "low_below": 0.2, "low_factor": 0.3,
    },
    "entity": {
        "weights": {"model": 0.55, "rrf": 0.25, "relevance": 0.1, "freshness": 0.05, "source_quality": 0.0, "engagement": 0.0, "verification": 0.0, "corroboration": 0.05},
        "entity_miss": ENTITY_MISS,
    },
    "verified_entity": {
        "weights": {"model": 0.35, "rrf": 0.15, "relevance": 0.1, "freshness": 0.05, "source_quality": 0.0, "engagement": 0.0, "verification": 0.2, "corroboration": 0.15},
        "entity_miss": ENTITY_MISS, "verification_floor": 0.5,
    },
}


def rerank(df: DataFrame, policy: str = "research") -> DataFrame:
    """Blend (id, model 0..100, relevance, rrf, freshness, source_quality, engagement, verification, corroboration,
    entity_miss, hard_fail) to judge, eligible and final. Without a model score relevance stands in; without rrf
    too; unknown freshness is 0.5 and unknown source quality 0.6. Ineligible rows get 0 and rank last."""
    p = POLICIES[policy]
    total = sum(p["weights"].values())
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    relevance = F.coalesce("relevance", F.lit(0.0))
    parts = {
        "model": F.coalesce(F.col("model") / 100, relevance), "rrf": F.coalesce("rrf", relevance), "relevance": relevance, "freshness": F.coalesce("freshness", F.lit(0.5)),
        "source_quality": F.coalesce("source_quality", F.lit(0.6)), "engagement": F.coalesce("engagement", F.lit(0.0)), "verification": F.coalesce("verification", F.lit(0.0)), "corroboration": F.coalesce("corroboration", F.lit(0.0)),
    }
    judge = unit(parts["model"])
    score = sum((unit(c) * (p["weights"][n] / total) for n, c in parts.items()), F.lit(0.0))
    if "low_below" in p:
        score = score * F.when(judge < p["low_below"], p["low_factor"]).otherwise(1.0)
    score = score - F.when(F.coalesce("entity_miss", F.lit(False)), p["entity_miss"]).otherwise(0.0)
    eligible = ~F.coalesce("hard_fail", F.lit(False))
    if "verification_floor" in p:
        eligible = eligible & (unit(parts["verification"]) >= p["verification_floor"])
    return df.withColumn("judge", judge).withColumn("eligible", eligible).withColumn("final", F.when(eligible, unit(score)).otherwise(0.0))


def rerank_order() -> list[Column]:
    return [F.desc("eligible"), F.desc("final"), F.desc("judge"), F.desc("relevance"), F.asc("id")]


def fallback_score(relevance: Column, retrieval: Column, freshness: Column) -> Column:
    return 0.6 * relevance + 0.25 * retrieval + 0.15 * freshness


def rolling_count(df: DataFrame, key: str, time: str, condition: Column, seconds: int = 86_400, alias: str = "recent") -> DataFrame:
    """How many rows of the key hold within the window that ends at each row (the row included)."""
    w = Window.partitionBy(key).orderBy(F.unix_micros(F.col(time).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return df.withColumn(alias, F.count_if(condition).over(w))


def capacity(df: DataFrame, key: str, time: str, sent: Column, in_flight: Column, cap: int) -> DataFrame:
    """Deny a row once what was sent or is in flight within a day reaches the cap."""
    return rolling_count(df, key, time, sent | in_flight, alias="used").withColumn("allowed", F.col("used") < cap)


def attempts(df: DataFrame, key: str, *order: str | Column) -> DataFrame:
    return df.withColumn("attempt", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def latest(df: DataFrame, key: str, value: Column, by: Column, alias: str = "latest") -> DataFrame:
    return df.groupBy(key).agg(F.max_by(value, by).alias(alias))


def greedy_budget(df: DataFrame, key: str, order: str, cost: str, budget: float) -> DataFrame:
    """Admit rows in order while they fit, skipping what does not: (key, order, cost, admitted). A row without a cost
    is neither admitted nor refused (null) and spends nothing."""

    def admit(spent: float, row: dict) -> tuple[float, bool | None]:
        if row[cost] is None:
            return spent, None
        fits = spent + row[cost] <= budget
        return spent + (row[cost] if fits else 0.0), fits

    rows = df.select(key, F.col(order).cast("bigint").alias(order), F.col(cost).cast("double").alias(cost))
    return fold_in_order(rows, key, [order, cost], float, admit, "admitted", "boolean", [key, order, cost])
