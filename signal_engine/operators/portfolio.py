"""Choosing routes and programs: scorecards, posteriors, coverage, Pareto frontiers and diverse samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signal_engine.operators.ordered import cut_lineage


def beta_posterior(hits: Column, trials: Column) -> tuple[Column, Column]:
    """Mean and standard deviation of Beta(1 + hits, 1 + misses)."""
    a, b = hits + 1, trials - hits + 1
    return a / (a + b), F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))


def ucb(weight: Column, mean: Column, sd: Column, multiplier: Column, tried: Column, credits: Column, minutes: Column) -> Column:
    """exp(-0.35 n) (w mean m + 0.5 w sd) + 0.15 - 0.1 credits - 0.02 minutes."""
    return F.exp(-0.35 * tried) * (weight * mean * multiplier + 0.5 * weight * sd) + 0.15 - 0.1 * credits - 0.02 * minutes


def scorecard(trials: DataFrame, route: str, unit: str, relevant: Column, credits: str) -> DataFrame:
    """Per route: attempts, relevant units, units no other route found, reliability and utility per credit."""
    hits = trials.where(relevant).select(route, unit).distinct()
    owners = hits.withColumn("owners", F.count("*").over(Window.partitionBy(unit)))
    unique = owners.groupBy(route).agg(F.count("*").alias("relevant_units"), F.count_if(F.col("owners") == 1).alias("unique_units"))
    base = trials.groupBy(route).agg(F.count("*").alias("attempted"), F.count_if(relevant).alias("relevant"), F.sum(credits).alias("credits"))
    joined = base.join(unique, route, "left").fillna(0, ["relevant_units", "unique_units"])
    return joined.withColumn("reliability", F.col("relevant") / F.col("attempted")).withColumn("utility", F.try_divide(F.col("relevant_units") + 0.5 * F.col("unique_units"), F.col("credits")))


def pareto(df: DataFrame, id_col: str, gain: str, cost: str) -> DataFrame:
    """Rows that no other one dominates (at least the gain at no more cost, one of them strictly): by a running
    maximum over cost, not by comparing pairs. Range partitions of the costs keep their own running maximum and take
    that of the cheaper ones. Rows without gain or cost take no part."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    points = df.where(F.col(gain).isNotNull() & F.col(cost).isNotNull()).groupBy(cost).agg(F.max(gain).alias("_g"))
    parts = cut_lineage(points.repartitionByRange(n, cost).withColumn("_part", F.spark_partition_id()))
    tops = parts.groupBy("_part").agg(F.max("_g").alias("_top")).select("_part", F.max("_top").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_cheaper"))
    within = F.max("_g").over(Window.partitionBy("_part").orderBy(cost).rowsBetween(Window.unboundedPreceding, -1))
    best = parts.withColumn("_own", within).join(tops, "_part").withColumn("_p", F.greatest("_own", "_cheaper"))
    good = best.where(F.col("_p").isNull() | (F.col("_g") > F.col("_p"))).select(cost, F.col("_g").alias(gain))
    return df.join(good, [cost, gain], "left_semi")


def set_covers(units: DataFrame, costs: DataFrame, routes: list[str]) -> DataFrame:
    """Every non-empty subset of at most 12 routes with its covered units and cost: (mask, covered, cost)."""
    if len(routes) > 12:
        raise ValueError("exact search takes at most 12 routes")
    number = F.create_map(*[F.lit(x) for i, r in enumerate(routes) for x in (r, i)])
    bits = units.select("unit", F.call_function("shiftleft", F.lit(1), number[F.col("route")]).alias("bit")).groupBy("unit").agg(F.bit_or("bit").alias("bits")).groupBy("bits").agg(F.count("*").alias("n"))
    price = costs.agg(*[F.coalesce(F.sum(F.when(F.col("route") == r, F.col("credits"))), F.lit(0.0)).alias(f"c{i}") for i, r in enumerate(routes)])
    masks = units.sparkSession.range(1, 1 << len(routes)).select(F.col("id").cast("int").alias("mask")).join(price, F.lit(True))
    cost = sum((F.when(F.call_function("shiftright", F.col("mask"), F.lit(i)).bitwiseAND(F.lit(1)) == 1, F.col(f"c{i}")).otherwise(0.0) for i in range(len(routes))), F.lit(0.0))
    # at most 2^12 kinds of units meet at most 2^12 subsets, whatever the number of units
    return masks.withColumn("cost", cost).join(bits, F.col("mask").bitwiseAND(F.col("bits")) != 0, "left").groupBy("mask", "cost").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("covered"))


def best_cover(covers: DataFrame) -> DataFrame:
    """Most coverage, then least cost, then the smallest mask."""
    return covers.orderBy(F.desc("covered"), F.asc("cost"), F.asc("mask")).limit(1)


def cost_receipt(calls: DataFrame, operation: str, credits: str, hit: Column) -> DataFrame:
    """Per operation: calls, credits (unknown if any call's is), hits, credits per hit, and whether to cut it."""
    from signal_engine.operators.signals import null_sum

    out = calls.groupBy(operation).agg(F.count("*").alias("calls"), null_sum(F.col(credits)).alias("credits"), F.count_if(hit).alias("hits"))
    return out.withColumn("per_hit", F.try_divide("credits", "hits")).withColumn("cut", (F.col("hits") == 0) & (F.col("calls") >= 5))


def p95(df: DataFrame, group: str, value: str) -> DataFrame:
    """Nearest-rank 95th percentile."""
    return df.groupBy(group).agg(F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {value})").alias("p95"))
