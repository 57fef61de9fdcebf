"""Set operations with a defined order: deduplication, net-new rows, upserts and chunks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signal_engine.operators.ranking import rank_all


def keep_first(df: DataFrame, key: str | Sequence[str], *order: str | Column) -> DataFrame:
    """The first row of each key in the given order."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def drop_ambiguous(df: DataFrame, key: str, of: str) -> DataFrame:
    """Without the rows of keys that have more than one value of ``of``."""
    many = df.groupBy(key).agg(F.min(of).alias("_a"), F.max(of).alias("_b")).where("_a <> _b").select(key)
    return df.join(many, key, "left_anti")


def net_new(df: DataFrame, seen: DataFrame, key: str | Sequence[str], *order: str | Column) -> DataFrame:
    """Rows whose key was not seen, once each."""
    keys = [key] if isinstance(key, str) else list(key)
    return keep_first(df.join(seen.select(*keys).distinct(), keys, "left_anti"), keys, *order)


def union_first(frames: Sequence[DataFrame], key: str, *order: str | Column) -> DataFrame:
    """Bag union in phase order; the earliest phase's row of each key stays."""
    out = None
    for phase, frame in enumerate(frames):
        part = frame.withColumn("_phase", F.lit(phase))
        out = part if out is None else out.unionByName(part)
    return keep_first(out.where(F.col(key).isNotNull()), key, "_phase", *order).drop("_phase")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New values over old ones, old ones where the new are null; both sides' rows stay."""
    others = [c for c in old.columns if c != key]
    return old.alias("o").join(new.alias("n"), key, "full_outer").select(key, *[F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in others])


def replace_children(old: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """The children of every parent in new replace that parent's old ones."""
    return old.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new)


def chunks(df: DataFrame, order: Sequence[str | Column], size: int, least: int) -> DataFrame:
    """Chunk numbers of ``size`` rows; a last chunk under ``least`` rows borrows from the one before. ``order`` must be
    total."""
    ranked = rank_all(df, *order)
    counted = ranked.join(ranked.agg(F.count("*").alias("_n")), F.lit(True))  # one row
    tail = F.pmod("_n", F.lit(size))
    borrowed = (tail > 0) & (tail < least) & (F.col("_n") > size) & (F.col("rank") > F.col("_n") - least)
    base = F.floor((F.col("rank") - 1) / size)
    return counted.withColumn("chunk", F.when(borrowed, F.floor((F.col("_n") - 1) / size)).otherwise(base).cast("long")).drop("_n", "rank")


def gated(df: DataFrame, condition: Column, column: str, value: Column) -> DataFrame:
    """A column only where the gate holds, null elsewhere."""
    return df.withColumn(column, F.when(condition, value))


def gated_costly(df: DataFrame, key: str, condition: Column, compute) -> DataFrame:
    """For costly functions: compute(rows past the gate) -> (key, ...), joined back; other rows get nulls."""
    return df.join(compute(df.where(condition)), key, "left")


def prune_or_all(df: DataFrame, group: str, passes: Column) -> DataFrame:
    """Rows that pass, or all rows of a group in which none does."""
    any_pass = F.max(passes.cast("int")).over(Window.partitionBy(group))
    return df.withColumn("_any", any_pass).where(passes | (F.col("_any") == 0)).drop("_any")
