"""Differential signal analysis: which words, tools and roles separate won from lost rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lift(won: Column, won_all: Column, lost: Column, lost_all: Column) -> Column:
    """Smoothed ratio of shares, ((w + .5) / (W + 1)) / ((l + .5) / (L + 1))."""
    return ((won + 0.5) / (won_all + 1)) / ((lost + 0.5) / (lost_all + 1))


def keyword_counts(rows: DataFrame, keywords: Sequence[str], won: Column, website: Column, jobs: Column) -> DataFrame:
    """Per keyword: won and lost hits in website + ' ' + jobs, where they come from, and the rounded lift. All
    keywords are counted in one pass with map-side aggregation; the text is read once."""
    both = F.concat_ws(" ", website, jobs)
    aggs = [F.count_if(won).alias("w"), F.count_if(~won).alias("l")]
    for i, k in enumerate(keywords):
        in_site, in_jobs = website.contains(k), jobs.contains(k)
        aggs += [
            F.count_if(won & both.contains(k)).alias(f"w{i}"), F.count_if(~won & both.contains(k)).alias(f"l{i}"),
            F.count_if(in_site & ~in_jobs).alias(f"s{i}"), F.count_if(~in_site & in_jobs).alias(f"j{i}"), F.count_if(in_site & in_jobs).alias(f"b{i}"),
        ]
    one = rows.agg(*aggs)
    per = [F.struct(F.lit(k).alias("keyword"), F.col(f"w{i}").alias("won_hits"), F.col(f"l{i}").alias("lost_hits"), F.col(f"s{i}").alias("website_only"), F.col(f"j{i}").alias("jobs_only"), F.col(f"b{i}").alias("both")) for i, k in enumerate(keywords)]
    return one.select("w", "l", F.inline(F.array(*per))).withColumn("lift", F.round(lift(F.col("won_hits"), F.col("w"), F.col("lost_hits"), F.col("l")), 2)).drop("w", "l")


def with_support(counts: DataFrame, won: int = 2, lost: int = 1) -> DataFrame:
    return counts.where((F.col("won_hits") >= won) | (F.col("lost_hits") >= lost))


def anti_fit(counts: DataFrame, below: float = 0.5, support: int = 3) -> DataFrame:
    """Keywords of lost rows: rounded lift below the bound, with enough lost hits."""
    return counts.where((F.col("lift") < below) & (F.col("lost_hits") >= support))


def role_prevalence(rows: DataFrame, roles: Mapping[str, Sequence[str]], text: Column, won: Column) -> DataFrame:
    """Share of won and lost rows (with text) that mention any keyword of a role; keywords are used as given."""
    has = text != ""
    hit = {r: F.array_contains(F.transform(F.array(*[F.lit(k) for k in ks]), lambda k: text.contains(k)), True) for r, ks in roles.items()}
    aggs = [F.count_if(won & has).alias("w"), F.count_if(~won & has).alias("l")]
    for i, r in enumerate(roles):
        aggs += [F.count_if(won & has & hit[r]).alias(f"w{i}"), F.count_if(~won & has & hit[r]).alias(f"l{i}")]
    one = rows.agg(*aggs)
    return one.select("w", "l", F.inline(F.array(*[F.struct(F.lit(r).alias("role"), F.col(f"w{i}").alias("won_hits"), F.col(f"l{i}").alias("lost_hits")) for i, r in enumerate(roles)])))


def coverage(rows: DataFrame, group: str, text: Column, least: int = 100) -> DataFrame:
    """Rows, rows with text longer than ``least``, their percentage and mean length per group."""
    good = F.length(text) > least
    return rows.groupBy(group).agg(F.count("*").alias("n"), F.count_if(good).alias("covered"), F.round(100 * F.count_if(good) / F.count("*"), 1).alias("pct"), F.round(F.avg(F.when(good, F.length(text))), 1).alias("avg_chars"))


def column_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Present, missing and distinct values per column in one pass."""
    aggs = []
    for c in columns:
        aggs += [F.count(c).alias(f"p_{c}"), F.count_if(F.col(c).isNull()).alias(f"m_{c}"), F.count_distinct(c).alias(f"d_{c}")]
    return df.agg(*aggs).select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"p_{c}").alias("present"), F.col(f"m_{c}").alias("missing"), F.col(f"d_{c}").alias("distinct_values")) for c in columns])))


def confusion(df: DataFrame, truth: Column, guess: Column) -> DataFrame:
    one = df.agg(F.count_if(truth & guess).alias("tp"), F.count_if(~truth & guess).alias("fp"), F.count_if(truth & ~guess).alias("fn"), F.count_if(~truth & ~guess).alias("tn"))
    p, r = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    return one.withColumn("precision", p).withColumn("recall", r).withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def mismatch_rate(df: DataFrame, mismatch: Column, warn_above: float = 0.2) -> DataFrame:
    return df.agg(F.avg(mismatch.cast("double")).alias("rate")).withColumn("warning", F.col("rate") > warn_above)


def entity_frequency(df: DataFrame, text: str, top: int = 5) -> DataFrame:
    """The most frequent handles, hashtags and domains of a text column."""
    from pyspark.sql import Window

    kinds = {"handle": r"(?:^|\s)(@\w{2,})", "hashtag": r"(?:^|\s)(#\w{2,})", "domain": r"https?://(?:www\.)?([\w.-]+)"}

    def tagged(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(F.lower(text), F.lit(pattern), 1), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("entity")))

    found = F.explode(F.flatten(F.array(*[tagged(k, p) for k, p in kinds.items()])))
    counted = df.select(found.alias("f")).groupBy("f.kind", "f.entity").count()
    return counted.withColumn("rank", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("count"), "entity"))).where(F.col("rank") <= top)


def hash_audit(df: DataFrame, column: str) -> DataFrame:
    """Input, valid, malformed, duplicate and raw-address counts of an audience column."""
    v = F.lower(F.trim(F.coalesce(F.col(column), F.lit(""))))
    ok = v.rlike("^[a-f0-9]{64}$")
    valid = F.when(ok, v)
    return df.agg(F.count("*").alias("input"), F.count_distinct(valid).alias("output"), F.count_if(~ok).alias("malformed"), (F.count(valid) - F.count_distinct(valid)).alias("duplicate"), F.max(v.contains("@")).alias("raw_email_present"))


def coverage_lift(report: DataFrame, baseline: str) -> DataFrame:
    """Each audience's matched share against the baseline's: points, relative lift and matches gained."""
    base = report.where(F.col("audience") == baseline).select((F.col("matched") / F.col("rows")).alias("b"))
    rate = F.col("matched") / F.col("rows")
    return report.join(base, F.lit(True)).select("audience", F.round(100 * rate, 2).alias("pct"), F.round(100 * (rate - F.col("b")), 2).alias("points"), F.round(F.try_divide(rate - F.col("b"), "b"), 4).alias("relative"), F.round((rate - F.col("b")) * F.col("rows"), 0).cast("long").alias("gained"))


def null_sum(c: Column) -> Column:
    """A sum that is unknown when any part is."""
    return F.when(F.count_if(c.isNull()) > 0, None).otherwise(F.sum(c))


def metrics(df: DataFrame, registry: Mapping[str, Column], names: Sequence[str], dimensions: Mapping[str, Column], base: Column | None = None, filters: Sequence[Column] = (), limit: int | None = None, order: Sequence[Column] = ()) -> DataFrame:
    """A semantic-layer query: metrics by dimensions under base and named filters. A limit needs an order."""
    if limit is not None and not order:
        raise ValueError("a row limit does not imply an order; give one")
    unknown = [n for n in names if n not in registry]
    if unknown:
        raise ValueError(f"unknown metrics: {unknown}")
    for condition in [*([base] if base is not None else []), *filters]:
        df = df.where(condition)
    out = df.groupBy(*[c.alias(n) for n, c in dimensions.items()]).agg(*[registry[n].alias(n) for n in names])
    return out.orderBy(*order).limit(limit) if limit is not None else out
