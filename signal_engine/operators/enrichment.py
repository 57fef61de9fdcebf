"""Enrichment runtime over pre-materialised provider responses: waterfalls, receipts, gates and ledgers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signal_engine.operators.ordered import fold_in_order


def waterfall(df: DataFrame, legs: Mapping[str, Column], column: str) -> DataFrame:
    """The first leg with a value wins; ``{column}_source`` names it. Legs are columns, so none is computed twice."""
    value = F.coalesce(*legs.values())
    source = F.coalesce(*[F.when(v.isNotNull(), F.lit(name)) for name, v in legs.items()])
    return df.withColumn(column, value).withColumn(f"{column}_source", source)


def attach_responses(df: DataFrame, responses: DataFrame, key: str, tools: Sequence[str]) -> DataFrame:
    """One column per tool from responses (tool, key, value, status): only valid values, the smallest on ties."""
    wide = responses.where(F.col("status") == "valid").groupBy(key).agg(*[F.min(F.when(F.col("tool") == t, F.col("value"))).alias(t) for t in tools])
    return df.join(wide, key, "left")


def layer_stats(df: DataFrame, source: str, layers: Sequence[str]) -> DataFrame:
    """Per layer in order: attempted (not found earlier), hits, skipped."""
    n, hits = F.count("*").alias("n"), [F.count_if(F.col(source) == x).alias(f"h{i}") for i, x in enumerate(layers)]
    before = lambda i: sum((F.col(f"h{j}") for j in range(i)), F.lit(0))
    rows = [F.struct(F.lit(x).alias("layer"), (F.col("n") - before(i)).alias("attempted"), F.col(f"h{i}").alias("hits"), before(i).cast("long").alias("skipped")) for i, x in enumerate(layers)]
    return df.agg(n, *hits).select(F.inline(F.array(*rows)))


def call_key(tool: Column, payload: Column) -> Column:
    """Content address of a call: tool and canonical input."""
    return F.sha2(F.concat_ws("|", tool, F.coalesce(F.to_json(F.try_parse_json(payload)), payload)), 256)


def replay(calls: DataFrame, receipts: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(answered, to_run): a receipt answers unless stale (stale_after 0: always, null: never)."""
    joined = calls.join(receipts.select("call_key", "response", "made_at", "stale_after"), "call_key", "left")
    fresh = F.col("made_at").isNotNull() & (F.col("stale_after").isNull() | ((F.col("stale_after") > 0) & (F.unix_seconds(now) - F.unix_seconds("made_at") < F.col("stale_after"))))
    return joined.where(fresh), joined.where(~F.coalesce(fresh, F.lit(False))).drop("response", "made_at", "stale_after")


def hash_audience(df: DataFrame, email: str, hashed: str) -> DataFrame:
    """Distinct valid SHA-256 hashes of raw addresses and of hashes already given."""
    from signal_engine.functions import text as tx

    raw = F.sha2(tx.normalize_email(F.col(email)), 256)
    given = F.when(tx.is_sha256(F.lower(F.trim(F.col(hashed)))), F.lower(F.trim(F.col(hashed))))
    return df.select(F.explode(F.array_compact(F.array(raw, given))).alias("hash")).distinct()


def route(identifiers: Sequence[tuple[str, Column]]) -> Column:
    """The first route whose identifier is present."""
    return F.coalesce(*[F.when(c.isNotNull() & (c != ""), F.lit(name)) for name, c in identifiers], F.lit("none"))


def accepted(status: Column, catch_all: bool = False) -> Column:
    return status.isin("valid", "valid_catch_all", *(["catch_all"] if catch_all else []))


def authorize(requests: DataFrame, campaign_cap: float, provider_caps: Mapping[str, float], campaign: str = "campaign") -> DataFrame:
    """Authorise requests (campaign, seq, provider, credits, cached) in order: a cached one costs nothing; else the
    provider's cap, then the campaign's must hold. (campaign, seq, decision). A provider without cap is
    unbounded; unknown credits count as 0."""
    caps = {p: float(c) for p, c in provider_caps.items()}

    def decide(spent: dict, row: dict) -> tuple[dict, str]:
        provider, credits = row["provider"], row["credits"] or 0.0
        if row["cached"]:
            return spent, "cache_hit"
        if provider in caps and spent.get(provider, 0.0) + credits > caps[provider]:
            return spent, "provider_cap"
        if spent.get(None, 0.0) + credits > campaign_cap:
            return spent, "campaign_cap"
        # None holds the campaign's total
        for at in (None, provider) if provider in caps else (None,):
            spent[at] = spent.get(at, 0.0) + credits
        return spent, "authorized"

    rows = requests.select(campaign, F.col("seq").cast("bigint").alias("seq"), "provider", F.col("credits").cast("double").alias("credits"), "cached")
    return fold_in_order(rows, campaign, ["seq", "provider", "credits", "cached"], dict, decide, "decision", "string", [campaign, "seq"])


def outbox_state(events: DataFrame, now: Column, ttl: int = 3600) -> DataFrame:
    """(key, state) of an append-only event log (key, at, event): the last event decides; a dispatch older than the
    ttl needs reconciliation."""
    last = events.groupBy("key").agg(F.max_by(F.struct("event", "at"), F.struct("at", "event")).alias("l"))
    stale = F.unix_seconds(now) - F.unix_seconds(F.col("l.at").cast("timestamp")) > ttl
    return last.select("key", F.when((F.col("l.event") == "dispatching") & stale, "needs_reconciliation").otherwise(F.col("l.event")).alias("state"))


def forbidden_transitions(events: DataFrame, allowed: Sequence[tuple[str, str]], key: str, order: Sequence[str], state: str) -> DataFrame:
    """Consecutive states of a key that are no allowed transition."""
    w = Window.partitionBy(key).orderBy(*order)
    step = F.concat_ws(">", F.lag(state).over(w), F.col(state))
    return events.withColumn("step", F.when(F.lag(state).over(w).isNotNull(), step)).where(F.col("step").isNotNull() & ~F.col("step").isin(*[f"{a}>{b}" for a, b in allowed]))


def listener(predicates: Mapping[str, Mapping[str, object]]) -> Column:
    """Compile {column: {op: value}} (eq, neq, in, notIn, isNull, isNotNull, ilike) to one condition."""
    ops = {
        "eq": lambda c, v: c == v, "neq": lambda c, v: c != v, "in": lambda c, v: c.isin(*v), "notIn": lambda c, v: ~c.isin(*v),
        "isNull": lambda c, v: c.isNull() if v else c.isNotNull(), "isNotNull": lambda c, v: c.isNotNull() if v else c.isNull(), "ilike": lambda c, v: c.ilike(v),
    }
    out = F.lit(True)
    for column, tests in predicates.items():
        for op, value in tests.items():
            out = out & ops[op](F.col(column), value)
    return out


def query_variants(topics: DataFrame, rules: DataFrame) -> DataFrame:
    """Per-source query strings of every topic: rules (type, source, prefix, suffix) by the topic's class."""
    from signal_engine.functions import text as tx

    typed = topics.withColumn("type", tx.query_type(F.col("topic"))).withColumn("subject", tx.core_subject(F.col("topic")))
    return typed.join(rules, "type").select("topic", "source", F.trim(F.concat_ws(" ", "prefix", "subject", "suffix")).alias("query"))


def common_evidence(frames: Mapping[str, tuple[DataFrame, Mapping[str, str]]]) -> DataFrame:
    """Providers' rows in one shape (source, url, title, body), once per canonical url, in source order."""
    from signal_engine.functions import text as tx
    from signal_engine.operators.sets import union_first

    shaped = [df.select(F.lit(s).alias("source"), *[F.col(m[c]).cast("string").alias(c) if c in m else F.lit(None).cast("string").alias(c) for c in ("url", "title", "body")]).withColumn("key", tx.canonical_url(F.col("url"))) for s, (df, m) in frames.items()]
    return union_first(shaped, "key", "url")
