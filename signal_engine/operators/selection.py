"""Choosing what goes on: drafts to send, candidates to keep, counts of what was left out, and scores of programs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signal_engine.functions import text as tx
from signal_engine.operators.signals import null_sum


def draftable(segment: Column, override: Column, allow_reviewed: bool = False) -> Column:
    """Strong paths, and with allow_reviewed those under review whose override says true."""
    seg = F.trim(tx.text(segment))
    reviewed = (seg == "review_warm_intro") & (F.lower(F.trim(tx.text(override))) == "true")
    return (seg == "strong_warm_intro") | (reviewed & F.lit(allow_reviewed))


def sendable(body: Column, approved: Column, require_approved: bool = True) -> Column:
    """Drafts with a body, and if asked for with an approval."""
    said = F.trim(F.regexp_replace(tx.text(body), r"\s+", " ")) != ""
    return said & (F.lower(F.trim(tx.text(approved))) == "true") if require_approved else said


def _entity(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(tx.strip_accents(tx.text(c))), r"[^a-z0-9]+", " "))


def matches_entity(entity: Column, *texts: Column) -> Column:
    """Whether the texts together hold the entity's name (two characters at least), both normalised."""
    name = _entity(entity)
    return (F.length(name) >= 2) & F.contains(_entity(F.concat_ws(" ", *[tx.text(t) for t in texts])), name)


def official_domain(url: Column, entity: Column, excluded: Sequence[str], allowed: Sequence[str] = ()) -> Column:
    """Whether a url can be the entity's own site: on no third party's domain, and on an allowed domain or with the
    entity's name (three characters at least, without spaces) as its label."""
    host = tx.normalize_domain(url)
    within = lambda domains: F.coalesce(F.exists(F.array(*[F.lit(d) for d in domains]), lambda d: (host == d) | F.endswith(host, F.concat(F.lit("."), d))), F.lit(False)) if domains else F.lit(False)
    key = F.replace(_entity(entity), F.lit(" "), F.lit(""))
    return F.coalesce(host != "", F.lit(False)) & ~within(excluded) & (within(allowed) | ((F.length(key) >= 3) & F.coalesce(tx.registrable_label(url) == key, F.lit(False))))


def reject_only(candidates: DataFrame, retained: DataFrame, key: str) -> DataFrame:
    """Candidates whose id a judge retained. A judge may only remove: an id that no candidate has, and candidates of
    equal id, fail the query. Retained ids that repeat count once; a null id is never retained."""
    held = retained.where(F.col(key).isNotNull()).groupBy(key).agg(F.lit(True).alias("_kept"))
    one = candidates.withColumn("_n", F.count("*").over(Window.partitionBy(key))).withColumn("_known", F.lit(True))
    both = one.join(held, key, "full_outer")
    wrong = F.when(F.col("_known").isNull(), F.concat(F.lit("unknown id: "), F.col(key).cast("string"))).when(F.col(key).isNotNull() & (F.col("_n") > 1), F.concat(F.lit("repeated id: "), F.col(key).cast("string")))
    return both.where(F.when(wrong.isNotNull(), F.raise_error(wrong).cast("boolean")).otherwise(F.coalesce("_kept", F.lit(False)))).select(*candidates.columns)


def exclusion_counts(df: DataFrame, reasons: Column) -> DataFrame:
    """(reason, rows) over arrays of reasons; a row counts once for each of its reasons."""
    return df.select(F.explode(F.array_distinct(reasons)).alias("reason")).where("reason <> ''").groupBy("reason").agg(F.count("*").alias("rows"))


def counts_with_zeros(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """(value, rows) for each named value, those without a row too; other values are not listed."""
    named = df.sparkSession.createDataFrame([(v,) for v in values], "value string")
    found = df.where(F.col(column).isin(*values)).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("rows"))
    return named.join(found, "value", "left").fillna(0, ["rows"])


def program_scorecard(attempts: DataFrame, results: DataFrame) -> DataFrame:
    """Per program, from attempts (program, calls, credits, error) and results (program, unit, complete, claims):
    attempts, failures, complete results, units with one, verified claims, and calls and credits for each claim. Credits
    are unknown if one attempt's are; a figure for each claim is null without claims."""
    tried = attempts.groupBy("program").agg(F.count("*").alias("attempts"), F.count("error").alias("failures"), F.sum("calls").alias("calls"), null_sum(F.col("credits")).alias("credits"), F.count_if(F.col("credits").isNull()).alias("unobserved"))
    by_unit = results.groupBy("program", "unit").agg(F.count_if("complete").alias("c"), F.sum("claims").alias("v"))
    got = by_unit.groupBy("program").agg(F.sum("c").alias("complete_results"), F.count_if(F.col("c") > 0).alias("complete_units"), F.sum("v").alias("verified_claims"))
    both = tried.join(got, "program", "left").fillna(0, ["complete_results", "complete_units", "verified_claims"])
    claims = F.when(F.col("verified_claims") > 0, F.col("verified_claims"))
    return both.withColumn("calls_per_claim", F.col("calls") / claims).withColumn("credits_per_claim", F.col("credits") / claims)


def known_identities(contacts: DataFrame, account: str) -> DataFrame:
    """Per account the identifiers that need no new search, each sorted: (account, linkedin_urls, emails, identities)
    of contacts (linkedin, email, name, company, title). An account without any fails the query."""
    whole = F.least(*[F.length(F.trim(tx.text(F.col(c)))) for c in ("name", "company", "title")]) > 0
    parts = {
        "linkedin_urls": F.when(tx.text(F.col("linkedin")) != "", tx.normalize_linkedin_url(F.col("linkedin"))),
        "emails": F.when(tx.text(F.col("email")) != "", tx.normalize_email(F.col("email"))),
        "identities": F.when(whole, tx.normalized_identity(F.col("name"), F.col("company"), F.col("title"))),
    }
    out = contacts.groupBy(account).agg(*[F.array_sort(F.collect_set(c)).alias(n) for n, c in parts.items()])
    none = F.size("linkedin_urls") + F.size("emails") + F.size("identities") == 0
    return out.where(F.when(none, F.raise_error(F.concat(F.lit("no identities: "), F.col(account).cast("string"))).cast("boolean")).otherwise(True))


def fit_tier(offering: Column, buyer: Column, claims: Column) -> Column:
    """high: offering and buyer verified and the claims name a direct use; medium: they name automation or data; low."""
    said = F.lower(tx.text(claims))
    verified = offering & buyer
    # Fixed values.
    direct = said.rlike(r"\b(sales|revenue|customer|crm|marketing|questionnaire)\b")
    complex_ = said.rlike(r"\b(ai|automation|platform|monitor|security|compliance|cloud|finance|data|risk)\b")
    return F.when(verified & direct, "high").when(verified & complex_, "medium").otherwise("low")


def research_status(*verified: Column) -> Column:
    return F.when(F.array_min(F.array(*[F.coalesce(v, F.lit(False)).cast("int") for v in verified])) == 1, "complete").otherwise("insufficient_evidence")


def net_transitions(transitions: DataFrame, written: DataFrame, key: str, *order: str | Column) -> DataFrame:
    """Transitions whose idempotency key was not written yet, the first of each key."""
    from signal_engine.operators.sets import net_new

    return net_new(transitions.where(F.col(key).isNotNull()), written, key, *order)


#: Reasons of a path by precedence, with the signal that each stands for.
PATH_SIGNALS = {
    "company_proximity": "company_proximity", "shared_school": "school_city_community", "shared_city": "school_city_community", "shared_community": "school_city_community",
    "shared_appearance": "school_city_community", "role_proximity": "role_industry", "industry_proximity": "role_industry", "investor_overlap": "investor_overlap",
}


def path_signal(direct: Column, evidence: Column, reasons: Column) -> Column:
    """(signal, detail) of a path: a direct introduction with its evidence ids, then dated work overlap with company
    and years, then the first kind of reason (``kind:detail``) in the order of PATH_SIGNALS; both empty without one."""
    of = lambda kind: F.transform(F.filter(reasons, lambda r: r.startswith(f"{kind}:")), lambda r: F.substr(r, F.lit(len(kind) + 2)))
    pair = lambda signal, detail: F.struct(F.lit(signal).alias("signal"), detail.alias("detail"))
    work = F.try_element_at(F.transform(of("dated_work_overlap"), lambda d: F.split(d, ":", 3)), F.lit(1))
    rules = [F.when(direct, pair("direct_introduction", F.array_join(evidence, ";"))), F.when(work.isNotNull(), pair("verified_work_overlap", F.concat(F.get(work, F.lit(0)), F.lit(", "), F.get(work, F.lit(1)), F.lit(" to "), F.get(work, F.lit(2)))))]
    rules += [F.when(F.size(of(kind)) > 0, pair(signal, F.array_join(of(kind), "; "))) for kind, signal in PATH_SIGNALS.items()]
    return F.coalesce(*rules, pair("", F.lit("")))
