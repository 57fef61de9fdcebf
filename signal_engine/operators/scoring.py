"""Scores and decisions: accounts, warm paths, contact audits, claims and golden records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signal_engine.functions import text as tx


def component(v: Column, path: str, most: int) -> Column:
    """Points of a VARIANT signal: a boolean gives all or none, an integer is clamped, anything else is 0."""
    kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    number = F.try_variant_get(v, path, "bigint")
    return F.when(kind == "BOOLEAN", F.when(F.try_variant_get(v, path, "boolean"), most).otherwise(0)).when(kind == "BIGINT", F.least(F.lit(most), F.greatest(F.lit(0), number))).otherwise(0).cast("long")


def decision(score: Column, excluded: Column, include: int, review: int) -> Column:
    return F.when(excluded.isNotNull() & (excluded != ""), "exclude").when(score >= include, "include").when(score >= review, "review").otherwise("exclude")


def exclusion_reason(df: DataFrame, domain: str, lists: DataFrame) -> DataFrame:
    """The reason of the highest-precedence list that holds the domain. lists: (domain, reason, precedence)."""
    best = lists.groupBy(F.col("domain").alias(domain)).agg(F.min_by("reason", "precedence").alias("exclusion_reason"))
    return df.join(best, domain, "left")


# Fixed values.
PATH_WEIGHTS = {"direct_intro": 60, "work_overlap": 30, "school_city_community": 15, "role_industry": 7, "investor": 3, "relationship": 3}


def check_path_weights(weights: Mapping[str, int]) -> None:
    """Every factual tier must outweigh all lower tiers together."""
    if min(weights.values()) < 0 or weights["investor"] > 3:
        raise ValueError("weights must not be negative, and investor is at most 3")
    tiers = list(PATH_WEIGHTS)[:-1]
    for i, tier in enumerate(tiers[:-1]):
        lower = sum(weights[t] for t in tiers[i + 1 :]) + min(weights["relationship"], 3)
        if weights[tier] <= lower:
            raise ValueError(f"{tier} must exceed {lower}")


def path_score(weights: Mapping[str, int] = PATH_WEIGHTS) -> Column:
    """Sum of the tiers whose boolean column holds, and the capped relationship strength (low, medium, high)."""
    check_path_weights(weights)
    strength = F.coalesce(F.create_map(*[F.lit(x) for kv in {"low": 1, "medium": 2, "high": 3, "confirmed": 3}.items() for x in kv])[F.lower(F.trim("relationship"))], F.lit(0))
    tiers = sum((F.when(F.col(t), w).otherwise(0) for t, w in weights.items() if t != "relationship"), F.lit(0))
    return tiers + F.least(strength, F.lit(weights["relationship"]))


def path_segment(total: Column, strong: int, review: int) -> Column:
    """strong_warm_intro, review_warm_intro or no_strong_path, from the tier columns, reasons and errors."""
    factual = F.col("direct_intro") | F.col("work_overlap")
    related = F.lower(F.trim("relationship")).isin("low", "medium", "high", "confirmed")
    clean = F.size("errors") == 0
    proximity = F.exists("reasons", lambda r: r.startswith("company_proximity:"))
    ancillary = F.col("school_city_community") | F.col("role_industry")
    return F.when(clean & (total >= strong) & related & factual, "strong_warm_intro").when(~clean | factual | proximity | (ancillary & (total >= review)), "review_warm_intro").otherwise("no_strong_path")


def contact_priority(level: Column, email: Column, phone: Column, warm: Column, tenure_days: Column, champion: Column) -> Column:
    title = F.when(level == "exec", 40).when(level == "director", 25).when(level == "manager", 10).otherwise(0)
    recent = F.when((level == "exec") & (tenure_days < 90), 20).otherwise(0) + F.when(tenure_days < 30, 10).otherwise(0)
    bonus = F.when(champion >= 45, 15).when(champion >= 30, 8).otherwise(0)
    unsettled = F.when(level.isin("manager", "director") & (tenure_days < 180), -5).otherwise(0)
    return title + F.when(email, 25).otherwise(0) + F.when(phone, 10).otherwise(0) + F.when(warm, 30).otherwise(0) + recent + bonus + unsettled


def champion_band(score: Column) -> Column:
    return F.when(score >= 45, "high").when(score >= 30, "medium").when(score >= 15, "low").otherwise("unknown")


def icp_band(score: Column, high: int = 60, middle: int = 35) -> Column:
    return F.when(score >= high, "high").when(score >= middle, "medium").otherwise("low")


# Fixed values.
VERIFY_FLAGS = (
    "invalid_email_format", "invalid_linkedin_url", "title_equals_company", "profile_stale", "profile_freshness_missing", "email_verification_stale",
    "email_verification_missing", "identity_unconfirmed", "email_invalid", "email_validation_unknown", "missing_email",
)


def audit_contacts(df: DataFrame, as_of: Column) -> DataFrame:
    """Accuracy flags, e-mail risk and action per contact. Columns used: person, email, company, current_company,
    title, domain, linkedin, profile_at, verified_at, identity, validation, corroboration, confidence; and, where it is
    there, allowed_email_domains, further domains of the account (split at commas, semicolons and blanks)."""
    norm = lambda c: F.lower(tx.squeeze(tx.text(F.col(c))))
    email, changed = F.trim(tx.text(F.col("email"))), (norm("current_company") != "") & (norm("company") != "") & (norm("current_company") != norm("company"))
    mail_domain, domain = tx.email_domain(F.col("email")), F.lower(tx.text(F.col("domain")))
    bad_format = ~email.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$")
    allowed = F.filter(F.array(domain), lambda d: d != "")
    if "allowed_email_domains" in df.columns:
        more = F.transform(F.split(F.lower(tx.text(F.col("allowed_email_domains"))), r"[,; ]+"), lambda d: F.regexp_replace(d, r"^(?:https?://)?(?:www\.)?|/.*$", ""))
        allowed = F.concat(allowed, F.filter(more, lambda d: d != ""))
    wrong_domain = F.when(changed & (domain != "") & (mail_domain == domain), True).otherwise((F.size(allowed) > 0) & ~F.array_contains(allowed, mail_domain))
    profile_age, email_age = F.datediff(as_of, "profile_at"), F.datediff(as_of, "verified_at")
    validation = F.lower(F.trim(tx.text(F.col("validation"))))
    catch_all = validation.contains("catch-all") | validation.contains("catch_all")
    invalid = validation.contains("invalid") | validation.contains("do_not_mail")
    unknown = validation.contains("unknown") | validation.contains("no-status") | (validation == "")
    corroborated = F.coalesce("corroboration", F.lit(0)) >= 2
    flag = lambda c, name: F.when(c, F.lit(name))
    flags = [
        flag(changed, "job_changed"), flag(email == "", "missing_email"), flag((email != "") & bad_format, "invalid_email_format"),
        flag((email != "") & ~bad_format & wrong_domain, "email_domain_mismatch"), flag((tx.text(F.col("linkedin")) != "") & tx.normalize_linkedin_url(F.col("linkedin")).isNull(), "invalid_linkedin_url"),
        flag((norm("title") != "") & ((norm("title") == norm("company")) | (norm("title") == norm("current_company"))), "title_equals_company"),
        flag(profile_age.isNull(), "profile_freshness_missing"), flag(profile_age > 30, "profile_stale"), flag(email_age.isNull(), "email_verification_missing"),
        flag(email_age > 30, "email_verification_stale"), flag(F.upper(F.trim(tx.text(F.col("identity")))).isin("", "NONE"), "identity_unconfirmed"),
        flag(catch_all & ~corroborated, "catch_all_not_corroborated"), flag(~catch_all & invalid, "email_invalid"), flag(~catch_all & ~invalid & unknown, "email_validation_unknown"),
    ]
    w = Window.partitionBy("person")
    differs = lambda c: F.coalesce(F.min(norm(c)).over(w) != F.max(norm(c)).over(w), F.lit(False))
    conflict = F.when(F.col("person").isNotNull() & (differs("email") | differs("title") | differs("current_company")), F.lit("duplicate_person_conflict"))
    out = df.withColumn("flags", F.array_sort(F.array_compact(F.array(*flags, conflict))))
    out = out.withColumn("email_risk", F.when(catch_all, F.when(corroborated, "MED").otherwise("HIGH")).when(invalid, "HIGH").when(unknown, "MED").otherwise("LOW"))
    has = lambda f: F.array_contains("flags", f)
    action = (
        F.when(has("job_changed"), "REMOVE / RE-TARGET").when(has("duplicate_person_conflict") | has("catch_all_not_corroborated"), "REVIEW")
        .when(F.arrays_overlap("flags", F.array(*[F.lit(f) for f in VERIFY_FLAGS])), "VERIFY").when(F.upper(F.trim(tx.text(F.col("confidence")))).isin("LOW", "HOLD"), "VERIFY")
        .when(F.col("email_risk") == "HIGH", "REVIEW").otherwise("SEND")
    )
    return out.withColumn("action", action)


def golden_record(fields: Mapping[str, Sequence[str]]) -> list[Column]:
    """Per field the first non-blank source in precedence, and whether sources disagree."""
    out = []
    for name, sources in fields.items():
        values = F.filter(F.array(*[F.lower(F.trim(tx.text(F.col(s)))) for s in sources]), lambda v: v != "")
        out += [tx.first_of(*[F.col(s) for s in sources]).alias(name), (F.size(F.array_distinct(values)) > 1).alias(f"{name}_disagree")]
    return out


def source_confidence(df: DataFrame, key: str, source: str, value: str) -> DataFrame:
    """HIGH from two sources, MEDIUM from one, LOW when values conflict."""
    return df.groupBy(key).agg(F.when(F.count_distinct(value) > 1, "LOW").when(F.count_distinct(source) >= 2, "HIGH").otherwise("MEDIUM").alias("confidence"))


def fact_gates(facts: DataFrame, required: Sequence[str], allowed: Mapping[str, Sequence[str]]) -> DataFrame:
    """(item, status, reasons) from facts (item, field, value): conflict on several values, rejected on a missing
    or disallowed one, else eligible."""
    per = facts.groupBy("item", "field").agg(F.count_distinct("value").alias("n"), F.min("value").alias("value"))
    each = [F.array_compact(F.collect_list(F.when((F.col("field") == f) & ~F.col("value").isin(*vs), F.lit(f"not_allowed:{f}")))) for f, vs in allowed.items()]
    found = per.groupBy("item").agg(F.collect_set("field").alias("fields"), F.collect_list(F.when(F.col("n") > 1, F.concat(F.lit("conflict:"), "field"))).alias("conflicts"), F.concat(*each, F.array().cast("array<string>")).alias("denied"))
    missing = F.transform(F.array_except(F.array(*[F.lit(f) for f in required]), "fields"), lambda f: F.concat(F.lit("missing:"), f))
    reasons = F.array_sort(F.concat("conflicts", "denied", missing))
    return found.select("item", F.when(F.size("conflicts") > 0, "conflict").when(F.size(reasons) > 0, "rejected").otherwise("eligible").alias("status"), reasons.alias("reasons"))


def claim_status(evidence: DataFrame, as_of: Column, least: int = 2, independent: int = 2, max_age: int = 365) -> DataFrame:
    """(claim, status, reason) from evidence (claim, value, source, observed): the first failing test names it."""
    per = evidence.groupBy("claim").agg(F.count("value").alias("n"), F.count_distinct("value").alias("values"), F.count_distinct(F.when(F.col("value").isNotNull(), F.col("source"))).alias("sources"), F.max("observed").alias("last"))
    reason = F.when(F.col("n") == 0, "no_evidence").when(F.col("values") > 1, "contradiction").when(F.col("n") < least, "too_little_evidence").when(F.col("sources") < independent, "not_independent").when(F.datediff(as_of, "last") > max_age, "too_old").otherwise("")
    return per.select("claim", F.when(reason == "", "verified").otherwise("abstained").alias("status"), reason.alias("reason"))


def gap_merge(primary: DataFrame, extra: DataFrame) -> DataFrame:
    """Extra claims fill only unresolved ones; credits add up, unknown if either is. (row, claim, value, verified, credits)."""
    p, e = primary.alias("p"), extra.alias("e")
    both = p.join(e, ["row", "claim"], "full_outer")
    keep = F.coalesce(F.col("p.verified"), F.lit(False))
    credits = F.when(F.col("e.claim").isNull() & F.col("e.credits").isNull() & F.col("e.verified").isNull(), F.col("p.credits")).otherwise(F.col("p.credits") + F.col("e.credits"))
    fill = F.coalesce(F.col("e.verified"), F.lit(False))
    return both.select("row", "claim", F.when(keep, F.col("p.value")).when(fill, F.col("e.value")).otherwise(F.col("p.value")).alias("value"), (keep | fill).alias("verified"), credits.alias("credits"))


def ledger_merge(claims: DataFrame) -> DataFrame:
    """(identity, claim, value, evidence, contradiction): equal values grouped, most evidence wins, then the smaller."""
    per = claims.groupBy("identity", "claim", "value").agg(F.count("*").alias("evidence"))
    return per.groupBy("identity", "claim").agg(F.min_by("value", F.struct(-F.col("evidence"), F.col("value"))).alias("value"), F.max("evidence").alias("evidence"), (F.count("*") > 1).alias("contradiction"))
