"""Explicit evidence between a connector and a target: scores, segment, the signal that is named first, and evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signal_engine.functions import text as tx

# Fixed values.
DIRECT_INTRO, WORK_OVERLAP, COMMUNITY, ROLE_INDUSTRY, MOST_INVESTOR = 160.0, 80.0, 40.0, 20.0, 3
RELATIONSHIP = {"low": 5.0, "medium": 10.0, "high": 15.0, "confirmed": 15.0}
COMMUNITY_KINDS = ("school", "city", "community", "appearance")


def _roles(roles: DataFrame, p: str) -> DataFrame:
    identity = tx.employer_identity(F.col("company"))
    return roles.select(F.col("person").alias("connector" if p == "c" else "target"), *[F.col(n).alias(f"{p}_{n}") for n in ("role_id", "company", "start", "end", "is_current")], identity.alias(f"{p}_key"), F.split(tx.normalize_company(F.col("company")), " ").alias(f"{p}_words"))


def target_connectors(pairs: DataFrame, roles: DataFrame, signals: DataFrame, as_of: Column) -> DataFrame:
    """One row for each pair (connector, target, confidence).

    roles: (person, role_id, company, start, end, is_current); signals: (connector, target, kind, value) with the kinds
    direct_intro and evidence (values are evidence ids), school, city, community, appearance, role_industry, investor.
    Work overlaps need equal employers and dated roles (an open end counts as as_of where is_current); companies where
    one name's words hold the other's are proximity only. A pair is strong with a direct introduction or an overlap
    and a known relationship, to review with any other signal but investors alone, else without a path. Roles meet
    within a pair only."""
    near = pairs.select("connector", "target").join(_roles(roles, "c"), "connector").join(_roles(roles, "t"), "target")
    words = lambda a, b: F.size(F.array_except(a, b)) == 0
    alike = (F.col("c_key") != "") & (F.col("t_key") != "") & (words("c_words", "t_words") | words("t_words", "c_words"))
    end = lambda p: F.coalesce(F.col(f"{p}_end"), F.when(F.col(f"{p}_is_current"), as_of))
    start = F.greatest("c_start", "t_start")
    stop = F.least(end("c"), end("t"), as_of)
    dated = F.col("c_start").isNotNull() & F.col("t_start").isNotNull() & end("c").isNotNull() & end("t").isNotNull()
    overlap = (F.col("c_key") == F.col("t_key")) & dated & (start <= stop)
    spell = F.struct(start.alias("start"), stop.alias("stop"), F.array_join("c_words", " ").alias("key"), F.col("c_company").alias("company"), F.col("c_role_id").alias("c"), F.col("t_role_id").alias("t"))
    companies = near.where(alike).groupBy("connector", "target").agg(F.array_sort(F.collect_list(F.when(overlap, spell))).alias("overlaps"), F.array_sort(F.collect_set(F.struct(F.lower("c_company").alias("low"), F.col("c_company").alias("company")))).alias("companies"))

    per_kind = signals.where("value IS NOT NULL").groupBy("connector", "target").agg(*[F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.col("value")))).alias(k) for k in ("direct_intro", "evidence", *COMMUNITY_KINDS, "role_industry", "investor")])
    rows = pairs.join(companies, ["connector", "target"], "left").join(per_kind, ["connector", "target"], "left")
    none = F.array().cast("array<string>")
    value = {k: F.coalesce(k, none) for k in ("direct_intro", "evidence", *COMMUNITY_KINDS, "role_industry", "investor")}
    overlaps = F.coalesce("overlaps", F.array().cast("array<struct<start:date,stop:date,key:string,company:string,c:string,t:string>>"))
    shared = F.transform(F.coalesce("companies", F.array().cast("array<struct<low:string,company:string>>")), lambda x: x["company"])
    community = F.array_distinct(F.concat(*[value[k] for k in COMMUNITY_KINDS]))
    confidence = F.coalesce(F.nullif(F.lower(F.trim("confidence")), F.lit("")), F.lit("unknown"))
    rated = F.create_map(*[F.lit(x) for kv in RELATIONSHIP.items() for x in kv])
    score = lambda has, points: F.when(has, F.lit(points)).otherwise(0.0)
    some = lambda c: F.size(c) > 0
    rows = rows.withColumns({
        "relationship_confidence": confidence,
        "direct_intro_score": score(some(value["direct_intro"]), DIRECT_INTRO),
        "work_overlap_score": score(some(overlaps), WORK_OVERLAP),
        "relationship_score": F.coalesce(F.try_element_at(rated, confidence), F.lit(0.0)),
        "school_city_community_score": score(some(community), COMMUNITY),
        "role_industry_score": score(some(value["role_industry"]), ROLE_INDUSTRY),
        "investor_score": F.least(F.size(value["investor"]), F.lit(MOST_INVESTOR)).cast("double"),
    })
    first = F.get(overlaps, F.lit(0))
    choices = (
        (some(value["direct_intro"]), "direct_introduction", F.array_join(value["direct_intro"], "; ")),
        (some(overlaps), "verified_work_overlap", F.concat(first["company"], F.lit(", "), first["start"].cast("string"), F.lit(" to "), first["stop"].cast("string"))),
        (some(shared), "company_proximity", F.concat(F.get(shared, F.lit(0)), F.lit("; employment dates unavailable or non-overlapping"))),
        (some(community), "school_city_community", F.array_join(community, "; ")),
        (some(value["role_industry"]), "role_industry", F.array_join(value["role_industry"], "; ")),
        (some(value["investor"]), "investor_overlap", F.array_join(value["investor"], "; ")),
    )
    signal = detail = F.lit("")
    for has, name, told in reversed(choices):
        signal, detail = F.when(has, name).otherwise(signal), F.when(has, told).otherwise(detail)
    strong = (F.col("direct_intro_score") + F.col("work_overlap_score") > 0) & (F.col("relationship_score") > 0)
    segment = F.when(strong, "strong_warm_intro").when(~signal.isin("", "investor_overlap"), "review_warm_intro").otherwise("no_strong_path")
    ids = F.array_sort(F.array_distinct(F.concat(value["direct_intro"], value["evidence"], F.transform(overlaps, lambda o: o["c"]), F.transform(overlaps, lambda o: o["t"]))))
    scores = ["direct_intro_score", "work_overlap_score", "relationship_score", "school_city_community_score", "role_industry_score", "investor_score"]
    total = sum((F.col(c) for c in scores[1:]), F.col(scores[0]))
    return rows.select("connector", "target", "relationship_confidence", *scores, total.alias("score"), signal.alias("shared_signal"), detail.alias("shared_detail"), segment.alias("segment"), shared.alias("shared_companies"), ids.alias("evidence_ids"))


def latest_role(roles: DataFrame, person: str, start: Column, active: Column, order: str) -> DataFrame:
    """Each person's active role that started last; of several the first in order."""
    return roles.where(active).groupBy(person).agg(F.min_by(F.struct(*roles.columns), F.struct(F.when(start.isNull(), 1).otherwise(0), -F.coalesce(F.unix_date(start), F.lit(0)), F.col(order))).alias("r")).select("r.*")


def last_wins(df: DataFrame, facts: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """Left lookup of fields by key, where the last of several fact rows in order counts, with its nulls."""
    last = facts.groupBy(key).agg(F.max_by(F.struct(*fields), F.col(order)).alias("f")).select(key, "f.*")
    return df.join(last, key, "left")


def affiliated(contacts: DataFrame, affiliations: DataFrame, id_col: str, entity: str) -> DataFrame:
    """Contacts with an affiliation (contact_id, entity_name) whose name holds a text in either case, once each; % and
    _ in the text are ordinary."""
    held = affiliations.where(F.contains(F.lower("entity_name"), F.lit(entity.lower()))).select(F.col("contact_id").alias(id_col)).distinct()
    return contacts.join(held, id_col, "left_semi")
