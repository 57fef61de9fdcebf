"""A target-account campaign as one chain of table operators, and the scorers that stand around it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signal_engine.functions import text as tx
from signal_engine.operators import entity, joins, ranking, scoring


#: First names and their short forms.
NICKNAMES = {
    "mike": ("michael",), "michael": ("mike",),
    "bob": ("robert", "rob"), "robert": ("bob", "rob"), "rob": ("robert", "bob"),
    "bill": ("william", "will"), "william": ("bill", "will"), "will": ("william", "bill"),
    "liz": ("elizabeth", "beth"), "elizabeth": ("liz", "beth"), "beth": ("elizabeth", "liz"),
    "jim": ("james", "jimmy"), "james": ("jim", "jimmy"), "jimmy": ("james", "jim"),
    "joe": ("joseph",), "joseph": ("joe",),
    "dan": ("daniel", "danny"), "daniel": ("dan", "danny"), "danny": ("daniel", "dan"),
    "dave": ("david",), "david": ("dave",),
    "chris": ("christopher",), "christopher": ("chris",),
    "matt": ("matthew",), "matthew": ("matt",),
    "tom": ("thomas",), "thomas": ("tom",),
    "tony": ("anthony",), "anthony": ("tony",),
    "nick": ("nicholas", "nico"), "nicholas": ("nick", "nico"),
    "rick": ("richard",), "richard": ("rick", "dick"), "dick": ("richard",),
    "steve": ("steven", "stephen"), "steven": ("steve", "stephen"), "stephen": ("steve", "steven"),
    "andy": ("andrew", "drew"), "andrew": ("andy", "drew"), "drew": ("andrew", "andy"),
    "alex": ("alexander", "oleksandr", "aleksandr"), "alexander": ("alex", "oleksandr"), "oleksandr": ("alex", "alexander"),
    "sam": ("samuel", "samantha"), "samuel": ("sam",), "samantha": ("sam",),
    "ben": ("benjamin", "benny"), "benjamin": ("ben", "benny"),
    "jon": ("jonathan", "john"), "jonathan": ("jon", "john"), "john": ("jon", "jonathan"),
    "ed": ("edward", "ted"), "edward": ("ed", "ted"), "ted": ("edward", "theodore"), "theodore": ("ted",),
    "pat": ("patrick", "patricia"), "patrick": ("pat",), "patricia": ("pat",),
    "kate": ("katherine", "katie", "kathy"), "katherine": ("kate", "katie", "kathy"), "kat": ("katherine", "kate", "kathy"),
    "jen": ("jennifer", "jenny"), "jennifer": ("jen", "jenny"),
    "sara": ("sarah",), "sarah": ("sara",),
    "meg": ("megan",), "megan": ("meg",),
    "mandy": ("amanda",), "amanda": ("mandy",),
    "ron": ("ronald",), "ronald": ("ron",),
    "charlie": ("charles", "chuck"), "charles": ("charlie", "chuck"),
    "greg": ("gregory",), "gregory": ("greg",),
    "jeff": ("jeffrey",), "jeffrey": ("jeff",),
    "doug": ("douglas",), "douglas": ("doug",),
    "nate": ("nathan", "nathaniel"), "nathan": ("nate",), "nathaniel": ("nate",),
    "zach": ("zachary",), "zachary": ("zach",),
    "max": ("maxwell", "maximilian"), "maxwell": ("max",), "maximilian": ("max",),
}


def names_match(first: Column, last: Column, full: Column, nicknames: Mapping[str, Sequence[str]] = NICKNAMES) -> Column:
    """Whether a source's first and last name fit a profile's full name. First names: equal, one the beginning of the
    other (from three letters on), short forms, an initial, a part of several first names, or a short form in quotes
    in the profile. Last names: equal, a common part, or one contained in the other. Marks other than letters, spaces
    and hyphens do not count."""
    clean = lambda c: F.trim(F.regexp_replace(F.lower(tx.strip_accents(tx.text(c))), r"[^a-z\- ]", ""))
    shown = F.trim(F.regexp_replace(F.regexp_replace(tx.text(full), r"[^\p{L}\p{M}\p{N}_\s'-]", ""), r"\s+", " "))
    parts = F.split(shown, " ")
    pf, pl = clean(F.element_at(parts, 1)), clean(F.array_join(F.slice(parts, 2, 1000), " "))
    sf, sl = clean(first), clean(last)
    short = F.create_map(*[x for k, v in nicknames.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]) if nicknames else F.create_map().cast("map<string,array<string>>")
    forms = lambda c: F.concat(F.array(c), F.coalesce(F.try_element_at(short, c), F.array().cast("array<string>")))
    begins = lambda a, b: (F.length(a) >= 3) & (a.startswith(b) | b.startswith(a))
    initial = ((F.length(sf) == 1) & pf.startswith(sf)) | ((F.length(pf) == 1) & sf.startswith(pf))
    part = F.contains(sf, F.lit(" ")) & F.exists(F.split(sf, " +"), lambda p: (p == pf) | begins(p, pf) | F.arrays_overlap(forms(p), forms(pf)))
    quoted = clean(F.regexp_extract(shown, r"'([\p{L}\p{N}_]+)'", 1))
    in_quotes = (quoted != "") & (F.array_contains(forms(sf), quoted) | F.array_contains(forms(quoted), sf))
    first_ok = (sf != "") & (((pf != "") & ((sf == pf) | begins(sf, pf) | F.arrays_overlap(forms(sf), forms(pf)) | initial | part)) | in_quotes)
    words = lambda c: F.filter(F.split(F.regexp_replace(c, "-", " "), " +"), lambda w: w != "")
    last_ok = (sl != "") & (pl != "") & (F.arrays_overlap(words(sl), words(pl)) | sl.contains(pl) | pl.contains(sl))
    return (F.size(parts) >= 2) & first_ok & last_ok


CONNECTOR_WEIGHTS = {"company": 50, "school": 20, "platform": 15, "affiliation": 40, "role": 5}


def connector_scores(signals: DataFrame, weights: Mapping[str, float] = CONNECTOR_WEIGHTS) -> DataFrame:
    """(contact, score, kinds) from signals (contact, kind, name): each normalised name counts once per kind."""
    once = signals.withColumn("key", tx.employer_identity(F.col("name"))).where("key <> ''").select("contact", "kind", "key").distinct()
    weight = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    return once.groupBy("contact").agg(F.sum(F.coalesce(F.try_element_at(weight, F.col("kind")), F.lit(0))).alias("score"), F.array_sort(F.collect_set("kind")).alias("kinds"))


def claim_coverage(claims: DataFrame, results: DataFrame, least: float = 0.45) -> DataFrame:
    """(claim, status) from claims (claim, query) and results (claim, text, error): supported by a result whose words
    cover the query, gap without one, no_result, or provider_error when all failed."""
    covers = F.size(F.array_intersect(tx.tokens(F.col("query"), tx.RELEVANCE_STOPWORDS), tx.tokens(F.col("text"), tx.RELEVANCE_STOPWORDS))) / F.greatest(F.lit(1), F.size(tx.tokens(F.col("query"), tx.RELEVANCE_STOPWORDS)))
    per = claims.join(results, "claim", "left").groupBy("claim").agg(F.count("text").alias("texts"), F.count("error").alias("errors"), F.max(F.when(F.col("text").isNotNull(), covers)).alias("cover"))
    return per.select("claim", F.when((F.col("texts") == 0) & (F.col("errors") > 0), "provider_error").when(F.col("texts") == 0, "no_result").when(F.col("cover") >= least, "supported").otherwise("gap").alias("status"))


def promote(candidates: DataFrame, least_supported: float, order: Sequence[Column]) -> DataFrame:
    """Candidates with their exclusion reason, the others ranked by the metrics in order."""
    reason = F.when(F.col("rows") == 0, "no_rows").when(F.col("supported") < least_supported, "too_little_supported").when(F.col("credits").isNull(), "unknown_cost")
    marked = candidates.withColumn("excluded", reason)
    rank = F.row_number().over(Window.partitionBy(F.col("excluded").isNull()).orderBy(*order))
    return marked.withColumn("rank", F.when(F.col("excluded").isNull(), rank))


def same_inputs(a: DataFrame, b: DataFrame, key: str, inputs: Sequence[str]) -> DataFrame:
    """Rows that only one of two runs had, or had with other inputs; empty when the runs are comparable."""
    form = lambda d: d.select(key, F.sha2(F.to_json(F.struct(*inputs)), 256).alias("inputs"))
    return form(a).exceptAll(form(b)).unionByName(form(b).exceptAll(form(a)))


def cohort_ratios(df: DataFrame, group: str, complete: Column, verified: Column) -> DataFrame:
    """Complete rows over all, and verified ones over all and over complete."""
    return df.groupBy(group).agg((F.count_if(complete) / F.count("*")).alias("complete_share"), (F.count_if(verified) / F.count("*")).alias("verified_share"), F.try_divide(F.count_if(complete & verified), F.count_if(complete)).alias("verified_of_complete"))


def leverage(runs: DataFrame) -> DataFrame:
    """Calls made against the exhaustive plan: avoided share, results per credit and why the run stopped."""
    one = runs.agg(F.sum("calls").alias("calls"), F.sum("exhaustive").alias("exhaustive"), F.sum("results").alias("results"), F.sum("credits").alias("credits"), F.max("target").alias("target"))
    return one.withColumn("avoided", 1 - F.try_divide("calls", "exhaustive")).withColumn("per_credit", F.try_divide("results", "credits")).withColumn("stopped", F.when(F.col("results") >= F.col("target"), "target_reached").when(F.col("calls") >= F.col("exhaustive"), "exhausted").otherwise("budget"))


def source_plan(needs: Sequence[str], sources: Mapping[str, tuple[Sequence[str], Sequence[str]]]) -> tuple[list[str], list[str]]:
    """(stages, gaps): an order of sources (inputs, outputs) that yields the needed fields, and what none yields."""
    have, stages, left = {"input"}, [], dict(sources)
    while any(n not in have for n in needs):
        ready = sorted(k for k, (i, o) in left.items() if set(i) <= have and set(o) - have)
        if not ready:
            break
        stages.append(ready[0])
        have |= set(left.pop(ready[0])[1])
    return stages, [n for n in needs if n not in have]


def run_campaign(accounts: DataFrame, contacts: DataFrame, experiences: DataFrame, as_of: Column, owner_contact: int, include: int, review: int) -> dict[str, DataFrame]:
    """Accounts (account, domain, points), contacts (contact, account, linkedin, email, name, title) and experiences
    (contact, company, start, end, is_current) to ranked accounts, canonical contacts, a committee, warm paths from the
    owner's past colleagues, and contacts for direct outreach. Each stage is a table; the ranking is written once, the others are lazy."""
    ranked = ranking.rank_all(accounts.withColumn("decision", scoring.decision(F.col("points"), F.lit(None).cast("string"), include, review)), F.col("decision") == "exclude", F.desc("points"), "domain")
    keyed = contacts.withColumn("li", tx.normalize_linkedin_url(F.col("linkedin"))).withColumn("em", tx.normalize_email(F.col("email")))
    comp = entity.resolve(keyed, "contact", ["li", "em"])
    canonical = entity.merge(keyed.join(comp, "contact"), "component", "contact", ["account", "li", "em", "name", "title"]).drop("component")
    good = ranked.where("decision <> 'exclude'").select("account")
    committee = canonical.join(good, "account", "left_semi").withColumn("seniority", tx.seniority_rank(F.col("title"))).where("seniority <= 8")
    spans = experiences.select(F.col("contact").alias("id"), tx.normalize_company(F.col("company")).alias("k"), "start", "end", "is_current").where("k <> ''")
    overlap = joins.interval_overlap(spans.where(F.col("id") == owner_contact), spans.where(F.col("id") != owner_contact), "k", as_of)
    paths = committee.select(F.col("canonical").alias("target"), F.explode("aliases").alias("right_id")).join(overlap, "right_id").groupBy("target").agg(F.min("k").alias("company"), F.min("overlap_start").alias("since"))
    direct = committee.join(paths.select(F.col("target").alias("canonical")), "canonical", "left_anti").where(F.col("em").isNotNull())
    return {"accounts": ranked, "contacts": canonical, "committee": committee, "warm_paths": paths, "direct": direct}
