"""Edge cases of ordered folds, role rules, candidate filters and ranks, against brute force where it says more."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from signal_engine.functions import roles
from signal_engine.functions import text as tx
from signal_engine.operators import enrichment, evidence, joins, portfolio, ranking, selection, sets


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).coalesce(1).select(column).collect()]


def test_budget_by_key_with_nulls_and_large_key(spark):
    rng = random.Random(3)
    rows = [(None if i % 3 == 0 else i % 2, i, None if i % 50 == 0 else float(rng.randint(1, 9))) for i in range(25_000)]
    spent, expected = {}, {}
    for k, o, c in rows:
        if c is None:
            expected[o] = None
            continue
        expected[o] = spent.get(k, 0.0) + c <= 4000.0
        spent[k] = spent.get(k, 0.0) + (c if expected[o] else 0.0)
    got = ranking.greedy_budget(spark.createDataFrame(rows, "k int, o long, c double").repartition(7), "k", "o", "c", 4000.0)
    assert got.columns == ["k", "o", "c", "admitted"] and {r["o"]: r["admitted"] for r in got.collect()} == expected
    assert ranking.greedy_budget(spark.createDataFrame([], "k int, o long, c double"), "k", "o", "c", 1.0).count() == 0


def test_authorize_with_unknown_credits(spark):
    rows = [("a", 1, None, None, False), ("a", 2, "p", 60.0, False), ("a", 3, "p", 50.0, False), ("a", 4, "q", 50.0, False), ("a", 5, "q", 40.0, None), (None, 1, "p", 1.0, True)]
    got = enrichment.authorize(spark.createDataFrame(rows, "campaign string, seq long, provider string, credits double, cached boolean"), 100.0, {"p": 100.0}).collect()
    assert {(r["campaign"], r["seq"]): r["decision"] for r in got} == {("a", 1): "authorized", ("a", 2): "authorized", ("a", 3): "provider_cap", ("a", 4): "campaign_cap", ("a", 5): "authorized", (None, 1): "cache_hit"}


def test_corroborate_in_order(spark):
    rows = [("t", 1, "usd", 100.0, "a"), ("t", 2, "usd", 101.9, "b"), ("t", 3, "usd", 103.0, "a"), ("t", 4, "percent", 100.0, ""), ("t", 5, "usd", 99.0, "a"), (None, 6, "usd", 1.0, None), ("t", 7, "usd", None, "z")]
    got = evidence.corroborate(spark.createDataFrame(rows, "topic string, ordinal long, unit string, value double, domain string")).collect()
    assert sorted((str(r["topic"]), r["unit"], r["value"], r["figures"], r["sources"]) for r in got) == [("None", "usd", 1.0, 1, 0), ("t", "percent", 100.0, 1, 0), ("t", "usd", 100.0, 3, 2), ("t", "usd", 103.0, 1, 1)]


def test_ranks_chunks_and_pareto_over_partitions(spark):
    rng = random.Random(5)
    rows = [(i, rng.randint(0, 300), rng.randint(0, 300)) for i in range(2_000)]
    df = spark.createDataFrame(rows, "id long, gain int, cost int")
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    assert {r["id"]: r["rank"] for r in ranking.rank_all(df, F.desc("gain"), "id").collect()} == {r[0]: i + 1 for i, r in enumerate(order)}
    kept = {r["id"] for r in portfolio.pareto(df, "id", "gain", "cost").collect()}
    assert kept == {a[0] for a in rows if not any(b[1] >= a[1] and b[2] <= a[2] and (b[1] > a[1] or b[2] < a[2]) for b in rows)}
    sizes = sets.chunks(df.select("id"), ["id"], 300, 250).groupBy("chunk").count().orderBy("chunk").collect()
    assert [r["count"] for r in sizes] == [300] * 5 + [250, 250]
    assert portfolio.pareto(df.limit(0), "id", "gain", "cost").count() == 0


def test_token_subset_against_all_pairs(spark):
    rng = random.Random(7)
    side = [(i, [f"w{int(rng.random() ** 3 * 12)}" for _ in range(rng.randint(0, 4))]) for i in range(120)]
    df = spark.createDataFrame(side, "id long, tokens array<string>")
    expected = {(a, b) for (a, x), (b, y) in itertools.product(side, side) if x and y and (set(x) <= set(y) or set(y) <= set(x))}
    got = [(r["left_id"], r["right_id"]) for r in joins.token_subset(df, df).collect()]
    assert len(got) == len(set(got)) and set(got) == expected


def test_interval_overlap_over_years(spark):
    rng = random.Random(9)
    rows = [(i, "k" if i % 2 else "j", f"{2000 + rng.randint(0, 9)}-0{rng.randint(1, 9)}-01", f"{2000 + rng.randint(0, 12)}-0{rng.randint(1, 9)}-15") for i in range(80)]
    df = spark.createDataFrame(rows, "id long, k string, s string, e string").select("id", "k", F.col("s").cast("date").alias("start"), F.col("e").cast("date").alias("end"), F.lit(False).alias("is_current"))
    expected = sorted((a[0], b[0], max(a[2], b[2]), min(a[3], b[3])) for a, b in itertools.product(rows, rows) if a[1] == b[1] and max(a[2], b[2]) <= min(a[3], b[3]))
    got = joins.interval_overlap(df, df, "k", F.lit("2030-01-01").cast("date")).collect()
    assert sorted((r["left_id"], r["right_id"], str(r["overlap_start"]), str(r["overlap_end"])) for r in got) == expected


def test_figures(spark):
    text = "USD 12.5 million and $380 billion (65%, 12.5 percent), 30 million users, $1,200, 7 of 2024, 3 bn, $5k"
    got = [(r["unit"], r["value"]) for r in spark.range(1).select(F.explode(tx.all_figures(F.lit(text))).alias("f")).select("f.*").collect()]
    assert got == [("usd", 12.5e6), ("usd", 380e9), ("usd", 1200.0), ("usd", 5e3), ("percent", 65.0), ("percent", 12.5), ("count", 30e6), ("count", 3e9)]
    assert values(spark, [(None,), ("",)], "t string", tx.all_figures(F.col("t"))) == [[], []]


def test_roles_and_titles(spark):
    titles = [("RevOps lead",), ("Revenue-Operations",), ("gtm engineers",), ("recruiting revops",), (None,), ("Procurement head",)]
    assert values(spark, titles, "t string", roles.role_family(F.col("t"), {"buying": ("procurement head",), "none": ()})) == ["revenue_operations", "revenue_operations", None, None, None, "buying"]
    assert roles.role_words(["VP of Data", "data"])[:3] == ["chief", "cto", "data"]
    named = values(spark, [("Zoë Ångström-Lee - Senior Engineer ",), ("plain title | x",), (None,)], "t string", roles.title_parts(F.col("t")))
    assert named[0] == ("Zoë Ångström-Lee", "Senior Engineer") and named[1:] == [None, None]


def test_drafts_and_entities(spark):
    rows = [("strong_warm_intro", None), ("review_warm_intro", " True"), ("review_warm_intro", "no"), (None, "true")]
    assert values(spark, rows, "s string, o string", selection.draftable(F.col("s"), F.col("o"), True)) == [True, True, False, False]
    assert values(spark, rows, "s string, o string", selection.draftable(F.col("s"), F.col("o"))) == [True, False, False, False]
    assert values(spark, [(" \n", "true"), ("x", "TRUE "), ("x", None)], "b string, a string", selection.sendable(F.col("b"), F.col("a"))) == [False, True, False]
    assert values(spark, [("Crème", "la creme!"), ("x", "x"), (None, "x"), ("ab", None)], "e string, t string", selection.matches_entity(F.col("e"), F.col("t"))) == [True, False, False, False]
    urls = [("https://acme.co.uk/x", "ACME"), ("https://acme.directory.example", "acme"), ("nonsense", "acme"), (None, None), ("https://go.ok.example", "zz")]
    assert values(spark, urls, "u string, e string", selection.official_domain(F.col("u"), F.col("e"), ["directory.example"], ["ok.example"])) == [True, False, False, False, True]


def test_reject_only_refuses_unknown_and_repeated_ids(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "id long, v string")
    keep = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id long")
    assert [tuple(r) for r in selection.reject_only(df, keep(2, 2, None), "id").collect()] == [(2, "b")]
    assert selection.reject_only(df, keep(), "id").count() == 0
    with pytest.raises(Exception, match="unknown id: 9"):
        selection.reject_only(df, keep(1, 9), "id").collect()
    with pytest.raises(Exception, match="repeated id: 1"):
        selection.reject_only(df.unionByName(df), keep(1), "id").collect()


def test_scorecards_counts_and_identities(spark):
    attempts = spark.createDataFrame([("p", 2, 1.0, None), ("p", 3, None, "x"), ("q", 4, 2.0, None)], "program string, calls long, credits double, error string")
    results = spark.createDataFrame([("p", "u", True, 2), ("p", "u", True, 0), ("p", "v", False, 3)], "program string, unit string, complete boolean, claims long")
    got = {r["program"]: r for r in selection.program_scorecard(attempts, results).collect()}
    assert (got["p"]["complete_results"], got["p"]["complete_units"], got["p"]["verified_claims"], got["p"]["credits"], got["p"]["calls_per_claim"], got["p"]["unobserved"]) == (2, 1, 5, None, 1.0, 1)
    assert (got["q"]["complete_results"], got["q"]["calls_per_claim"], got["q"]["credits_per_claim"]) == (0, None, None)
    contacts = spark.createDataFrame([("a", None, None, "N", "", "t"), ("b", None, "X@y.io", "N", "C", "T")], "account string, linkedin string, email string, name string, company string, title string")
    known = selection.known_identities(contacts.where("account = 'b'"), "account").first()
    assert (known["linkedin_urls"], known["emails"], known["identities"]) == ([], ["x@y.io"], ["n|c|t"])
    with pytest.raises(Exception, match="no identities: a"):
        selection.known_identities(contacts, "account").collect()
    reasons = spark.createDataFrame([(["a", "a", "b"],), ([],), (None,), (["b", ""],)], "r array<string>")
    assert {r["reason"]: r["rows"] for r in selection.exclusion_counts(reasons, F.col("r")).collect()} == {"a": 1, "b": 2}
    assert {r["value"]: r["rows"] for r in selection.counts_with_zeros(reasons.select(F.lit("x").alias("s")), "s", ["x", "y"]).collect()} == {"x": 4, "y": 0}


def test_allowed_email_domains(spark):
    from signal_engine.operators import scoring

    columns = "person string, email string, company string, current_company string, title string, domain string, linkedin string, profile_at date, verified_at date, identity string, validation string, corroboration int, confidence string, allowed_email_domains string"
    row = lambda p, email, domain, allowed, now="Acme": (p, email, "Acme", now, "CTO", domain, "", None, None, "name", "valid", 0, "high", allowed)
    rows = [row("a", "x@acme.io", "acme.com", "acme.io; www.acme.de"), row("b", "x@acme.net", "acme.com", "acme.io"), row("c", "x@acme.com", "acme.com", None), row("d", "x@other.org", "", None), row("e", "x@other.org", "", "https://acme.io/x"), row("f", "x@acme.com", "acme.com", "acme.com", "Beta"), row("f", "y@acme.com", "acme.com", None, "Beta")]
    got = {(r["person"], r["email"]): r["flags"] for r in scoring.audit_contacts(spark.createDataFrame(rows, columns), F.to_date(F.lit("2024-01-01"))).collect()}
    assert {k[0] for k, v in got.items() if "email_domain_mismatch" in v} == {"b", "e", "f"}
    assert {k[0] for k, v in got.items() if "duplicate_person_conflict" in v} == {"f"}
