"""Fixture cases of the scalar functions."""

import datetime

import pytest
from pyspark.sql import functions as F

from signal_engine.functions import dates, variant
from signal_engine.functions import text as tx
from signal_engine.operators import evidence


def one(spark, column, **cells):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in cells.items()] or [F.lit(1).alias("x")]).select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("url", "apex"),
    [("shop.nordlicht.example.com", "example.com"), ("quellwerk.co.jp", "quellwerk.co.jp"), ("www.harbours.co.uk", "harbours.co.uk"), ("https://jobs.tidewheel.com/open?x=1", "tidewheel.com"), ("", ""), (None, ""), ("localhost", ""), ("http://a b.com", "")],
)
def test_apex(spark, url, apex):
    assert one(spark, tx.extract_apex(F.col("u").cast("string")), u=url) == apex


@pytest.mark.parametrize(("name", "norm"), [("Nordlicht Bakery, Inc.", "nordlicht bakery"), ("Quellwerk Systems Holdings Ltd", "quellwerk"), ("7Harbours", "7harbours"), ("SA", ""), (None, "")])
def test_norm_name(spark, name, norm):
    assert one(spark, tx.norm_name(F.col("n").cast("string")), n=name) == norm


@pytest.mark.parametrize(("name", "key"), [("Société Générale SA", "societe generale"), ("Acme GmbH & Co", "acme"), ("Widgets, Inc. LLC", "widgets"), ("Inc", "")])
def test_company(spark, name, key):
    assert one(spark, tx.normalize_company(F.col("n")), n=name) == key


def test_identities(spark):
    assert one(spark, tx.normalize_linkedin_url(F.lit("https://www.linkedin.com/in/Jane-Doe/?x=1"))) == "linkedin.com/in/jane-doe"
    assert one(spark, tx.normalize_linkedin_url(F.lit("https://www.linkedin.com/sales/lead/1"))) is None
    assert one(spark, tx.normalize_email(F.lit(" Jane@Acme.COM "))) == "jane@acme.com"
    assert one(spark, tx.normalize_email(F.lit("jane@acme"))) is None
    assert one(spark, tx.normalize_phone(F.lit("(415) 555-0100"))) == "+14155550100"
    assert one(spark, tx.normalized_identity(F.lit("A  B"), F.lit("Co"), F.lit(""))) is None
    assert one(spark, tx.canonical_url(F.lit("https://www.A.com/x/?utm_source=y&id=3#top"))) == "a.com/x?id=3"
    assert one(spark, tx.path_template(F.lit("/v1/users/42/items/123e4567-e89b-12d3-a456-426614174000"))) == "/v1/users/{NUM_ID}/items/{UUID}"


def test_text_rules(spark):
    assert one(spark, tx.split_multi_value(F.lit('["a", " b "]'))) == ["a", "b"]
    assert one(spark, tx.split_multi_value(F.lit("a; b|c,,d"))) == ["a", "b", "c", "d"]
    assert one(spark, tx.money_figures(F.lit("raised $3.5M and $1,200"))) == [3.5e6, 1200.0]
    assert one(spark, tx.title_query('("vice president" OR vp) AND NOT sales', F.lit("VP Marketing")))
    assert not one(spark, tx.title_query('("vice president" OR vp) AND NOT sales', F.lit("VP of Sales")))
    assert one(spark, tx.snippet(F.lit("nothing here"), F.lit("zzz"))) is None
    assert one(spark, tx.error_class(F.lit("HTTP 429 Too Many Requests"))) == "rate-limited"
    assert one(spark, tx.is_nonwork(F.lit("Board Member"), F.lit("Acme"))) and not one(spark, tx.is_nonwork(F.lit("VP Engineering"), F.lit("Acme")))
    assert not one(spark, tx.is_nonwork(F.lit("Security Advisor"), F.lit("Acme"), F.lit("Security Advisor")))
    assert one(spark, tx.headline_role(F.lit("Acme | VP Engineering @ Acme"), F.lit("Acme"))) == "VP Engineering"
    assert one(spark, tx.grounded(F.lit("Ada Lovelace"), F.lit("Ada Lovelace, founder"), F.lit("We met Ada Lovelace, founder of X.")))
    assert one(spark, tx.interpolate("hi {{a.b}}{{c}}!", F.try_parse_json(F.lit('{"a": {"b": "x"}}')))) == "hi x!"


def test_dates(spark):
    day = F.to_date(F.lit("2024-06-30"))
    assert one(spark, dates.parse_date(F.lit("5 Mar 2024"))) == datetime.date(2024, 3, 5)
    assert one(spark, dates.parse_date(F.lit("2024-03-05T10:00:00Z"))) == datetime.date(2024, 3, 5)
    assert one(spark, dates.parse_date(F.lit("soon"))) is None
    assert [one(spark, dates.start_key(F.lit(x))) for x in ("2024", "2024-03", "03-2024", "x")] == [202400, 202403, 202403, 0]
    assert one(spark, dates.freshness_bucket(F.to_date(F.lit("2024-07-01")), day)) == "future"
    assert one(spark, dates.freshness(F.lit(None).cast("timestamp"), F.lit("2024-01-01").cast("timestamp"), "evergreen_ok")) == 0.4
    assert not one(spark, dates.has_offset(F.lit("2024-01-01T00:00:00"))) and one(spark, dates.has_offset(F.lit("2024-01-01T00:00:00+02:00")))
    assert one(spark, dates.source_date(F.lit("on 2024-01-02 and again 2024-01-02"))) == datetime.date(2024, 1, 2)
    assert one(spark, dates.source_date(F.lit("2024-01-02 or 2024-01-03"))) is None


def test_variant_and_evidence(spark):
    v = F.try_parse_json(F.lit('{"a": null, "b": 1}'))
    assert one(spark, variant.present(v, "$.a")) and not one(spark, variant.present(v, "$.z"))
    for raw in ('{"scores": {"x": 0.5}}', '{"x": 0.5}', '[{"id": "x", "score": 0.5}]'):
        assert one(spark, variant.model_scores(F.lit(raw))) == {"x": 0.5}
    assert one(spark, evidence.excerpt_bound(F.lit("a  b"), F.lit("see a b here"))) == "whitespace"
    assert one(spark, evidence.excerpt_bound(F.lit("art"), F.lit("party"))) is None
    assert one(spark, evidence.colocated(F.lit("x " * 10 + "alpha beta"), F.array(F.lit("alpha"), F.lit("beta"))))
    assert one(spark, evidence.collect_keys(F.lit('{"a": {"email": "x"}, "b": [{"workEmail": "y"}]}'), "(?i)email")) == ["x", "y"]
    assert one(spark, evidence.people_in_prose(F.lit("We met Ada Lovelace, Chief Engineer at X.")))[0]["name"] == "Ada Lovelace"
    assert one(spark, evidence.ascii_fold(F.lit("Café"))) == "Cafe"


@pytest.mark.parametrize(
    ("first", "last", "full", "fits"),
    [
        ("Jörg", "Núñez", "Jorg Nunez", True), ("Kate", "Brown", "Katherine Brown-Ross", True), ("Al", "Stone", "Alan Stone", False), ("Ala", "Stone", "Alan Stone", True), ("R", "Vale", "Rosa Vale", True),
        ("Tim", "Vale", "T Vale, PhD", True), ("J Ryan", "Oak", "Ryan Oak", True), ("J Ryan", "Oak", "James Oak", False), ("Peggy", "Marsh", "Margaret 'Peggy' Marsh", True), ("Chuck", "Hill", "Carl 'Charlie' Hill", True),
        ("Dana", "Reed", "Dana", False), ("", "Reed", "Dana Reed", False), ("Dana", None, "Dana Reed", False), ("Dana", "Reed", None, False), ("Dana", "Re", "Dana Reed", True), ("Dana", "Moss", "Dana Reed", False),
        ("Bill", "O'Hara", "William OHara", True), ("Sara", "Ek", "Sarah (Ek) Berg", True), ("木", "林", "木 林", False),
    ],
)
def test_names_match(spark, first, last, full, fits):
    from signal_engine.operators import campaign

    row = spark.createDataFrame([(first, last, full)], "f string, l string, p string").select(campaign.names_match(F.col("f"), F.col("l"), F.col("p")).alias("ok")).first()
    assert bool(row["ok"]) == fits
