"""Sources, sinks and scalar rules that no query shows."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from signal_engine.functions import text as tx
from signal_engine.operators import ranking
from signal_engine.sources import readers, writers
from signal_engine.streaming import feeds


def value(spark, column, **cells):
    row = spark.createDataFrame([tuple(cells.values())], ", ".join(f"{k} string" for k in cells))
    return row.select(column.alias("r")).first()["r"]


def test_aliased_csv_and_required_fields(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Company Name,Site\nAcme,acme.test\n")
    rows = readers.read_aliased(spark, str(tmp_path / "a.csv"), {"Company Name": "name", "Site": "domain"}, ["name", "domain"])
    assert [(r["name"], r["domain"]) for r in rows.collect()] == [("Acme", "acme.test")]
    with pytest.raises(ValueError, match="phone"):
        readers.read_aliased(spark, str(tmp_path / "a.csv"), {}, ["phone"])


def test_request_log(spark, tmp_path):
    entry = lambda m, u, s: {"request": {"method": m, "url": u}, "response": {"status": s}}
    (tmp_path / "x.har").write_text(json.dumps({"log": {"entries": [entry("GET", "https://h.test/a/7?q=1", 200), entry("POST", "https://h.test/a/8#z", 500)]}}))
    log = readers.read_har(spark, str(tmp_path / "x.har"))
    assert sorted((r["method"], r["path"], r["status"]) for r in log.collect()) == [("GET", "/a/7", 200), ("POST", "/a/8", 500)]
    assert [(r["template"], r["methods"], r["calls"]) for r in readers.route_inventory(log).collect()] == [("/a/{NUM_ID}", ["GET", "POST"], 2)]


def test_table_writers(spark, tmp_path):
    old, new = f"{tmp_path}/old", f"{tmp_path}/new"
    schema = "k string, v string, at int"
    spark.createDataFrame([("a", "1", 1), ("b", "2", 1)], schema).write.parquet(old)
    rows = spark.createDataFrame([("b", None, 2), ("c", "3", 2), ("c", "4", 3)], schema)
    writers.write_upsert(rows.where("at = 2"), old, new, "k")
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(new).collect()) == [("a", "1"), ("b", "2"), ("c", "3")]
    writers.write_net_new(rows, old, ["k"], ["at"])
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(old).collect()) == [("a", "1"), ("b", "2"), ("c", "3")]
    writers.export_csv(rows, f"{tmp_path}/csv")
    assert sorted(r["k"] for r in spark.read.option("header", True).csv(f"{tmp_path}/csv").collect()) == ["b", "c", "c"]


def test_fan_out_hands_each_listener_its_rows(spark, tmp_path):
    schema = "k string, n int"
    spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], schema).write.parquet(f"{tmp_path}/feed")
    heard = {"small": [], "a": []}
    keep = lambda name: lambda rows, batch: heard[name].extend(r["n"] for r in rows.collect())
    feeds.fan_out(feeds.read_feed(spark, f"{tmp_path}/feed", schema), {"small": (F.col("n") < 3, keep("small")), "a": (F.col("k") == "a", keep("a"))}, f"{tmp_path}/c").start().awaitTermination()
    assert sorted(heard["small"]) == [1, 2] and sorted(heard["a"]) == [1, 3]


def test_signed_time_and_sessions(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    rows = spark.createDataFrame([(1, at(10)), (2, at(3)), (3, None)], "id int, sent_at timestamp")
    assert [r["id"] for r in feeds.ready_events(rows, 300, F.lit("2024-01-01 00:12:00").cast("timestamp")).collect()] == [1]
    spark.createDataFrame([("u", at(0)), ("u", at(4)), ("u", at(30))], "k string, t timestamp").write.parquet(f"{tmp_path}/feed")
    counts = feeds.sessions(feeds.read_feed(spark, f"{tmp_path}/feed", "k string, t timestamp"), "t", "k", "10 minutes").select("k", "count")
    table = feeds.run_to_table(counts, f"{tmp_path}/table", "complete", f"{tmp_path}/c")
    assert sorted(r["count"] for r in table.collect()) == [1, 2]


def test_names_keys_and_titles(spark):
    assert value(spark, tx.linkedin_name(F.col("u")), u="https://www.linkedin.com/in/mara-van-dyk-8a1b2/") == "Mara Van Dyk"
    assert value(spark, tx.contact_key(F.col("l"), F.col("e"), F.col("i")), l=None, e=" Mara@X.test ", i="x") == "email:mara@x.test"
    assert value(spark, tx.contact_key(F.col("l"), F.col("e"), F.col("i")), l="linkedin.com/in/Mara?x=1", e="m@x.test", i="x") == "linkedin:linkedin.com/in/mara"
    assert value(spark, tx.contact_key(F.col("l"), F.col("e"), F.col("i")), l=None, e=None, i="n|c|t") == "identity:n|c|t"
    assert value(spark, tx.contains_phrase(F.col("t"), F.col("p")), t="VP, Data-Platform (EU)", p="data platform") is True
    assert value(spark, tx.contains_phrase(F.col("t"), F.col("p")), t="Database lead", p="data") is False
    assert value(spark, tx.normalize_school(F.col("s")), s="The University of Łódź at X") == value(spark, tx.normalize_school(F.col("s")), s="university ŁÓDŹ x")
    assert [value(spark, tx.truthy(F.col("c")), c=c) for c in (" Yes", "T", "0", None)] == [True, True, False, False]
    assert [value(spark, tx.host_matches_domain(F.col("h"), F.col("d")), h=h, d="a.test") for h in ("a.test", "x.a.test", "xa.test")] == [True, True, False]
    assert value(spark, tx.domain_slugs(F.col("d")), d="big-blue-hq.com")[:2] == ["big-blue-hq", "bigbluehq"]
    assert [value(spark, tx.team_of(F.col("t")), t=t) for t in ("GTM", "Data", "Garden", None)] == ["Sales", "Product & Eng", "Garden", None]


def test_figures_and_roles(spark):
    text = "raised $7.25k and usd 3 bn, grew 40 percent to 4 thousand seats, or 5 % of $2 million"
    assert value(spark, tx.money_figures(F.col("t")), t=text) == [7250.0, 3e9, 2e6]
    assert value(spark, tx.percent_figures(F.col("t")), t=text) == [40.0, 5.0] and value(spark, tx.count_figures(F.col("t")), t=text) == [4000.0]
    assert [value(spark, tx.is_nonwork(F.col("t")), t=t) for t in ("Board  Member", "Self employed", "Mentoring lead", "Engineer")] == [True, False, False, False]


def test_rerank_order(spark):
    rows = spark.createDataFrame([(1, False, 9.0, 9.0, 9.0), (2, True, 1.0, 2.0, 3.0), (3, True, 1.0, 2.0, 4.0), (4, True, 1.0, 2.0, 4.0), (5, True, 2.0, 0.0, 0.0)], "id int, eligible boolean, final double, judge double, relevance double")
    assert [r["id"] for r in rows.orderBy(*ranking.rerank_order()).collect()] == [5, 3, 4, 2, 1]
