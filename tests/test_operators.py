"""Operators whose behaviour SQL on the driver's tables does not show."""

import pytest
from pyspark.sql import functions as F

from signal_engine.operators import enrichment, entity, joins, ranking, scoring, sets
from signal_engine.sources import readers, writers


def test_components_and_review(spark):
    contacts = spark.createDataFrame([(1, "l1", None, "CTO"), (2, "l1", "e1", "CTO"), (3, None, "e1", "Baker"), (4, None, None, "CEO")], "id long, li string, em string, title string")
    comp = entity.resolve(contacts, "id", ["li", "em"])
    assert {r["id"]: r["component"] for r in comp.collect()} == {1: 1, 2: 1, 3: 1, 4: 4}
    unsafe = entity.unsafe_components(comp.join(contacts, "id"), "component", [], "title")
    assert [(r["component"], r["reasons"]) for r in unsafe.collect()] == [(1, ["disjoint_titles"])]
    split = entity.split_unsafe(comp, unsafe, "component", "id")
    assert {r["id"]: (r["component"], r["review"]) for r in split.collect()} == {1: (1, True), 2: (2, True), 3: (3, True), 4: (4, False)}


def test_open_interval_counts_only_when_current(spark):
    rows = spark.createDataFrame([(1, "a", "2020-01-01", None, True), (2, "a", "2021-01-01", None, False), (3, "a", "2019-01-01", "2020-01-01", False)], "id long, k string, s string, e string, is_current boolean")
    rows = rows.select("id", "k", F.to_date("s").alias("start"), F.to_date("e").alias("end"), "is_current")
    got = joins.interval_overlap(rows, rows, "k", F.to_date(F.lit("2024-01-01"))).where("left_id < right_id")
    assert [(r["left_id"], r["right_id"], str(r["overlap_start"]), str(r["overlap_end"])) for r in got.collect()] == [(1, 3, "2020-01-01", "2020-01-01")]


def test_budget_skips_and_continues(spark):
    rows = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 7.0), ("a", 3, 4.0)], "k string, o long, c double")
    assert {r["o"]: r["admitted"] for r in ranking.greedy_budget(rows, "k", "o", "c", 9.0).collect()} == {1: True, 2: False, 3: True}


def test_authorization_order(spark):
    rows = spark.createDataFrame([("x", 1, "p", 60.0, False), ("x", 2, "p", 60.0, False), ("x", 3, "q", 50.0, False), ("x", 4, "q", 50.0, True)], "campaign string, seq long, provider string, credits double, cached boolean")
    got = {r["seq"]: r["decision"] for r in enrichment.authorize(rows, 100.0, {"p": 100.0}).collect()}
    assert got == {1: "authorized", 2: "provider_cap", 3: "campaign_cap", 4: "cache_hit"}


def test_layered_match(spark):
    rows = spark.createDataFrame([(1, "a.com", "acme"), (2, "", "astura medical"), (3, "", "zeta")], "id long, apex string, name string")
    known = spark.createDataFrame([(10, "a.com", "other"), (11, "", "astura medicals")], "known_id long, apex string, name string")
    assert {r["id"]: (r["known_id"], r["reason"]) for r in joins.layered_match(rows, known).collect()} == {1: (10, "apex"), 2: (11, "name"), 3: (None, None)}


def test_layered_match_equals_brute_force(spark):
    import random
    from difflib import SequenceMatcher

    rng = random.Random(3)
    names = ["jpmorgan chase", "asturra medical", "aaaa bbbb", "x", "zoé 😀 labs"] + ["".join(rng.choices("abcde ", k=rng.randint(3, 14))).strip() or "q" for _ in range(60)]
    asked = ["jp morgan chase", "astura medical", "aaa bbbb", "x", "zoe 😀 labs"] + [n[1:] + rng.choice("abc") for n in names[5:]] + [n[:2] + n[3:] or "w" for n in names[5:]]
    rows = spark.createDataFrame([(i, "", n) for i, n in enumerate(asked)], "id long, apex string, name string")
    known = spark.createDataFrame([(100 + i, "", n) for i, n in enumerate(names)], "known_id long, apex string, name string")
    expected = {}
    for i, a in enumerate(asked):
        ratio, k = max(((SequenceMatcher(None, a, b).ratio() if a and b else 0.0), -(100 + j)) for j, b in enumerate(names))
        expected[i] = -k if ratio >= 0.85 else None
    assert expected[0] == 100 and expected[1] == 101
    assert {r["id"]: r["known_id"] for r in joins.layered_match(rows, known).collect()} == expected


def test_receipts_and_ttl(spark):
    now = F.lit("2024-01-01 01:00:00").cast("timestamp")
    calls = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "call_key string")
    receipts = spark.createDataFrame([("a", "r", "2024-01-01 00:59:00", 600), ("b", "r", "2024-01-01 00:00:00", 600), ("c", "r", "2020-01-01 00:00:00", None)], "call_key string, response string, m string, stale_after int")
    answered, to_run = enrichment.replay(calls, receipts.withColumn("made_at", F.col("m").cast("timestamp")).drop("m"), now)
    assert sorted(r["call_key"] for r in answered.collect()) == ["a", "c"] and sorted(r["call_key"] for r in to_run.collect()) == ["b", "d"]


def test_path_weights_are_checked():
    with pytest.raises(ValueError):
        scoring.check_path_weights({**scoring.PATH_WEIGHTS, "work_overlap": 5})


def test_sources_and_sinks(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('id,ok,tags,extra\n1,yes,"[""x""]","multi\nline"\n2,no,a|b,\n')
    df = readers.read_records(spark, str(path), {"id": "int", "ok": "bool", "tags": "list"})
    rows = {r["id"]: r for r in df.collect()}
    assert rows[1]["ok"] is True and rows[1]["tags"] == ["x"] and "multi" in rows[1]["source_metadata_json"] and rows[2]["tags"] == ["a", "b"]
    with pytest.raises(ValueError):
        readers.read_records(spark, str(path), {"missing": "str"})
    assert writers.stable_csv(df.select("id", "ok"), ["id", "ok"], ["id"]) == "id,ok\n1,true\n2,false\n"
    with pytest.raises(ValueError):
        writers.stable_csv(df, ["id"], ["id"])
    pre = tmp_path / "b.csv"
    pre.write_text("Notes:\nfree text\n\nFirst Name,Date\nAda,05 Mar 2024\n,06 Mar 2024\n")
    found = readers.connections(readers.read_after_preamble(spark, str(pre), "First Name,", ["name", "date"]), ["name"], "date").collect()
    assert [(r["name"], str(r["date"])) for r in found] == [("Ada", "2024-03-05")]
    a, b = writers.table_digest(df.orderBy("id")).first(), writers.table_digest(df.orderBy(F.desc("id"))).first()
    assert a == b


def test_set_operations(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, None), (3, "c")], "k long, v string")
    assert sorted(map(tuple, sets.upsert(old, new, "k").collect())) == [(1, "a"), (2, "b"), (3, "c")]
    assert [r["k"] for r in sets.net_new(new, old, "k", "v").collect()] == [3]


def test_outbox_stream(spark, tmp_path):
    from signal_engine.streaming import feeds

    rows = [("k", "ready", "2024-01-01 00:00:00"), ("k", "sent", "2024-01-01 00:00:01"), ("k", "dispatching", "2024-01-01 00:00:02"), ("k", "sent", "2024-01-01 00:00:03")]
    df = spark.createDataFrame(rows, "id string, event string, t string").withColumn("ts", F.col("t").cast("timestamp")).drop("t")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = feeds.read_feed(spark, str(tmp_path / "in"), "id string, event string, ts timestamp")
    got = feeds.run_to_table(feeds.outbox(stream, "id", "ts", "event"), str(tmp_path / "out"), "append", str(tmp_path / "cp")).orderBy("at").collect()
    assert got[-1]["state"] == "sent"


def test_budget_and_figures_take_whole_tables(spark):
    from signal_engine import catalogue

    orders = sorted(spark.read.parquet("/root/testdata/sf0.001/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority").collect(), key=lambda r: r["o_orderkey"])
    spent, admitted, clusters = {}, {}, {}
    for r in orders:
        k, c = r["o_custkey"], float(r["o_totalprice"])
        if fits := spent.get(k, 0.0) + c <= 500000.0:
            spent[k] = spent.get(k, 0.0) + c
        admitted[r["o_orderkey"]] = fits
        own = clusters.setdefault(str(k % 9), [])
        found = next((x for x in own if abs(c - x[0]) <= 0.02 * x[0]), None)
        if found is None:
            own.append(found := [c, 0, set()])
        found[1] += 1
        found[2].add(r["o_orderpriority"])
    assert max(admitted) >= 400 and {r["o_orderkey"]: r["admitted"] for r in catalogue.queries()["running_budget"](spark, "/root/testdata/sf0.001").collect()} == admitted
    got = sorted((r["topic"], round(r["value"], 6), r["figures"], r["sources"]) for r in catalogue.queries()["corroborate_figures"](spark, "/root/testdata/sf0.001").collect())
    assert got == sorted((t, round(x[0], 6), x[1], len(x[2])) for t, own in clusters.items() for x in own)
