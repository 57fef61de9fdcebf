"""Keyed state over streams: restarts, replays, refusals, timeouts and late rows on small feeds."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from signal_engine.streaming import feeds, machines

SCHEMA = "k string, id long, event string, ts timestamp"
MACHINE = machines.Machine("idle", {("idle", "start"): "busy", ("busy", "stop"): "idle", ("busy", "end"): "over", ("stuck", "start"): "busy"}, {"busy": (600, "stuck")}, frozenset({"over"}))


def at(minute):
    return dt.datetime(2024, 1, 1, 0, 0) + dt.timedelta(minutes=minute)


def feed(spark, path, rows):
    spark.createDataFrame([(k, i, e, at(m)) for k, i, e, m in rows], SCHEMA).coalesce(1).write.mode("append").parquet(path)


def run_machine(spark, base):
    outputs = machines.run_machine(feeds.read_feed(spark, f"{base}/feed", SCHEMA), MACHINE, "k", "id", "event", "ts", "5 minutes")
    with machines.keyed_state(spark):
        return feeds.run_to_table(outputs, f"{base}/table", "append", f"{base}/checkpoint")


def shown(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_machine_goes_on_after_a_restart(spark, tmp_path):
    feed(spark, f"{tmp_path}/feed", [("a", 1, "start", 0), ("a", 2, "stop", 5), ("a", 3, "stop", 6), ("b", 4, "start", 6), ("c", 5, "dance", 6)])
    first = shown(run_machine(spark, tmp_path), "k", "event_id", "from_state", "to_state", "status", "error")
    assert first == [
        ("a", 1, "idle", "busy", "completed", None), ("a", 2, "busy", "idle", "completed", None), ("a", 3, "idle", "idle", "invalid", "forbidden_transition"),
        ("b", 4, "idle", "busy", "completed", None), ("c", 5, "idle", "idle", "invalid", "unknown_event"),
    ]
    # a later run: a replay, a state that lasted too long and ended between, one that the watermark ends, a terminal one
    feed(spark, f"{tmp_path}/feed", [("a", 3, "stop", 6), ("a", 6, "start", 20), ("a", 7, "end", 21), ("a", 8, "start", 22), ("b", 9, "start", 40), ("d", 10, "start", 30), ("c", 11, "dance", 60)])
    table = run_machine(spark, tmp_path)
    later = [r for r in shown(table, "k", "event_id", "from_state", "to_state", "status", "error", "at") if r[:6] not in first]
    assert later == sorted(
        [
            ("a", 6, "idle", "busy", "completed", None, at(20)), ("a", 7, "busy", "over", "completed", None, at(21)), ("a", 8, "over", "over", "invalid", "terminal_state", at(22)),
            ("b", None, "busy", "stuck", "timed_out", None, at(16)), ("b", 9, "stuck", "busy", "completed", None, at(40)), ("b", None, "busy", "stuck", "timed_out", None, at(50)),
            ("c", 11, "idle", "idle", "invalid", "unknown_event", at(60)), ("d", None, "busy", "stuck", "timed_out", None, at(40)), ("d", 10, "idle", "busy", "completed", None, at(30)),
        ],
        key=repr,
    )
    assert table.select("transition_key").distinct().count() == table.count()
    inputs = shown(machines.handoffs(table, MACHINE), "k", "state")
    assert ("a", "over") not in inputs and len(inputs) == len([r for r in first + later if r[4] != "invalid" and r[3] != "over"])


def test_machine_tables_are_checked(spark):
    with pytest.raises(ValueError, match="way out"):
        machines.Machine("a", {("z", "go"): "a"}, {}, frozenset({"z"}))
    with pytest.raises(ValueError, match="0 seconds"):
        machines.Machine("a", {}, {"a": (0, "b")})
    assert MACHINE.table(spark).where("terminal").count() == 1


def test_calls_keep_their_last_run_over_restarts(spark, tmp_path):
    def run():
        calls = feeds.read_feed(spark, f"{tmp_path}/feed", SCHEMA)
        ttl = F.when(F.col("event") == "always", 0).when(F.col("event") == "hour", 3600)
        with machines.keyed_state(spark):
            return feeds.run_to_table(machines.calls_with_ttl(calls, ["k", "event"], "id", "ts", ttl, "5 minutes"), f"{tmp_path}/table", "append", f"{tmp_path}/checkpoint")

    feed(spark, f"{tmp_path}/feed", [("a", 1, "always", 0), ("a", 2, "always", 0), ("a", 3, "hour", 1), ("a", 4, "hour", 60), ("a", 5, "never", 2), (None, 6, "hour", 3)])
    run()
    feed(spark, f"{tmp_path}/feed", [("a", 7, "hour", 61), ("a", 8, "never", 9000), ("b", 9, "never", 9000), ("a", 10, "hour", 9000), ("a", 11, "always", 9000), (None, 12, "hour", 62)])
    got = {r["id"]: (r["action"], r["ran_at"]) for r in run().collect()}
    assert got == {
        1: ("run", at(0)), 2: ("run", at(0)), 3: ("run", at(1)), 4: ("reuse", at(1)), 5: ("run", at(2)), 6: ("run", at(3)), 7: ("run", at(61)), 8: ("reuse", at(2)), 9: ("run", at(9000)),
        10: ("run", at(9000)), 11: ("run", at(9000)), 12: ("reuse", at(3)),
    }


def test_late_rows_stand_aside_and_none_is_lost(spark, tmp_path):
    deliveries = [[("a", 1, "x", 0), ("a", 2, "x", 100)], [("a", 3, "x", 95), ("a", 4, "x", 10), ("a", 2, "x", 100), ("a", 5, "x", 300)], [("b", 6, "x", 299), ("b", 7, "x", 200), (None, 8, None, 0)]]
    for rows in deliveries:
        feed(spark, f"{tmp_path}/feed", rows)
        machines.part_late_rows(feeds.read_feed(spark, f"{tmp_path}/feed", SCHEMA), "ts", "10 minutes", str(tmp_path), f"{tmp_path}/checkpoint")
    late, on_time = (spark.read.schema(SCHEMA).parquet(f"{tmp_path}/{n}") for n in ("late", "on_time"))
    assert sorted(r["id"] for r in late.collect()) == [4, 7, 8] and sorted(r["id"] for r in on_time.collect()) == [1, 2, 2, 3, 5, 6]
    # a batch that comes again reads the marks of those before it only
    machines.part_late_rows(feeds.read_feed(spark, f"{tmp_path}/feed", SCHEMA), "ts", "10 minutes", str(tmp_path), f"{tmp_path}/checkpoint")
    assert late.count() == 3 and on_time.count() == 6


def test_change_feed_and_listener(spark):
    rows = [("a", 1, "x", False), ("a", 2, "x", False), ("a", 3, "y", False), ("a", 4, "y", True), ("a", 5, "y", True), ("a", 6, None, False), ("a", 7, "z", False), ("b", 1, "q", True)]
    changes = machines.change_feed(spark.createDataFrame(rows, "k string, n int, v string, gone boolean"), "k", "n", ["v"], F.col("gone"))
    got = [(r["n"], r["operation"], r["before"] and r["before"]["v"], r["after"] and r["after"]["v"]) for r in changes.orderBy("n").collect()]
    assert got == [(1, "INSERT", None, "x"), (3, "UPDATE", "x", "y"), (4, "DELETE", "y", None), (6, "INSERT", None, None), (7, "UPDATE", None, "z")]
    heard = machines.listen(changes, ["UPDATE", "DELETE"], {"v": {"in": ["x", "y"]}})
    assert sorted(r["n"] for r in heard.collect()) == [3, 4]
    assert machines.listen(changes, ["INSERT"], {"v": {"isNull": True}}).count() == 0  # an insert has no image before
    with pytest.raises(ValueError, match="TRUNCATE"):
        machines.listen(changes, ["TRUNCATE"])
    assert machines.change_feed(spark.createDataFrame([], "k string, n int, v string, gone boolean"), "k", "n", ["v"], F.col("gone")).count() == 0


def test_followed_by_gives_nulls_behind_the_watermark(spark, tmp_path):
    feed(spark, f"{tmp_path}/a", [("u", 1, "click", 0), ("u", 2, "click", 50), ("v", 3, "click", 0), ("w", 4, "click", 500)])
    feed(spark, f"{tmp_path}/b", [("u", 11, "buy", 30), ("u", 12, "buy", 60), ("v", 13, "buy", 61), ("x", 14, "buy", 500)])
    sides = [feeds.read_feed(spark, f"{tmp_path}/{n}", SCHEMA).select("k", "id", "ts") for n in "ab"]
    pairs = feeds.run_to_table(machines.followed_by(*sides, "k", "ts", "60 MINUTES", "10 minutes"), f"{tmp_path}/table", "append", f"{tmp_path}/checkpoint")
    assert shown(pairs, "id", "then_id") == [(1, 11), (1, 12), (2, 12), (3, None)]  # 4 may still be followed


def test_keys_are_admitted_once_over_restarts(spark, tmp_path):
    def run():
        return sorted((r["k"] for r in feeds.net_new_table(feeds.read_feed(spark, f"{tmp_path}/feed", SCHEMA), "k", f"{tmp_path}/table", f"{tmp_path}/checkpoint").collect()), key=str)

    feed(spark, f"{tmp_path}/feed", [("a", 1, "x", 0), ("a", 2, "x", 1), ("b", 3, "x", 2)])
    assert run() == ["a", "b"]
    feed(spark, f"{tmp_path}/feed", [("b", 4, "x", 9000), ("c", 5, "x", 0)])
    assert run() == ["a", "b", "c"] and run() == ["a", "b", "c"]
