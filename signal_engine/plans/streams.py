"""Streams over events with keyed state, late rows and joins, and change feeds over orders."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signal_engine.catalogue import register, table
from signal_engine.operators.ordered import shared_folder
from signal_engine.streaming import feeds, machines


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def _events_feed(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    base = table(spark, sf_dir, "events")
    return feeds.read_feed(spark, path or f"{sf_dir}/events.parquet*", base.schema, 10_000).withColumn("ts", F.col("ts").cast("timestamp"))


def _run(spark, df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    where = _folder(spark, name)
    with machines.keyed_state(spark):
        return feeds.run_to_table(df, f"{where}/table", mode, f"{where}/checkpoint")


@register("stream_net_new", "SELECT DISTINCT user_id FROM events")
def stream_net_new(spark, sf_dir):
    where = _folder(spark, "net-new")
    return feeds.net_new_table(_events_feed(spark, sf_dir), "user_id", f"{where}/table", f"{where}/checkpoint")


_MOVES = {
    ("new", "view"): "visitor", ("new", "signup"): "trial", ("visitor", "signup"): "trial", ("visitor", "error"): "new", ("trial", "click"): "active", ("trial", "error"): "blocked",
    ("active", "purchase"): "customer", ("active", "error"): "blocked", ("blocked", "signup"): "trial", ("blocked", "view"): "closed", ("dormant", "click"): "active", ("dormant", "view"): "trial",
    ("customer", "click"): "active", ("customer", "purchase"): "customer",
}
LIFECYCLE = machines.Machine("new", _MOVES, {"active": (6 * 3600, "dormant")}, frozenset({"closed"}))
_MOVES_SQL = ", ".join(f"('{s}', '{e}', '{t}')" for (s, e), t in _MOVES.items())
_LIFECYCLE_SQL = f"""
WITH RECURSIVE ev AS (SELECT user_id, event_id, event_type, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
mv(s, e, t) AS (VALUES {_MOVES_SQL}),
r AS (
  SELECT 0::BIGINT AS n, user_id, NULL::BIGINT AS event_id, NULL::VARCHAR AS before, 'new' AS state, NULL::TIMESTAMP AS since, NULL::TIMESTAMP AS due, NULL::TIMESTAMP AS at, true AS done FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL
  SELECT x.n, x.user_id, x.event_id, x.cur, coalesce(mv.t, x.cur), CASE WHEN mv.t IS NOT NULL THEN x.ts ELSE coalesce(x.due, x.since) END, x.due, x.ts, mv.t IS NOT NULL
  FROM (SELECT ev.*, r.since, CASE WHEN r.state = 'active' AND r.since + INTERVAL 6 HOUR <= ev.ts THEN 'dormant' ELSE r.state END AS cur, CASE WHEN r.state = 'active' AND r.since + INTERVAL 6 HOUR <= ev.ts THEN r.since + INTERVAL 6 HOUR END AS due FROM r JOIN ev ON ev.user_id = r.user_id AND ev.n = r.n + 1) x
  LEFT JOIN mv ON mv.s = x.cur AND mv.e = x.event_type
), ends AS (SELECT user_id, arg_max(state, n) AS state, arg_max(since, n) AS since FROM r GROUP BY 1),
outs AS (
  SELECT user_id, event_id, before AS from_state, state AS to_state, CASE WHEN done THEN 'completed' ELSE 'invalid' END AS status, CASE WHEN done THEN NULL WHEN before = 'closed' THEN 'terminal_state' ELSE 'forbidden_transition' END AS error, "at" FROM r WHERE n > 0
  UNION ALL SELECT user_id, NULL, 'active', 'dormant', 'timed_out', NULL, due FROM r WHERE due IS NOT NULL
  UNION ALL SELECT user_id, NULL, 'active', 'dormant', 'timed_out', NULL, since + INTERVAL 6 HOUR FROM ends WHERE state = 'active' AND since + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)
)
"""
_OUTPUTS = "user_id, event_id, from_state, to_state, status, error, \"at\", sha256(user_id || chr(10) || coalesce(event_id::VARCHAR, 'timeout:' || epoch_us(\"at\"))) AS transition_key"


def _lifecycle(spark, sf_dir):
    outputs = machines.run_machine(_events_feed(spark, sf_dir), LIFECYCLE, "user_id", "event_id", "event_type", "ts")
    return _run(spark, outputs, "machine").withColumn("at", F.col("at").cast("timestamp_ntz"))


register("state_machine", f"{_LIFECYCLE_SQL} SELECT {_OUTPUTS} FROM outs")(_lifecycle)


@register("state_handoffs", f"{_LIFECYCLE_SQL} SELECT to_state AS state, count(*) AS n, count(DISTINCT transition_key) AS keys FROM (SELECT {_OUTPUTS} FROM outs) WHERE status <> 'invalid' AND to_state <> 'closed' GROUP BY 1")
def state_handoffs(spark, sf_dir):
    return machines.handoffs(_lifecycle(spark, sf_dir), LIFECYCLE).groupBy("state").agg(F.count("*").alias("n"), F.count_distinct("transition_key").alias("keys"))


_TTLS = {"view": 0, "click": 86_400, "purchase": 7 * 86_400, "error": 2 * 86_400}  # signups never get stale


@register(
    "call_ttl",
    f"""WITH RECURSIVE tt(k, ttl) AS (VALUES {", ".join(f"('{k}', {v})" for k, v in _TTLS.items())}, ('signup', NULL)),
ev AS (SELECT event_id, user_id, event_type, ts, ttl, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events JOIN tt ON k = event_type),
r AS (
  SELECT n, event_id, user_id, event_type, 'run' AS action, ts AS ran_at FROM ev WHERE n = 1
  UNION ALL
  SELECT n, event_id, user_id, event_type, CASE WHEN fresh THEN 'reuse' ELSE 'run' END, CASE WHEN fresh THEN ran_at ELSE ts END
  FROM (SELECT ev.*, r.ran_at, ev.ttl IS NULL OR epoch_us(ev.ts) - epoch_us(r.ran_at) < ev.ttl::BIGINT * 1000000 AS fresh FROM r JOIN ev ON ev.user_id = r.user_id AND ev.event_type = r.event_type AND ev.n = r.n + 1)
) SELECT event_id, action, ran_at FROM r""",
)
def call_ttl(spark, sf_dir):
    ttl = F.create_map(*[F.lit(x) for pair in _TTLS.items() for x in pair])[F.col("event_type")]
    calls = machines.calls_with_ttl(_events_feed(spark, sf_dir), ["user_id", "event_type"], "event_id", "ts", ttl)
    return _run(spark, calls, "ttl").withColumn("ran_at", F.col("ran_at").cast("timestamp_ntz"))


_ARRIVALS = 4


def _arrival(ts: str) -> str:
    """The delivery an event comes with: by its day, one or two later for some; the same in Spark and SQL."""
    return f"least({_ARRIVALS - 1}, floor(({ts} % 30) * {_ARRIVALS} / 30) + CASE WHEN event_id % 49 = 0 THEN 2 WHEN event_id % 7 = 0 THEN 1 ELSE 0 END)"


@register(
    "late_events",
    f"""WITH a AS (SELECT event_id, ts, {_arrival("day(ts) - 1")} AS slot FROM events UNION ALL SELECT event_id, ts, {_ARRIVALS - 1} FROM events WHERE event_id % 10 = 0),
m AS (SELECT s.slot, (SELECT max(ts) FROM a WHERE a.slot < s.slot) - INTERVAL 2 DAY AS low FROM (SELECT DISTINCT slot FROM a) s)
SELECT event_id, ts, coalesce(ts < low, false) AS late, count(*) AS deliveries FROM a JOIN m USING (slot) GROUP BY 1, 2, 3""",
)
def late_events(spark, sf_dir):
    """Four deliveries, each a run of the stream that goes on from the checkpoint; some events come late, some again."""
    where, e = _folder(spark, "late"), table(spark, sf_dir, "events")
    slot = F.expr(_arrival("day(ts) - 1")).cast("int")
    again = e.where("event_id % 10 = 0").withColumn("slot", F.lit(_ARRIVALS - 1))
    e.withColumn("slot", slot).unionByName(again).write.partitionBy("slot").parquet(f"{where}/arrivals")
    arrivals = spark.read.parquet(f"{where}/arrivals")
    for k in range(_ARRIVALS):
        arrivals.where(F.col("slot") == k).drop("slot").write.parquet(f"{where}/feed/delivery={k}")
        machines.part_late_rows(_events_feed(spark, sf_dir, f"{where}/feed/*"), "ts", "2 days", where, f"{where}/checkpoint")
    schema = e.withColumn("ts", F.col("ts").cast("timestamp")).schema
    parts = [spark.read.schema(schema).parquet(f"{where}/{name}").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), F.lit(name == "late").alias("late")) for name in ("on_time", "late")]
    return parts[0].unionByName(parts[1]).groupBy("event_id", "ts", "late").agg(F.count("*").alias("deliveries"))


_VERSIONS_SQL = """WITH v AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version, o_orderstatus AS st, o_orderpriority AS pr FROM orders),
i AS (SELECT o_custkey, version, CASE WHEN st <> 'P' THEN st END AS s1, CASE WHEN st <> 'P' THEN pr END AS p1, lag(CASE WHEN st <> 'P' THEN st END) OVER w AS s0, lag(CASE WHEN st <> 'P' THEN pr END) OVER w AS p0 FROM v WINDOW w AS (PARTITION BY o_custkey ORDER BY version)),
c AS (SELECT *, CASE WHEN s0 IS NULL AND s1 IS NOT NULL THEN 'INSERT' WHEN s0 IS NOT NULL AND s1 IS NULL THEN 'DELETE' WHEN s0 IS NOT NULL AND (s0, p0) <> (s1, p1) THEN 'UPDATE' END AS operation FROM i)"""


def _changes(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    versions = table(spark, sf_dir, "orders").withColumn("version", F.row_number().over(w).cast("long"))
    return machines.change_feed(versions, "o_custkey", "version", ["o_orderstatus", "o_orderpriority"], F.col("o_orderstatus") == "P")


@register("change_feed", f"{_VERSIONS_SQL} SELECT o_custkey, version, operation, s0 AS status_before, p0 AS priority_before, s1 AS status_after, p1 AS priority_after FROM c WHERE operation IS NOT NULL")
def change_feed(spark, sf_dir):
    images = [F.col(f"{i}.{c}").alias(f"{n}_{i}") for i in ("before", "after") for n, c in (("status", "o_orderstatus"), ("priority", "o_orderpriority"))]
    return _changes(spark, sf_dir).select("o_custkey", "version", "operation", *images)


@register(
    "change_listener",
    f"{_VERSIONS_SQL} SELECT o_custkey, version, operation FROM c WHERE (operation = 'UPDATE' AND p0 NOT IN ('1-URGENT') AND p1 ILIKE '%urgent%') OR (operation = 'INSERT' AND s1 = 'F') OR (operation = 'DELETE' AND p0 IN ('1-URGENT', '2-HIGH'))",
)
def change_listener(spark, sf_dir):
    """Three listeners on one feed: rows that become urgent, rows that appear finished, urgent rows that go."""
    changes = _changes(spark, sf_dir)
    urgent = machines.listen(changes, ["UPDATE"], {"o_orderpriority": {"notIn": ["1-URGENT"]}}, {"o_orderpriority": {"ilike": "%urgent%"}})
    finished = machines.listen(changes, ["INSERT"], None, {"o_orderstatus": {"eq": "F"}})
    gone = machines.listen(changes, ["DELETE"], {"o_orderpriority": {"in": ["1-URGENT", "2-HIGH"]}})
    return urgent.unionByName(finished).unionByName(gone).select("o_custkey", "version", "operation")


@register(
    "click_to_purchase",
    """WITH c AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'click'), p AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'purchase'),
w AS (SELECT least((SELECT max(ts) FROM c), (SELECT max(ts) FROM p)) - INTERVAL 1 HOUR AS low)
SELECT c.user_id, c.event_id, p.event_id AS then_event_id, round((epoch_us(p.ts) - epoch_us(c.ts)) / 1000000.0, 3) AS seconds FROM c LEFT JOIN p ON p.user_id = c.user_id AND p.ts BETWEEN c.ts AND c.ts + INTERVAL 6 HOUR
WHERE p.event_id IS NOT NULL OR c.ts + INTERVAL 6 HOUR < (SELECT low FROM w)""",
)
def click_to_purchase(spark, sf_dir):
    sides = [_events_feed(spark, sf_dir).where(F.col("event_type") == kind).select("user_id", "event_id", "ts") for kind in ("click", "purchase")]
    pairs = _run(spark, machines.followed_by(*sides, "user_id", "ts", "6 HOURS"), "followed")
    return pairs.select("user_id", "event_id", "then_event_id", F.round((F.unix_micros("then_ts") - F.unix_micros("ts")) / 1e6, 3).alias("seconds"))


@register(
    "sliding_counts",
    "SELECT event_type, start, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR]) AS start FROM events) GROUP BY 1, 2",
)
def sliding_counts(spark, sf_dir):
    counts = machines.sliding(_events_feed(spark, sf_dir), "ts", "12 hours", "6 hours", "event_type").select("event_type", F.col("window.start").alias("start"), F.col("count").alias("n"))
    return _run(spark, counts, "sliding", "complete").withColumn("start", F.col("start").cast("timestamp_ntz"))
