"""Queries for the remaining functions, sources, sinks and feeds."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from signal_engine.catalogue import register, table
from signal_engine.functions import text as tx
from signal_engine.operators import enrichment, evidence, joins, ranking, scoring, sets, signals
from signal_engine.sources import readers, writers
from signal_engine.streaming import feeds


def customers(s, d):
    return table(s, d, "customer")


register(
    "title_query",
    "SELECT p_partkey, p_type FROM part WHERE (regexp_matches(p_type, '(?i)\\beconomy\\b') OR regexp_matches(p_type, '(?i)\\bstandard\\b')) AND NOT regexp_matches(p_name, '(?i)\\bhot\\b')",
)(lambda s, d: table(s, d, "part").where(tx.title_query("economy OR standard", F.col("p_type")) & tx.title_query("NOT hot", F.col("p_name"))).select("p_partkey", "p_type"))
register("email_permutations", "SELECT c_custkey, unnest(['ada.c' || c_custkey || '@x.com', 'ada@x.com', 'ac' || c_custkey || '@x.com', 'adac' || c_custkey || '@x.com', 'ada_c' || c_custkey || '@x.com', 'c' || c_custkey || '@x.com', 'adac@x.com']) AS email FROM customer")(
    lambda s, d: customers(s, d).select("c_custkey", F.explode(tx.email_permutations(F.lit("Ada"), F.concat(F.lit("C"), F.col("c_custkey").cast("string")), F.lit("x.com"))).alias("email"))
)
register("path_templates", "SELECT regexp_replace('/v1/orders/' || o_orderkey || '/lines', '/\\d+(/|$)', '/{NUM_ID}\\1', 'g') AS template, list_sort(list(DISTINCT o_orderstatus)) AS methods, list_sort(list(DISTINCT o_orderpriority)) AS statuses, count(*) AS calls FROM orders GROUP BY 1")(
    lambda s, d: readers.route_inventory(table(s, d, "orders").select(F.concat(F.lit("/v1/orders/"), F.col("o_orderkey").cast("string"), F.lit("/lines")).alias("path"), F.col("o_orderstatus").alias("method"), F.col("o_orderpriority").alias("status")))
)
register(
    "entity_frequency",
    "WITH u AS (SELECT regexp_extract(lower(url), 'https?://(?:www\\.)?([\\w.-]+)', 1) AS entity FROM pages WHERE regexp_matches(lower(url), 'https?://(?:www\\.)?([\\w.-]+)')), c AS (SELECT 'domain' AS kind, entity, count(*) AS \"count\" FROM u GROUP BY 2), r AS (SELECT *, row_number() OVER (ORDER BY \"count\" DESC, entity) AS rank FROM c) SELECT * FROM r WHERE rank <= 5",
)(lambda s, d: signals.entity_frequency(table(s, d, "pages"), "url"))
register("certificate_names", "SELECT DISTINCT 'cust' || (c_custkey % 40) AS slug FROM customer")(
    lambda s, d: readers.certificate_names(customers(s, d).select(F.concat(F.lit("*.cust"), (F.col("c_custkey") % 40).cast("string"), F.lit(".acme.io\nsandbox1.acme.io\nother.example.org")).alias("names")), "names", "acme.io")
)
register("work_queue", "SELECT event_id, value FROM events WHERE event_type = 'view' ORDER BY value DESC, event_id LIMIT 20")(
    lambda s, d: (lambda e: e.where(F.col("done").isNull()).orderBy(F.col("value").desc_nulls_last(), "event_id").limit(20).select("event_id", "value"))(table(s, d, "events").withColumn("done", F.when(F.col("event_type") != "view", F.lit(1))))
)


@register("bounded_sql", "SELECT n_nationkey, true AS truncated FROM nation WHERE n_nationkey < 25 ORDER BY n_nationkey LIMIT 10")
def bounded_sql(spark, sf_dir):
    table(spark, sf_dir, "nation").createOrReplaceTempView("bounded_sql_nation")
    rows, truncated = readers.bounded_sql(spark, "SELECT n_nationkey FROM bounded_sql_nation ORDER BY n_nationkey", 10)
    return rows.withColumn("truncated", F.lit(truncated))


register("table_digest")(lambda s, d: writers.table_digest(table(s, d, "nation")))
register(
    "fallback_match",
    "WITH dim AS (SELECT s_suppkey AS v, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey END AS strong, s_nationkey AS weak FROM supplier), a AS (SELECT strong, min(v) AS v FROM dim WHERE strong IS NOT NULL GROUP BY 1), b AS (SELECT weak, min(v) AS v FROM dim GROUP BY 1) SELECT c_custkey, coalesce(a.v, b.v) AS v FROM customer LEFT JOIN a ON a.strong = c_custkey LEFT JOIN b ON b.weak = c_nationkey",
)(
    lambda s, d: joins.match_with_fallback(
        customers(s, d).select("c_custkey", F.col("c_custkey").alias("strong"), F.col("c_nationkey").alias("weak")), table(s, d, "supplier").select(F.col("s_suppkey").alias("v"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_suppkey")).alias("strong"), F.col("s_nationkey").alias("weak")), "strong", "weak", "v"
    ).select("c_custkey", "v")
)
register(
    "judge_with_fallback",
    "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN least(1.0, p_size / 40.0::DOUBLE) ELSE 0.25 END AS judge, CASE WHEN p_partkey % 3 = 0 THEN 'model' ELSE 'fallback' END AS judge_source FROM part",
)(
    lambda s, d: joins.scores_with_fallback(table(s, d, "part").select(F.col("p_partkey").alias("id"), F.lit(0.25).alias("relevance")), table(s, d, "part").where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("id"), (F.col("p_size") / 40.0).alias("score"))).select("id", "judge", "judge_source")
)
register("stable_ids", "SELECT c_custkey, 'path-' || substr(sha256('[\"' || c_custkey || '\",\"' || c_mktsegment || '\"]'), 1, 16) AS id FROM customer")(
    lambda s, d: customers(s, d).select("c_custkey", evidence.stable_id("path-", F.col("c_custkey"), F.col("c_mktsegment")).alias("id"))
)
register("previous_state", "SELECT event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events")(
    lambda s, d: table(s, d, "events").select("event_id", F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("previous"))
)
register(
    "common_evidence",
    "SELECT source, url FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY phase) AS r FROM (SELECT 'a' AS source, 'x.com/' || (c_custkey % 50) AS url, 0 AS phase FROM customer WHERE c_custkey <= 40 UNION ALL SELECT 'b', 'x.com/' || (c_custkey % 50), 1 FROM customer)) WHERE r = 1",
)(
    lambda s, d: enrichment.common_evidence({"a": (customers(s, d).where("c_custkey <= 40").select(F.concat(F.lit("x.com/"), (F.col("c_custkey") % 50).cast("string")).alias("u")), {"url": "u"}), "b": (customers(s, d).select(F.concat(F.lit("x.com/"), (F.col("c_custkey") % 50).cast("string")).alias("u")), {"url": "u"})}).select("source", "url")
)
register(
    "receipts_replay",
    "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'run' WHEN event_id % 4 = 1 THEN 'answered' WHEN event_id % 4 = 2 THEN 'run' ELSE 'answered' END AS outcome FROM events",
)(
    lambda s, d: (
        lambda calls, receipts: (lambda r: r[0].select("event_id", F.lit("answered").alias("outcome")).unionByName(r[1].select("event_id", F.lit("run").alias("outcome"))))(enrichment.replay(calls, receipts, F.lit("2024-01-01 02:00:00").cast("timestamp")))
    )(
        table(s, d, "events").select("event_id", enrichment.call_key(F.lit("tool"), F.col("event_id").cast("string")).alias("call_key")),
        table(s, d, "events").where("event_id % 4 <> 0").select(enrichment.call_key(F.lit("tool"), F.col("event_id").cast("string")).alias("call_key"), F.lit("r").alias("response"), F.when(F.col("event_id") % 4 == 2, "2024-01-01 00:00:00").otherwise("2024-01-01 01:59:00").cast("timestamp").alias("made_at"), F.when(F.col("event_id") % 4 != 3, 600).alias("stale_after")),
    )
)
register("accepted_status", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'P') GROUP BY 1")(
    lambda s, d: table(s, d, "orders").where(enrichment.accepted(F.when(F.col("o_orderstatus") == "F", "valid").when(F.col("o_orderstatus") == "P", "valid_catch_all").otherwise("unknown"))).groupBy("o_orderstatus").agg(F.count("*").alias("n"))
)
register("icp_bands", "SELECT c_custkey, CASE WHEN c_acctbal / 100 >= 60 THEN 'high' WHEN c_acctbal / 100 >= 35 THEN 'medium' ELSE 'low' END AS band FROM customer")(
    lambda s, d: customers(s, d).select("c_custkey", scoring.icp_band(F.col("c_acctbal") / 100).alias("band"))
)
register("fallback_rank", "SELECT p_partkey, round(0.6 * p_size / 50.0 + 0.25 * (p_partkey % 10) / 10.0 + 0.15 * (p_partkey % 3) / 3.0, 6) AS score FROM part")(
    lambda s, d: table(s, d, "part").select("p_partkey", F.round(ranking.fallback_score(F.col("p_size") / 50.0, F.col("p_partkey") % 10 / 10.0, F.col("p_partkey") % 3 / 3.0), 6).alias("score"))
)
register(
    "grouping_sets", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS q FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus))"
)(lambda s, d: table(s, d, "lineitem").groupingSets([["l_returnflag"], ["l_linestatus"]], "l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("q")))
register("approx_distinct")(lambda s, d: table(s, d, "lineitem").agg(F.approx_count_distinct("l_partkey").alias("parts"), F.approx_percentile("l_quantity", 0.5).alias("median")))
register("row_error_isolation", "SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'not a number' END AS _error FROM events")(
    lambda s, d: feeds.isolate_errors(table(s, d, "events").withColumn("raw", F.when(F.col("event_id") % 10 == 0, "x").otherwise("1")), "n", F.expr("try_cast(raw AS INT)"), F.when(F.expr("try_cast(raw AS INT)").isNull(), F.lit("not a number"))).select("event_id", "_error")
)
register("costly_gate", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice * 2 END AS doubled FROM orders")(
    lambda s, d: sets.gated_costly(table(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), "o_orderkey", F.col("o_orderstatus") == "F", lambda r: r.select("o_orderkey", (F.col("o_totalprice") * 2).alias("doubled"))).select("o_orderkey", "doubled")
)
