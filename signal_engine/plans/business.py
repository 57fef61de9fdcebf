"""Joins, times, rankings, scores, evidence, portfolios and enrichment over the star schema and events."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from signal_engine.catalogue import register, table
from signal_engine.functions import dates, variant
from signal_engine.functions import text as tx
from signal_engine.operators import enrichment, evidence, joins, portfolio, ranking, scoring

AS_OF = "1998-08-02"


def as_of():
    return F.to_date(F.lit(AS_OF))


def events(s, d):
    return table(s, d, "events")


# joins
_SPANS = "sp AS (SELECT o_custkey AS id, c_nationkey AS k, min(o_orderdate)::DATE AS st, max(o_orderdate)::DATE AS en FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"


def _spans(s, d):
    o = table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.groupBy(F.col("o_custkey").alias("id"), F.col("c_nationkey").alias("k")).agg(F.min("o_orderdate").cast("date").alias("start"), F.max("o_orderdate").cast("date").alias("end")).withColumn("is_current", F.lit(False))


register(
    "interval_overlap",
    f"WITH {_SPANS} SELECT a.k, a.id AS left_id, b.id AS right_id, greatest(a.st, b.st) AS overlap_start, least(a.en, b.en, DATE '{AS_OF}') AS overlap_end FROM sp a JOIN sp b ON a.k = b.k AND a.id < b.id WHERE greatest(a.st, b.st) <= least(a.en, b.en, DATE '{AS_OF}')",
)(lambda s, d: joins.interval_overlap(_spans(s, d), _spans(s, d), "k", as_of(), once=True))
register(
    "role_proximity",
    f"WITH {_SPANS}, x AS (SELECT id, k, st, CASE WHEN id % 3 = 0 THEN NULL ELSE en END AS en, id % 6 = 0 AS cur FROM sp), y AS (SELECT *, least(coalesce(en, CASE WHEN cur THEN DATE '{AS_OF}' END), DATE '{AS_OF}') AS e FROM x) "
    "SELECT a.k, a.id AS left_id, b.id AS right_id, CASE WHEN (a.en IS NULL AND NOT a.cur) OR (b.en IS NULL AND NOT b.cur) THEN 'undated' WHEN greatest(a.st, b.st) <= least(a.e, b.e) THEN 'overlap' ELSE 'non_overlapping' END AS proximity FROM y a JOIN y b ON a.k = b.k WHERE a.id < b.id",
)(
    lambda s, d: (lambda x: joins.role_proximity(x, x, "k", as_of(), once=True))(
        _spans(s, d).withColumn("end", F.when(F.col("id") % 3 != 0, F.col("end"))).withColumn("is_current", F.col("id") % 6 == 0)
    )
)
register("lookup_join", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")(
    lambda s, d: joins.lookup(table(s, d, "customer"), table(s, d, "nation").withColumnRenamed("n_nationkey", "c_nationkey"), "c_nationkey").select("c_custkey", "n_name")
)
register("fk_violations", "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 40)")(
    lambda s, d: joins.remap(table(s, d, "lineitem").select("l_orderkey", "l_partkey"), "l_partkey", table(s, d, "part").where("p_size < 40").select(F.col("p_partkey").alias("alias"), F.col("p_partkey").alias("canonical")))[1].select("l_orderkey", "l_partkey")
)
register(
    "array_remap",
    "SELECT o_custkey, list_sort(list_distinct(list(CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey // 2 ELSE o_orderkey END))) AS ids FROM orders GROUP BY 1",
)(
    lambda s, d: (lambda o: joins.remap_array(o.groupBy("o_custkey").agg(F.collect_list("o_orderkey").alias("ids")), "o_custkey", "ids", table(s, d, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("alias"), F.floor(F.col("o_orderkey") / 2).cast("long").alias("canonical"))))(
        table(s, d, "orders")
    )
)
register(
    "evidence_errors",
    "WITH e AS (SELECT o_orderkey AS edge_id, o_custkey AS ow, o_custkey % 11 AS tg, o_orderkey AS ev FROM orders) SELECT edge_id, CASE WHEN ev % 5 = 0 THEN ['unknown_evidence'] WHEN ev % 7 = 0 THEN ['no_interaction'] WHEN ev % 3 = 0 AND ow <> tg THEN ['participants_missing'] ELSE [] END AS errors FROM e",
)(
    lambda s, d: (
        lambda o: joins.evidence_errors(
            o.select(F.col("o_orderkey").alias("edge_id"), F.col("o_custkey").alias("owner_id"), (F.col("o_custkey") % 11).alias("target_id"), F.array("o_orderkey").alias("evidence_ids")),
            o.where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("evidence_id")),
            o.where("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("evidence_id"), F.when(F.col("o_orderkey") % 3 == 0, F.array("o_custkey")).otherwise(F.array("o_custkey", F.col("o_custkey") % 11)).alias("participant_ids")),
        )
    )(table(s, d, "orders"))
)
register("lookup_list", "SELECT n_nationkey, x.keys FROM nation LEFT JOIN (SELECT s_nationkey, list_sort(list(s_suppkey)) AS keys FROM supplier GROUP BY 1) x ON n_nationkey = s_nationkey")(
    lambda s, d: joins.lookup_list(table(s, d, "nation"), table(s, d, "supplier").withColumnRenamed("s_nationkey", "n_nationkey"), "n_nationkey", ["s_suppkey"], "m").select("n_nationkey", F.col("m.s_suppkey").alias("keys"))
)
register(
    "cost_receipt_split",
    "WITH p AS (SELECT l_returnflag AS program, l_suppkey AS tool, count(*) AS attempted FROM lineitem GROUP BY 1, 2), x AS (SELECT program, tool, attempted::DOUBLE / sum(attempted) OVER (PARTITION BY tool) AS share FROM p) SELECT program, round(sum(share * s_acctbal), 4) AS credits FROM x JOIN supplier ON tool = s_suppkey GROUP BY 1",
)(
    lambda s, d: joins.proportional_split(
        table(s, d, "lineitem").groupBy(F.col("l_returnflag").alias("program"), F.col("l_suppkey").alias("tool")).agg(F.count("*").alias("attempted")), table(s, d, "supplier").select(F.col("s_suppkey").alias("tool"), F.col("s_acctbal").alias("credits"))
    ).select("program", F.round("credits", 4).alias("credits"))
)
register(
    "golden_cases",
    "WITH e AS (SELECT c_custkey AS case_id, c_mktsegment AS v FROM customer WHERE c_custkey % 2 = 0), a AS (SELECT c_custkey AS case_id, CASE WHEN c_custkey % 5 = 0 THEN 'X' ELSE c_mktsegment END AS v FROM customer WHERE c_custkey % 3 = 0) SELECT coalesce(e.case_id, a.case_id) AS case_id, CASE WHEN a.case_id IS NULL THEN 'missing' WHEN e.case_id IS NULL THEN 'unexpected' WHEN e.v = a.v THEN 'match' ELSE 'mismatch' END AS status FROM e FULL JOIN a ON e.case_id = a.case_id",
)(
    lambda s, d: joins.golden_cases(
        table(s, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("case_id"), F.col("c_mktsegment").alias("value")),
        table(s, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("case_id"), F.when(F.col("c_custkey") % 5 == 0, "X").otherwise(F.col("c_mktsegment")).alias("value")),
    )
)
register("as_of_join", "SELECT e.event_id, (SELECT arg_max(p.value, p.ts) FROM events p WHERE p.event_type = 'purchase' AND p.user_id = e.user_id AND p.ts <= e.ts) AS price FROM events e WHERE e.event_type = 'click'")(
    lambda s, d: joins.as_of_join(
        events(s, d).where("event_type = 'click'").select("event_id", "user_id", "ts"), events(s, d).where("event_type = 'purchase'").select("user_id", "ts", F.col("value").alias("price")), "user_id", "ts", "price"
    ).select("event_id", "price")
)
register(
    "semi_anti", "SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') THEN 'semi' ELSE 'anti' END AS side FROM customer"
)(
    lambda s, d: (lambda c, o: c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", F.lit("semi").alias("side")).unionByName(c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", F.lit("anti").alias("side"))))(
        table(s, d, "customer"), table(s, d, "orders").where("o_orderstatus = 'F'").select("o_custkey")
    )
)

# times
register(
    "freshness_buckets",
    f"WITH o AS (SELECT CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE date_diff('day', o_orderdate::DATE, DATE '{AS_OF}') END AS a FROM orders) SELECT CASE WHEN a IS NULL THEN 'unknown' WHEN a < 0 THEN 'future' WHEN a <= 30 THEN '0-30' WHEN a <= 90 THEN '31-90' WHEN a <= 365 THEN '91-365' ELSE '>365' END AS bucket, count(*) AS n FROM o GROUP BY 1",
)(lambda s, d: table(s, d, "orders").groupBy(dates.freshness_bucket(F.when(F.col("o_orderkey") % 50 != 0, F.col("o_orderdate").cast("date")), as_of()).alias("bucket")).agg(F.count("*").alias("n")))
register(
    "recency_boost",
    f"WITH o AS (SELECT o_orderkey, date_diff('day', o_orderdate::DATE, DATE '{AS_OF}') AS a FROM orders) SELECT o_orderkey, round(CASE WHEN a >= 1095 THEN 0.5 WHEN a <= 30 THEN 1.0 ELSE 1.0 - 0.5 * (a - 30)::DOUBLE / 1065 END, 6) AS boost FROM o",
)(lambda s, d: table(s, d, "orders").select("o_orderkey", F.round(dates.recency_boost(F.col("o_orderdate").cast("date"), as_of()), 6).alias("boost")))
register(
    "freshness_modes",
    "WITH e AS (SELECT event_id, greatest(0, 1 - greatest(0, epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts))::DOUBLE / 86400000000 / 30) AS st FROM events) SELECT event_id, round(st, 6) AS strict, round(st * 0.8 + 0.1, 6) AS balanced, round(st * 0.6 + 0.4, 6) AS evergreen FROM e",
)(
    lambda s, d: events(s, d).select(
        "event_id", *[F.round(dates.freshness(F.col("ts"), F.lit("2024-02-01").cast("timestamp"), m), 6).alias(n) for m, n in (("strict_recent", "strict"), ("balanced_recent", "balanced"), ("evergreen_ok", "evergreen"))]
    )
)
register(
    "date_formats",
    "SELECT o_orderkey, o_orderdate::DATE AS parsed, CASE o_orderkey % 3 WHEN 0 THEN year(o_orderdate) * 100 + month(o_orderdate) WHEN 1 THEN year(o_orderdate) * 100 + month(o_orderdate) ELSE year(o_orderdate) * 100 END AS start_key FROM orders",
)(
    lambda s, d: table(s, d, "orders")
    .withColumn("x", F.when(F.col("o_orderkey") % 4 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(F.col("o_orderkey") % 4 == 1, F.date_format("o_orderdate", "d MMM yyyy")).when(F.col("o_orderkey") % 4 == 2, F.date_format("o_orderdate", "MM/dd/yyyy")).otherwise(F.date_format("o_orderdate", "MMMM d, yyyy")))
    .withColumn("y", F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "MM-yyyy")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy-MM")).otherwise(F.date_format("o_orderdate", "yyyy")))
    .select("o_orderkey", dates.parse_date(F.col("x")).alias("parsed"), dates.start_key(F.col("y")).cast("long").alias("start_key"))
)
register("rolling_24h_cap", "SELECT event_id, count(*) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS recent FROM events")(
    lambda s, d: ranking.rolling_count(events(s, d), "user_id", "ts", F.col("event_type") == "purchase").select("event_id", "recent")
)
register("rolling_capacity", "SELECT event_id, count(*) FILTER (event_type IN ('purchase', 'click')) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) < 4 AS allowed FROM events")(
    lambda s, d: ranking.capacity(events(s, d), "user_id", "ts", F.col("event_type") == "purchase", F.col("event_type") == "click", 4).select("event_id", "allowed")
)
register("attempt_number", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt FROM events")(lambda s, d: ranking.attempts(events(s, d), "user_id", "ts", "event_id").select("event_id", "attempt"))


@register(
    "running_budget",
    """WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
    r AS (SELECT o_custkey, o_orderkey, o_totalprice, n, o_totalprice <= 500000 AS admitted, CASE WHEN o_totalprice <= 500000 THEN o_totalprice ELSE 0.0 END AS spent FROM o WHERE n = 1
      UNION ALL SELECT o.o_custkey, o.o_orderkey, o.o_totalprice, o.n, r.spent + o.o_totalprice <= 500000, r.spent + CASE WHEN r.spent + o.o_totalprice <= 500000 THEN o.o_totalprice ELSE 0.0 END
      FROM r JOIN o ON o.o_custkey = r.o_custkey AND o.n = r.n + 1)
    SELECT o_custkey, o_orderkey, o_totalprice, admitted FROM r""",
)
def running_budget(spark, sf_dir):
    """Greedy admission that skips what does not fit."""
    return ranking.greedy_budget(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", "o_totalprice", 500000.0)


# rankings
register("rank_accounts", "SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer")(lambda s, d: ranking.rank_all(table(s, d, "customer").select("c_custkey", "c_acctbal"), F.desc("c_acctbal"), "c_custkey").select("c_custkey", "rank"))
register("top_n_per_group", "SELECT o_custkey, o_orderkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3")(
    lambda s, d: ranking.top_per_group(table(s, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", 3, F.desc("o_totalprice"), "o_orderkey").select("o_custkey", "o_orderkey", "rank")
)
register("best_per_group", "SELECT o_custkey, arg_max(o_orderkey, o_orderdate::VARCHAR || lpad((100000000 - o_orderkey)::VARCHAR, 12, '0')) AS latest FROM orders GROUP BY 1")(
    lambda s, d: ranking.latest(table(s, d, "orders"), "o_custkey", F.col("o_orderkey"), F.struct("o_orderdate", -F.col("o_orderkey")))
)
register("top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")(lambda s, d: table(s, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25))

_ROUTES = """r AS (SELECT 'long' AS route, doc_id AS item, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents
  UNION ALL SELECT 'short', doc_id, row_number() OVER (ORDER BY n_chars, doc_id) FROM documents
  UNION ALL SELECT 'hash', doc_id, row_number() OVER (ORDER BY (doc_id * 7919) % 1009, doc_id) FROM documents), t AS (SELECT * FROM r WHERE rank <= 40)"""


def _routes(s, d):
    docs = table(s, d, "documents").select("doc_id", "n_chars")
    top = lambda name, *o: docs.orderBy(*o).limit(40).select(F.lit(name).alias("route"), F.col("doc_id").alias("item"), F.row_number().over(Window.orderBy(*o)).alias("rank"))
    return top("long", F.desc("n_chars"), "doc_id").unionByName(top("short", "n_chars", "doc_id")).unionByName(top("hash", F.col("doc_id") * 7919 % 1009, "doc_id"))


register(
    "rrf_fusion",
    f"WITH {_ROUTES}, w AS (SELECT *, CASE route WHEN 'long' THEN 2.0 ELSE 1.0 END::DOUBLE AS w FROM t) SELECT item, round(sum(w / (60 + rank)), 9) AS score, round(sum(w / (60 + rank)) * 61 / 4, 9) AS normalized, min(rank) AS best_rank FROM w GROUP BY item",
)(lambda s, d: ranking.reciprocal_rank_fusion(_routes(s, d), {"long": 2.0}).select("item", F.round("score", 9).alias("score"), F.round("normalized", 9).alias("normalized"), "best_rank"))
register(
    "diversity_cap",
    "WITH a AS (SELECT doc_id, source, lang, n_chars / 10000.0::DOUBLE AS sc FROM documents), b AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY sc DESC, doc_id) <= 2 AND sc >= 0.25 AS reserved FROM a) SELECT doc_id, reserved FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY reserved DESC, sc DESC, doc_id) AS x FROM b) WHERE x <= 3",
)(lambda s, d: ranking.diversify(table(s, d, "documents").select("doc_id", "source", "lang", (F.col("n_chars") / 10000.0).alias("sc")), "lang", "source", "sc", "doc_id").select("doc_id", "reserved"))
register(
    "engagement_norm",
    "WITH e AS (SELECT event_id, event_type, CASE WHEN value > 0 THEN ln(1 + value) END AS g FROM events), m AS (SELECT *, min(g) OVER (PARTITION BY event_type) AS lo, max(g) OVER (PARTITION BY event_type) AS hi FROM e) SELECT event_id, round(CASE WHEN g IS NULL THEN NULL WHEN hi = lo THEN 0.5 ELSE (g - lo) / (hi - lo) END, 6) AS engagement FROM m",
)(lambda s, d: ranking.normalize_engagement(events(s, d), "event_type", "value").select("event_id", F.round("engagement", 6).alias("engagement")))


@register(
    "rerank_blend",
    "WITH d AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE (doc_id % 10) / 10.0::DOUBLE END AS m, (doc_id % 7) / 7.0::DOUBLE AS r, doc_id % 11 = 0 AS hf, doc_id % 5 = 0 AS em FROM documents), j AS (SELECT *, coalesce(m, r) AS jd FROM d), x AS (SELECT *, (0.6 * jd + 0.2 * 0.5 + 0.1 * 0.5 + 0.05 * 0.6) * CASE WHEN jd < 0.2 THEN 0.3 ELSE 1 END - CASE WHEN em THEN 0.45 ELSE 0 END AS s FROM j) SELECT doc_id, NOT hf AS eligible, round(CASE WHEN hf THEN 0 ELSE greatest(0, least(1, s)) END, 6) AS final FROM x",
)
def rerank_blend(spark, sf_dir):
    i, none = F.col("doc_id"), F.lit(None).cast("double")
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", F.when(i % 4 != 0, i % 10 * 10.0).alias("model"), (i % 7 / 7.0).alias("relevance"), F.lit(0.5).alias("rrf"), none.alias("freshness"), none.alias("engagement"), none.alias("source_quality"),
        none.alias("verification"), none.alias("corroboration"), (i % 11 == 0).alias("hard_fail"), (i % 5 == 0).alias("entity_miss"),
    )
    return ranking.rerank(rows).select("doc_id", "eligible", F.round("final", 6).alias("final"))


# scores
register(
    "account_score",
    "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CASE WHEN event_id % 2 = 0 THEN 25 ELSE 0 END WHEN event_id % 3 = 1 THEN least(25, event_id % 40) ELSE 0 END AS points FROM events",
)(
    lambda s, d: events(s, d)
    .withColumn("j", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"fit": '), F.when(F.col("event_id") % 2 == 0, "true").otherwise("false"), F.lit("}"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"fit": '), (F.col("event_id") % 40).cast("string"), F.lit("}"))).otherwise('{"fit": "yes"}'))
    .select("event_id", scoring.component(variant.parse(F.col("j")), "$.fit", 25).alias("points"))
)
register(
    "segment_decision",
    "WITH l AS (SELECT unnest([1, 2, 2]) AS k, unnest(['customer', 'vendor', 'partner']) AS reason, unnest([1, 2, 3]) AS p), b AS (SELECT k, arg_min(reason, p) AS reason FROM l GROUP BY k) SELECT c_custkey, reason AS exclusion_reason, CASE WHEN reason IS NOT NULL THEN 'exclude' WHEN c_acctbal >= 5000 THEN 'include' WHEN c_acctbal >= 1000 THEN 'review' ELSE 'exclude' END AS decision FROM customer LEFT JOIN b ON c_nationkey = k",
)(
    lambda s, d: scoring.exclusion_reason(table(s, d, "customer"), "c_nationkey", s.createDataFrame([(1, "customer", 1), (2, "vendor", 2), (2, "partner", 3)], "domain int, reason string, precedence int")).select(
        "c_custkey", "exclusion_reason", scoring.decision(F.col("c_acctbal"), F.col("exclusion_reason"), 5000, 1000).alias("decision")
    )
)


@register(
    "warm_path_segments",
    """WITH p AS (SELECT c_custkey AS k, c_custkey % 5 = 0 AS di, c_custkey % 3 = 0 AS wo, c_custkey % 4 = 0 AS sc, c_custkey % 2 = 0 AS ri, c_custkey % 7 = 0 AS inv, ['low','medium','high','none'][c_custkey % 4 + 1] AS rel, c_custkey % 13 = 0 AS err, c_custkey % 17 = 0 AS prox FROM customer),
    t AS (SELECT *, (di::INT * 60 + wo::INT * 30 + sc::INT * 15 + ri::INT * 7 + inv::INT * 3 + CASE rel WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 0 END)::BIGINT AS total FROM p)
    SELECT k, total, CASE WHEN NOT err AND total >= 31 AND rel <> 'none' AND (di OR wo) THEN 'strong_warm_intro' WHEN err OR di OR wo OR prox OR ((sc OR ri) AND total >= 10) THEN 'review_warm_intro' ELSE 'no_strong_path' END AS segment FROM t""",
)
def warm_path_segments(spark, sf_dir):
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(
        k.alias("k"), (k % 5 == 0).alias("direct_intro"), (k % 3 == 0).alias("work_overlap"), (k % 4 == 0).alias("school_city_community"), (k % 2 == 0).alias("role_industry"), (k % 7 == 0).alias("investor"),
        F.element_at(F.array(*[F.lit(x) for x in ("low", "medium", "high", "none")]), (k % 4 + 1).cast("int")).alias("relationship"), F.when(k % 13 == 0, F.array(F.lit("e"))).otherwise(F.array().cast("array<string>")).alias("errors"),
        F.when(k % 17 == 0, F.array(F.lit("company_proximity:acme"))).otherwise(F.array().cast("array<string>")).alias("reasons"),
    )
    scored = rows.withColumn("total", scoring.path_score().cast("long"))
    return scored.select("k", "total", scoring.path_segment(F.col("total"), 31, 10).alias("segment"))


@register(
    "contact_priority",
    """WITH p AS (SELECT s_suppkey AS k, s_suppkey % 13 AS r, s_suppkey % 200 AS t, s_suppkey % 61 AS ch FROM supplier), l AS (SELECT *, CASE WHEN r <= 4 THEN 'exec' WHEN r <= 6 THEN 'director' WHEN r <= 10 THEN 'manager' ELSE 'ic' END AS lv FROM p)
    SELECT k, lv AS level, CASE lv WHEN 'exec' THEN 40 WHEN 'director' THEN 25 WHEN 'manager' THEN 10 ELSE 0 END + CASE WHEN k % 2 = 0 THEN 25 ELSE 0 END + CASE WHEN k % 3 = 0 THEN 10 ELSE 0 END + CASE WHEN k % 5 = 0 THEN 30 ELSE 0 END
      + CASE WHEN lv = 'exec' AND t < 90 THEN 20 ELSE 0 END + CASE WHEN t < 30 THEN 10 ELSE 0 END + CASE WHEN ch >= 45 THEN 15 WHEN ch >= 30 THEN 8 ELSE 0 END + CASE WHEN lv IN ('manager', 'director') AND t < 180 THEN -5 ELSE 0 END AS priority,
      CASE WHEN ch >= 45 THEN 'high' WHEN ch >= 30 THEN 'medium' WHEN ch >= 15 THEN 'low' ELSE 'unknown' END AS champion FROM l""",
)
def contact_priority(spark, sf_dir):
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(k.alias("k"), tx.seniority_level(k % 13).alias("level"), (k % 200).alias("t"), (k % 61).alias("ch"))
    p = scoring.contact_priority(F.col("level"), F.col("k") % 2 == 0, F.col("k") % 3 == 0, F.col("k") % 5 == 0, F.col("t"), F.col("ch"))
    return rows.select("k", "level", p.alias("priority"), scoring.champion_band(F.col("ch")).alias("champion"))


@register(
    "accuracy_flags_action",
    f"""WITH c AS (SELECT o_orderkey AS k, o_orderdate::DATE AS pa, o_orderkey % 4 = 0 AS changed, CASE o_orderkey % 5 WHEN 0 THEN 'valid' WHEN 1 THEN 'catch-all' WHEN 2 THEN 'invalid' WHEN 3 THEN '' ELSE 'valid' END AS v, date_diff('day', o_orderdate::DATE, DATE '{AS_OF}') AS age FROM orders),
    f AS (SELECT k, list_sort(list_filter([CASE WHEN changed THEN 'job_changed' END, CASE WHEN k % 6 = 0 THEN 'missing_email' END, CASE WHEN age > 30 THEN 'profile_stale' END, 'email_verification_missing',
      CASE WHEN k % 3 = 0 THEN 'identity_unconfirmed' END, CASE WHEN v = 'catch-all' THEN 'catch_all_not_corroborated' END, CASE WHEN v = 'invalid' THEN 'email_invalid' END, CASE WHEN v = '' THEN 'email_validation_unknown' END], lambda x: x IS NOT NULL)) AS flags,
      CASE v WHEN 'catch-all' THEN 'HIGH' WHEN 'invalid' THEN 'HIGH' WHEN '' THEN 'MED' ELSE 'LOW' END AS email_risk FROM c)
    SELECT k, array_to_string(flags, ',') AS flags, email_risk, CASE WHEN list_contains(flags, 'job_changed') THEN 'REMOVE / RE-TARGET' WHEN list_contains(flags, 'catch_all_not_corroborated') THEN 'REVIEW' ELSE 'VERIFY' END AS action FROM f""",
)
def accuracy_flags_action(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        k.alias("k"), F.concat(F.lit("p"), k.cast("string")).alias("person"), F.when(k % 6 == 0, "").otherwise(F.concat(F.lit("u"), k.cast("string"), F.when(k % 4 == 0, "@new.com").otherwise("@acme.com"))).alias("email"), F.lit("Acme").alias("company"),
        F.when(k % 4 == 0, "Newco").otherwise("Acme").alias("current_company"), F.lit("Engineer").alias("title"), F.when(k % 4 == 0, "new.com").otherwise("acme.com").alias("domain"), F.lit("").alias("linkedin"), F.col("o_orderdate").cast("date").alias("profile_at"),
        F.lit(None).cast("date").alias("verified_at"), F.when(k % 3 == 0, "none").otherwise("match").alias("identity"), F.when(k % 5 == 1, "catch-all").when(k % 5 == 2, "invalid").when(k % 5 == 3, "").otherwise("valid").alias("validation"), F.lit(0).alias("corroboration"), F.lit("").alias("confidence"),
    )
    # the changed rows' address stands at the old company's domain only where both are equal; here both moved
    rows = rows.withColumn("email", F.when(F.col("k") % 4 == 0, F.when(F.col("k") % 6 == 0, "").otherwise(F.concat(F.lit("u"), F.col("k").cast("string"), F.lit("@acme.com")))).otherwise(F.col("email"))).withColumn("domain", F.when(F.col("k") % 4 == 0, "").otherwise(F.col("domain")))
    return scoring.audit_contacts(rows, as_of()).select("k", F.array_join("flags", ",").alias("flags"), "email_risk", "action")


register(
    "golden_record",
    "SELECT c_custkey, coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END, 'NONE') AS seg, c_custkey % 2 = 0 AS seg_disagree FROM customer",
)(
    lambda s, d: table(s, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise("").alias("a"), F.lit("NONE").alias("b")).select("c_custkey", *scoring.golden_record({"seg": ["a", "b"]}))
)
register("source_confidence", "SELECT user_id, CASE WHEN count(DISTINCT event_type) > 3 THEN 'LOW' WHEN count(DISTINCT event_id % 3) >= 2 THEN 'HIGH' ELSE 'MEDIUM' END AS confidence FROM (SELECT user_id, event_id, event_type FROM events) GROUP BY 1".replace("count(DISTINCT event_type) > 3", "count(DISTINCT event_type) > 1"))(
    lambda s, d: scoring.source_confidence(events(s, d).withColumn("src", F.col("event_id") % 3), "user_id", "src", "event_type")
)


@register(
    "fact_gates",
    """WITH f AS (SELECT user_id AS item, event_type AS field, (floor(value) % 2)::BIGINT::VARCHAR AS v FROM events),
    p AS (SELECT item, field, count(DISTINCT v) AS n, min(v) AS v FROM f GROUP BY 1, 2),
    g AS (SELECT item, list_sort(list_concat(list_concat(list_filter(list(CASE WHEN n > 1 THEN 'conflict:' || field END), lambda x: x IS NOT NULL), list_filter(list(CASE WHEN field = 'view' AND v <> '1' THEN 'not_allowed:view' END), lambda x: x IS NOT NULL)), list_filter(['missing:click', 'missing:purchase'], lambda x: NOT list_contains(list(field), x[9:])))) AS reasons, bool_or(n > 1) AS conflict FROM p GROUP BY item)
    SELECT item, CASE WHEN conflict THEN 'conflict' WHEN len(reasons) > 0 THEN 'rejected' ELSE 'eligible' END AS status, array_to_string(reasons, ',') AS reasons FROM g""",
)
def fact_gates(spark, sf_dir):
    facts = events(spark, sf_dir).select(F.col("user_id").alias("item"), F.col("event_type").alias("field"), (F.floor("value") % 2).cast("string").alias("value"))
    return scoring.fact_gates(facts, ["click", "purchase"], {"view": ["1"]}).withColumn("reasons", F.array_join("reasons", ","))


register(
    "claim_status",
    "WITH p AS (SELECT user_id AS claim, count(*) AS n, count(DISTINCT event_type) AS vs, count(DISTINCT event_id % 2) AS sr, max(ts)::DATE AS l FROM events GROUP BY 1), r AS (SELECT claim, CASE WHEN n = 0 THEN 'no_evidence' WHEN vs > 1 THEN 'contradiction' WHEN n < 2 THEN 'too_little_evidence' WHEN sr < 2 THEN 'not_independent' WHEN date_diff('day', l, DATE '2026-01-01') > 365 THEN 'too_old' ELSE '' END AS reason FROM p) SELECT claim, CASE WHEN reason = '' THEN 'verified' ELSE 'abstained' END AS status, reason FROM r",
)(lambda s, d: scoring.claim_status(events(s, d).select(F.col("user_id").alias("claim"), F.col("event_type").alias("value"), (F.col("event_id") % 2).alias("source"), F.col("ts").cast("date").alias("observed")), F.to_date(F.lit("2026-01-01"))))
register(
    "contradiction_flags",
    "WITH p AS (SELECT user_id AS identity, event_id % 3 AS claim, event_type AS value, count(*) AS n FROM events GROUP BY 1, 2, 3) SELECT identity, claim, value, evidence, contradiction FROM (SELECT identity, claim, value, n AS evidence, count(*) OVER w > 1 AS contradiction, row_number() OVER (PARTITION BY identity, claim ORDER BY n DESC, value) AS r FROM p WINDOW w AS (PARTITION BY identity, claim)) WHERE r = 1",
)(lambda s, d: scoring.ledger_merge(events(s, d).select(F.col("user_id").alias("identity"), (F.col("event_id") % 3).alias("claim"), F.col("event_type").alias("value"))))
register(
    "gap_merge",
    "WITH p AS (SELECT c_custkey AS r, 'a' || (c_custkey % 2) AS c, c_mktsegment AS v, c_custkey % 3 = 0 AS ok, 1.0::DOUBLE AS cr FROM customer), e AS (SELECT c_custkey AS r, 'a' || (c_custkey % 2) AS c, 'X' AS v, true AS ok, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 2.0::DOUBLE END AS cr FROM customer WHERE c_custkey % 2 = 0) SELECT p.r AS \"row\", p.c AS claim, CASE WHEN p.ok THEN p.v WHEN e.ok THEN e.v ELSE p.v END AS value, p.ok OR coalesce(e.ok, false) AS verified, CASE WHEN e.r IS NULL THEN p.cr ELSE p.cr + e.cr END AS credits FROM p LEFT JOIN e ON p.r = e.r AND p.c = e.c",
)(
    lambda s, d: (lambda c: scoring.gap_merge(c.select("row", "claim", F.col("c_mktsegment").alias("value"), (F.col("row") % 3 == 0).alias("verified"), F.lit(1.0).alias("credits")), c.where("row % 2 = 0").select("row", "claim", F.lit("X").alias("value"), F.lit(True).alias("verified"), F.when(F.col("row") % 5 != 0, 2.0).alias("credits"))))(
        table(s, d, "customer").select(F.col("c_custkey").alias("row"), F.concat(F.lit("a"), (F.col("c_custkey") % 2).cast("string")).alias("claim"), "c_mktsegment")
    )
)

# portfolios
_TRIALS = "SELECT user_id AS unit, event_type AS route, event_id % 3 = 0 AS hit, (event_id % 4)::DOUBLE AS credits FROM events"


def _trials(s, d):
    return events(s, d).select(F.col("user_id").alias("unit"), F.col("event_type").alias("route"), (F.col("event_id") % 3 == 0).alias("hit"), (F.col("event_id") % 4).cast("double").alias("credits"))


register(
    "route_scorecard",
    f"WITH t AS ({_TRIALS}), h AS (SELECT DISTINCT route, unit FROM t WHERE hit), o AS (SELECT *, count(*) OVER (PARTITION BY unit) AS n FROM h), u AS (SELECT route, count(*) AS ru, count(*) FILTER (n = 1) AS uu FROM o GROUP BY 1) SELECT t.route, count(*) AS attempted, count(*) FILTER (hit) AS relevant, sum(credits) AS credits, any_value(ru) AS relevant_units, any_value(uu) AS unique_units, round(count(*) FILTER (hit)::DOUBLE / count(*), 6) AS reliability, round((any_value(ru) + 0.5 * any_value(uu)) / sum(credits), 6) AS utility FROM t LEFT JOIN u USING (route) GROUP BY 1",
)(lambda s, d: portfolio.scorecard(_trials(s, d), "route", "unit", F.col("hit"), "credits").withColumn("reliability", F.round("reliability", 6)).withColumn("utility", F.round("utility", 6)))
register(
    "beta_posterior",
    "WITH x AS (SELECT event_type, count(*) FILTER (event_id % 3 = 0) + 1.0::DOUBLE AS a, count(*) FILTER (event_id % 3 <> 0) + 1.0::DOUBLE AS b FROM events GROUP BY 1) SELECT event_type, round(a / (a + b), 6) AS mean, round(sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))), 6) AS sd FROM x",
)(lambda s, d: (lambda g: g.select("event_type", *[F.round(c, 6).alias(n) for c, n in zip(portfolio.beta_posterior(F.col("h"), F.col("n")), ("mean", "sd"), strict=True)]))(events(s, d).groupBy("event_type").agg(F.count_if(F.col("event_id") % 3 == 0).cast("double").alias("h"), F.count("*").cast("double").alias("n"))))
register(
    "ucb_rank",
    "WITH p AS (SELECT p_partkey, p_size / 50.0::DOUBLE AS m, p_partkey % 4 AS n FROM part), x AS (SELECT p_partkey, round(exp(-0.35 * n) * (m + 0.05) + 0.15 - 0.1 * (p_partkey % 3) - 0.02 * (p_partkey % 5), 6) AS score FROM p) SELECT p_partkey, score, row_number() OVER (ORDER BY score DESC, p_partkey) AS rank FROM x",
)(
    lambda s, d: ranking.rank_all(
        table(s, d, "part").select("p_partkey", F.round(portfolio.ucb(F.lit(1.0), F.col("p_size") / 50.0, F.lit(0.1), F.lit(1.0), F.col("p_partkey") % 4, F.col("p_partkey") % 3, F.col("p_partkey") % 5), 6).alias("score")), F.desc("score"), "p_partkey"
    )
)
register("pareto_frontier", "SELECT a.p_partkey, a.p_size, a.p_retailprice FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_size >= a.p_size AND b.p_retailprice <= a.p_retailprice AND (b.p_size > a.p_size OR b.p_retailprice < a.p_retailprice))")(
    lambda s, d: portfolio.pareto(table(s, d, "part").select("p_partkey", "p_size", "p_retailprice"), "p_partkey", "p_size", "p_retailprice")
)
_SET_ROUTES = ["click", "purchase", "view", "signup"]


@register(
    "set_cover_masks",
    """WITH u AS (SELECT DISTINCT user_id AS unit, CASE event_type WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 WHEN 'view' THEN 4 ELSE 8 END AS b FROM events WHERE event_type IN ('click', 'purchase', 'view', 'signup')),
    g AS (SELECT unit, bit_or(b) AS bits FROM u GROUP BY 1), m AS (SELECT unnest(range(1, 16)) AS mask)
    SELECT mask, (mask & 1)::DOUBLE + 2.0 * ((mask >> 1) & 1) + 3.0 * ((mask >> 2) & 1) + 4.0 * ((mask >> 3) & 1) AS cost, (SELECT count(*) FROM g WHERE bits & mask <> 0) AS covered FROM m""",
)
def set_cover_masks(spark, sf_dir):
    units = events(spark, sf_dir).where(F.col("event_type").isin(*_SET_ROUTES)).select(F.col("user_id").alias("unit"), F.col("event_type").alias("route"))
    costs = spark.createDataFrame([(r, float(i + 1)) for i, r in enumerate(_SET_ROUTES)], "route string, credits double")
    return portfolio.set_covers(units, costs, _SET_ROUTES).withColumn("mask", F.col("mask").cast("long"))


register(
    "cost_receipt",
    "SELECT event_type AS operation, count(*) AS calls, CASE WHEN count(*) > count(c) THEN NULL ELSE sum(c) END AS credits, count(*) FILTER (event_id % 3 = 0) AS hits, CASE WHEN count(*) > count(c) THEN NULL ELSE sum(c) / count(*) FILTER (event_id % 3 = 0) END AS per_hit, count(*) FILTER (event_id % 3 = 0) = 0 AND count(*) >= 5 AS cut FROM (SELECT *, CASE WHEN event_type = 'view' AND event_id % 100 = 0 THEN NULL ELSE (event_id % 4)::DOUBLE END AS c FROM events) GROUP BY 1",
)(
    lambda s, d: portfolio.cost_receipt(
        events(s, d).select(F.col("event_type").alias("operation"), "event_id", F.when((F.col("event_type") != "view") | (F.col("event_id") % 100 != 0), (F.col("event_id") % 4).cast("double")).alias("c")), "operation", "c", F.col("event_id") % 3 == 0
    )
)
register("p95_nearest_rank", "SELECT event_type, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1")(lambda s, d: portfolio.p95(events(s, d), "event_type", "value"))

# evidence
register(
    "figures",
    r"SELECT doc_id, list_sum(list_transform(regexp_extract_all(coalesce(text, ''), '(\d+(?:\.\d+)?)\s?%', 1), lambda x: x::DOUBLE)) AS percents FROM documents WHERE regexp_matches(coalesce(text, ''), '\d\s?%')",
)(lambda s, d: table(s, d, "documents").where(F.coalesce("text", F.lit("")).rlike(r"\d\s?%")).select("doc_id", F.aggregate(tx.percent_figures(F.col("text")), F.lit(0.0), lambda a, x: a + x).alias("percents")))


@register("corroborate_figures")
def corroborate_figures(spark, sf_dir):
    """Order-dependent clusters; rows-only."""
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 9).cast("string").alias("topic"), F.col("o_orderkey").alias("ordinal"), F.lit("usd").alias("unit"), F.col("o_totalprice").alias("value"), F.col("o_orderpriority").alias("domain"))
    return evidence.corroborate(rows)


register("independent_sources", "SELECT user_id, count(DISTINCT event_type) AS sources FROM events GROUP BY 1")(lambda s, d: evidence.independent_sources(events(s, d), "user_id", "event_type"))
register("props_variant", "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events WHERE props->>'$.k' IS NOT NULL")(
    lambda s, d: events(s, d).select("event_id", variant.path(variant.parse(F.col("props")), "$.k", kind="bigint").alias("k")).where("k IS NOT NULL")
)
register("envelope_coalesce", "SELECT event_id, coalesce(props->>'$.missing', props->>'$.k') AS v FROM events")(lambda s, d: events(s, d).select("event_id", variant.path(variant.parse(F.col("props")), "$.missing", "$.k").alias("v")))
register("explode_json", "SELECT user_id, unnest(['a' || user_id, 'b' || user_id]) AS person FROM (SELECT DISTINCT user_id FROM events)")(
    lambda s, d: variant.explode_persons(
        events(s, d).select("user_id").distinct().withColumn("j", F.format_string('{"data": {"persons": [{"n": "a%d"}, {"n": "b%d"}]}}', "user_id", "user_id")), "j"
    ).select("user_id", F.try_variant_get("person", "$.n", "string").alias("person"))
)

# enrichment
_LEGS = "SELECT user_id, min(value) FILTER (event_type = 'purchase' AND value > 50) AS a, min(value) FILTER (event_type = 'click') AS b, min(value) FILTER (event_type = 'view') AS c FROM events GROUP BY 1"


def _waterfall(s, d):
    e = events(s, d).select("user_id", "value", F.when(F.col("event_type") == "purchase", "a").when(F.col("event_type") == "click", "b").when(F.col("event_type") == "view", "c").alias("tool"), F.when((F.col("event_type") != "purchase") | (F.col("value") > 50), "valid").otherwise("unknown").alias("status"))
    wide = enrichment.attach_responses(e.select("user_id").distinct(), e, "user_id", ["a", "b", "c"])
    return enrichment.waterfall(wide, {t: F.col(t) for t in "abc"}, "found")


register("waterfall_first_hit", f"WITH l AS ({_LEGS}) SELECT user_id, coalesce(a, b, c) AS found, CASE WHEN a IS NOT NULL THEN 'a' WHEN b IS NOT NULL THEN 'b' WHEN c IS NOT NULL THEN 'c' END AS found_source FROM l")(lambda s, d: _waterfall(s, d).select("user_id", "found", "found_source"))
register(
    "layer_stats",
    f"WITH l AS ({_LEGS}), x AS (SELECT count(*) AS n, count(*) FILTER (a IS NOT NULL) AS h0, count(*) FILTER (a IS NULL AND b IS NOT NULL) AS h1, count(*) FILTER (a IS NULL AND b IS NULL AND c IS NOT NULL) AS h2 FROM l) SELECT 'a' AS layer, n AS attempted, h0 AS hits, 0 AS skipped FROM x UNION ALL SELECT 'b', n - h0, h1, h0 FROM x UNION ALL SELECT 'c', n - h0 - h1, h2, h0 + h1 FROM x",
)(lambda s, d: enrichment.layer_stats(_waterfall(s, d), "found_source", ["a", "b", "c"]))
register(
    "authorization_ledger",
    """WITH RECURSIVE e AS (SELECT user_id AS campaign, event_id AS seq, event_type = 'click' AS capped, coalesce(value, 0.0) AS c, event_id % 5 = 0 AS cached,
      row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
    r AS (SELECT DISTINCT campaign, NULL::BIGINT AS seq, NULL::VARCHAR AS decision, 0::BIGINT AS n, 0.0::DOUBLE AS total, 0.0::DOUBLE AS clicks FROM e
      UNION ALL SELECT campaign, seq, decision, n, total + CASE WHEN decision = 'authorized' THEN c ELSE 0 END, clicks + CASE WHEN decision = 'authorized' AND capped THEN c ELSE 0 END
      FROM (SELECT e.campaign, e.seq, e.n, e.c, e.capped, r.total, r.clicks, CASE WHEN e.cached THEN 'cache_hit' WHEN e.capped AND r.clicks + e.c > 100 THEN 'provider_cap' WHEN r.total + e.c > 300 THEN 'campaign_cap' ELSE 'authorized' END AS decision
            FROM r JOIN e ON e.campaign = r.campaign AND e.n = r.n + 1))
    SELECT campaign, seq, decision FROM r WHERE n > 0""",
)(
    lambda s, d: enrichment.authorize(events(s, d).select(F.col("user_id").alias("campaign"), F.col("event_id").alias("seq"), F.col("event_type").alias("provider"), F.col("value").alias("credits"), (F.col("event_id") % 5 == 0).alias("cached")), 300.0, {"click": 100.0})
)
register("outbox_status", "WITH l AS (SELECT user_id AS \"key\", arg_max(event_type, ts) AS e, max(ts) AS ts FROM events GROUP BY 1) SELECT \"key\", CASE WHEN e = 'click' AND epoch(TIMESTAMP '2024-01-31') - floor(epoch(ts)) > 3600 THEN 'needs_reconciliation' WHEN e = 'click' THEN 'dispatching' ELSE e END AS state FROM l")(
    lambda s, d: enrichment.outbox_state(events(s, d).select(F.col("user_id").alias("key"), F.col("ts").alias("at"), F.when(F.col("event_type") == "click", "dispatching").otherwise(F.col("event_type")).alias("event")), F.lit("2024-01-31").cast("timestamp"))
)
register("forbidden_transitions", "SELECT event_id, step FROM (SELECT event_id, lag(event_type) OVER w || '>' || event_type AS step FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE step IS NOT NULL AND step NOT IN ('view>click', 'click>purchase')")(
    lambda s, d: enrichment.forbidden_transitions(events(s, d), [("view", "click"), ("click", "purchase")], "user_id", ["ts", "event_id"], "event_type").select("event_id", "step")
)
register("listener_filter", "SELECT event_id FROM events WHERE event_type IN ('click', 'purchase') AND value IS NOT NULL AND event_type ILIKE 'p%'")(
    lambda s, d: events(s, d).where(enrichment.listener({"event_type": {"in": ["click", "purchase"], "ilike": "p%"}, "value": {"isNotNull": True}})).select("event_id")
)
register("route_by_identifier", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'email' WHEN c_custkey % 3 = 0 THEN 'domain' ELSE 'none' END AS route FROM customer")(
    lambda s, d: table(s, d, "customer").select("c_custkey", enrichment.route([("email", F.when(F.col("c_custkey") % 2 == 0, F.col("c_name"))), ("domain", F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")))]).alias("route"))
)

# built-ins of categories that need no operator of their own
register("cube_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")(lambda s, d: table(s, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q")))
register("set_ops", "(SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer) EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal < 0")(
    lambda s, d: table(s, d, "orders").select(F.col("o_custkey").alias("k")).intersect(table(s, d, "customer").select("c_custkey")).subtract(table(s, d, "customer").where("c_acctbal < 0").select("c_custkey"))
)
register("window_frames", "SELECT o_orderkey, ntile(4) OVER w AS quartile, round(percent_rank() OVER w, 6) AS pr, lead(o_orderkey) OVER w AS next FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)")(
    lambda s, d: (lambda w: table(s, d, "orders").select("o_orderkey", F.ntile(4).over(w).alias("quartile"), F.round(F.percent_rank().over(w), 6).alias("pr"), F.lead("o_orderkey").over(w).alias("next")))(Window.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey"))
)


# streams
def _stream(spark, sf_dir):
    import atexit
    import shutil
    import tempfile
    import uuid

    from signal_engine.streaming import feeds

    base = table(spark, sf_dir, "events")
    raw = spark.readStream.schema(base.schema).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    # the folder all executors share; an own one only where none is set, in local runs
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    where = f"{shared.rstrip('/')}/s{uuid.uuid4().hex}" if shared else tempfile.mkdtemp(prefix="signal-engine-")
    if not shared:
        atexit.register(shutil.rmtree, where, ignore_errors=True)

    def run(df, mode):
        return feeds.run_to_table(df, f"{where}/table", mode, f"{where}/checkpoint")

    return raw, run


@register("tumbling_counts", "SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_counts(spark, sf_dir):
    from signal_engine.streaming import feeds

    raw, run = _stream(spark, sf_dir)
    return run(feeds.tumbling(raw, "ts", "1 day", "event_type").select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", F.col("count").alias("n")), "complete")


@register(
    "session_activity",
    "WITH x AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS n FROM events), y AS (SELECT user_id, ts, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM x) SELECT user_id, min(ts) AS started, count(*) AS n FROM y GROUP BY user_id, g",
)
def session_activity(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("t", F.col("ts").cast("timestamp"))
    return e.groupBy(F.session_window("t", "30 minutes"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("started"), "n")
