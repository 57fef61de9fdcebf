"""Campaign queries over the star schema."""

from pyspark.sql import functions as F

from signal_engine.catalogue import register, table
from signal_engine.operators import campaign

register(
    "connector_scores",
    "WITH s AS (SELECT DISTINCT c_nationkey AS contact, CASE WHEN c_custkey % 2 = 0 THEN 'company' ELSE 'school' END AS kind, lower(c_mktsegment) AS key FROM customer) SELECT contact, sum(CASE kind WHEN 'company' THEN 50 ELSE 20 END)::BIGINT AS score, list_sort(list(DISTINCT kind)) AS kinds FROM s GROUP BY 1",
)(lambda s, d: campaign.connector_scores(table(s, d, "customer").select(F.col("c_nationkey").alias("contact"), F.when(F.col("c_custkey") % 2 == 0, "company").otherwise("school").alias("kind"), F.concat("c_mktsegment", F.when(F.col("c_custkey") % 3 == 0, " Inc.").otherwise("")).alias("name"))))
register(
    "claim_coverage",
    "SELECT c_custkey AS claim, CASE WHEN c_custkey % 4 = 0 THEN 'no_result' WHEN c_custkey % 4 = 1 THEN 'supported' WHEN c_custkey % 4 = 2 THEN 'gap' ELSE 'provider_error' END AS status FROM customer",
)(
    lambda s, d: (lambda c: campaign.claim_coverage(c.select(F.col("c_custkey").alias("claim"), F.lit("acme revenue growth").alias("query")), c.where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("claim"), F.when(F.col("c_custkey") % 4 == 1, "Acme grew revenue").when(F.col("c_custkey") % 4 == 2, "nothing of note").alias("text"), F.when(F.col("c_custkey") % 4 == 3, "timeout").alias("error"))))(table(s, d, "customer"))
)
register(
    "candidate_promotion",
    "WITH c AS (SELECT s_suppkey AS id, s_suppkey % 5 AS rows, (s_suppkey % 10) / 10.0::DOUBLE AS supported, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE s_acctbal END AS credits FROM supplier), m AS (SELECT *, CASE WHEN rows = 0 THEN 'no_rows' WHEN supported < 0.5 THEN 'too_little_supported' WHEN credits IS NULL THEN 'unknown_cost' END AS excluded FROM c) SELECT id, excluded, CASE WHEN excluded IS NULL THEN row_number() OVER (PARTITION BY excluded IS NULL ORDER BY supported DESC, credits, id) END AS rank FROM m",
)(
    lambda s, d: campaign.promote(table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 5).alias("rows"), (F.col("s_suppkey") % 10 / 10.0).alias("supported"), F.when(F.col("s_suppkey") % 7 != 0, F.col("s_acctbal")).alias("credits")), 0.5, [F.desc("supported"), F.asc("credits"), F.asc("id")]).select("id", "excluded", "rank")
)
register("same_inputs", "SELECT c_custkey FROM customer WHERE c_custkey % 10 = 0 UNION ALL SELECT c_custkey FROM customer WHERE c_custkey % 10 = 0")(
    lambda s, d: (lambda c: campaign.same_inputs(c, c.withColumn("c_name", F.when(F.col("c_custkey") % 10 == 0, "changed").otherwise(F.col("c_name"))), "c_custkey", ["c_name"]).select("c_custkey"))(table(s, d, "customer"))
)
register(
    "cohort_ratios",
    "SELECT event_type, round(count(*) FILTER (value > 20)::DOUBLE / count(*), 6) AS complete_share, round(count(*) FILTER (event_id % 2 = 0)::DOUBLE / count(*), 6) AS verified_share, round(count(*) FILTER (value > 20 AND event_id % 2 = 0)::DOUBLE / count(*) FILTER (value > 20), 6) AS verified_of_complete FROM events GROUP BY 1",
)(lambda s, d: campaign.cohort_ratios(table(s, d, "events"), "event_type", F.col("value") > 20, F.col("event_id") % 2 == 0).select("event_type", *[F.round(c, 6).alias(c) for c in ("complete_share", "verified_share", "verified_of_complete")]))
register(
    "experiment_leverage",
    "WITH x AS (SELECT sum(s_suppkey % 5) AS calls, sum(10) AS exhaustive, sum(s_suppkey % 3) AS results, round(sum(s_acctbal), 4) AS credits, max(5) AS target FROM supplier) SELECT calls, exhaustive, results, credits, target, round(1 - calls::DOUBLE / exhaustive, 6) AS avoided, round(results / credits, 6) AS per_credit, CASE WHEN results >= target THEN 'target_reached' WHEN calls >= exhaustive THEN 'exhausted' ELSE 'budget' END AS stopped FROM x",
)(
    lambda s, d: campaign.leverage(table(s, d, "supplier").select((F.col("s_suppkey") % 5).alias("calls"), F.lit(10).alias("exhaustive"), (F.col("s_suppkey") % 3).alias("results"), F.col("s_acctbal").alias("credits"), F.lit(5).alias("target"))).withColumn("credits", F.round("credits", 4)).withColumn("avoided", F.round("avoided", 6)).withColumn("per_credit", F.round("per_credit", 6))
)


def _campaign(s, d):
    c = table(s, d, "customer")
    accounts = table(s, d, "nation").select(F.col("n_nationkey").alias("account"), F.concat(F.lower("n_name"), F.lit(".com")).alias("domain"), (F.col("n_nationkey") * 4).alias("points"))
    title = F.when(F.col("c_custkey") % 3 == 0, "VP Sales").when(F.col("c_custkey") % 3 == 1, "Engineer").otherwise("Manager")
    contacts = c.select(F.col("c_custkey").alias("contact"), F.col("c_nationkey").alias("account"), F.lit(None).cast("string").alias("linkedin"), F.concat(F.lit("u"), (F.col("c_custkey") % 100).cast("string"), F.lit("@"), F.col("c_nationkey").cast("string"), F.lit("x.com")).alias("email"), F.col("c_name").alias("name"), title.alias("title"))
    spans = table(s, d, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").cast("date").alias("start"), F.max("o_orderdate").cast("date").alias("end"))
    experiences = spans.select(F.col("o_custkey").alias("contact"), F.concat(F.lit("Firm "), (F.col("o_custkey") % 4).cast("string"), F.lit(" Inc")).alias("company"), "start", "end", F.lit(False).alias("is_current"))
    return campaign.run_campaign(accounts, contacts, experiences, F.to_date(F.lit("1998-08-02")), 4, 60, 40)


register(
    "campaign_accounts",
    "SELECT n_nationkey AS account, CASE WHEN n_nationkey * 4 >= 60 THEN 'include' WHEN n_nationkey * 4 >= 40 THEN 'review' ELSE 'exclude' END AS decision, row_number() OVER (ORDER BY n_nationkey * 4 < 40, n_nationkey * 4 DESC, lower(n_name) || '.com') AS rank FROM nation",
)(lambda s, d: _campaign(s, d)["accounts"].select("account", "decision", "rank"))
register(
    "campaign_committee",
    "SELECT min(c_custkey) AS canonical, CASE WHEN min(c_custkey) % 3 = 0 THEN 4 ELSE 8 END AS seniority FROM customer WHERE c_nationkey * 4 >= 40 GROUP BY c_nationkey, c_custkey % 100 HAVING min(c_custkey) % 3 <> 1",
)(lambda s, d: _campaign(s, d)["committee"].select("canonical", "seniority"))
register("campaign_warm_paths")(lambda s, d: _campaign(s, d)["warm_paths"])
register("campaign_direct")(lambda s, d: _campaign(s, d)["direct"].select("canonical", "em"))
