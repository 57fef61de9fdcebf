"""Queries of roles, drafts, candidates, counts of what was left out, and figures. Inputs are built from each row's
values; the SQL states the outcome from the same values by another way where it can."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from signal_engine.catalogue import register, table
from signal_engine.functions import roles
from signal_engine.functions import text as tx
from signal_engine.operators import selection


def pick(values, by: str) -> Column:
    """The value at the row's number modulo their count."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(by) % len(values) + 1).cast("int"))


TITLES = {
    "Senior GTM Engineer": ("gtm_engineering", "technical_champion"),
    "VP, Revenue Operations": ("revenue_operations", "operational_buyer"),
    "Head of BizOps": ("business_operations", "operational_buyer"),
    "Recruiter, Revenue Systems": (None, None),
    "Director (Marketing-Ops)": ("marketing_operations", "operational_buyer"),
    "Treasury Controller": ("finance", "economic_buyer"),
    "Data Steward": ("stewards", "technical_champion"),
    "Opsrevenue systemsman": (None, None),
    "": (None, None),
}
CATALOGUE = {"finance": ("treasury controller",), "stewards": ("data steward",)}
_TITLE_ROWS = ", ".join(f"({i}, {', '.join('NULL' if v is None else repr(v) for v in pair)})" for i, pair in enumerate(TITLES.values()))

register("role_families", f"SELECT s_suppkey, t.family, t.role FROM supplier JOIN (VALUES {_TITLE_ROWS}) AS t(i, family, role) ON s_suppkey % {len(TITLES)} = i")(
    lambda s, d: table(s, d, "supplier").withColumn("family", roles.role_family(pick(TITLES, "s_suppkey"), CATALOGUE)).select("s_suppkey", "family", roles.committee_role(F.col("family"), {"finance": "economic_buyer"}).alias("role"))
)

register(
    "relevant_profiles",
    """SELECT p_partkey FROM part WHERE p_partkey % 2 = 0
       AND regexp_matches(lower(p_name || ' ' || p_type), 'small|standard|lead')
       AND (contains(lower(p_name || ' ' || p_type), substr(lower(p_brand), 1, 8)) OR p_size > 25)""",
)(
    lambda s, d: table(s, d, "part")
    .where(
        roles.relevant_profile(
            F.when(F.col("p_partkey") % 2 == 0, "https://profiles.example/in/x").otherwise("https://profiles.example/co/x"),
            F.concat_ws(" ", "p_name", "p_type"),
            F.when(F.col("p_size") > 25, F.concat(F.lit("Works at "), F.col("p_brand"))),
            F.concat(F.col("p_brand"), F.lit(", Inc. (US)")),
            [w for w in roles.role_words(["small of", "Standard"]) if w in ("small", "standard", "lead")],
        )
    )
    .select("p_partkey")
)

register(
    "result_titles",
    """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Ada Byron' WHEN 1 THEN 'José O''Neil Pérez' END AS name,
       CASE c_custkey % 4 WHEN 0 THEN c_mktsegment || ' lead' WHEN 1 THEN c_name END AS role FROM customer""",
)(
    lambda s, d: table(s, d, "customer")
    .withColumn("t", roles.title_parts(F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("Ada Byron | "), "c_mktsegment", F.lit(" lead "))).when(F.col("c_custkey") % 4 == 1, F.concat(F.lit("José O'Neil Pérez – "), "c_name")).when(F.col("c_custkey") % 4 == 2, F.col("c_name"))))
    .select("c_custkey", F.col("t.name").alias("name"), F.col("t.role").alias("role"))
)

register(
    "draftable_paths",
    "SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '1%' OR (o_orderpriority LIKE '2%' AND o_orderstatus = 'O')",
)(
    lambda s, d: table(s, d, "orders")
    .where(
        selection.draftable(
            F.when(F.col("o_orderpriority").startswith("1"), "strong_warm_intro").when(F.col("o_orderpriority").startswith("2"), "review_warm_intro").otherwise("no_strong_path"),
            F.when(F.col("o_orderstatus") == "O", " TRUE").otherwise("no"),
            allow_reviewed=True,
        )
    )
    .select("o_orderkey")
)

register("sendable_drafts", r"SELECT conv_id, turn FROM conversations WHERE regexp_matches(coalesce(text, ''), '\S') AND role = 'assistant'")(
    lambda s, d: table(s, d, "conversations").where(selection.sendable(F.col("text"), F.when(F.col("role") == "assistant", "True ").otherwise("false"))).select("conv_id", "turn")
)

register(
    "entity_matches",
    "SELECT p_partkey FROM part WHERE contains(regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9]+', ' ', 'g'), split_part(lower(p_name), ' ', 2)) AND p_size % 2 = 0",
)(lambda s, d: table(s, d, "part").where(selection.matches_entity(F.when(F.col("p_size") % 2 == 0, F.concat(F.upper(F.split_part("p_name", F.lit(" "), F.lit(2))), F.lit("!"))).otherwise("x"), F.col("p_name"), F.col("p_type"))).select("p_partkey"))

register(
    "official_domains",
    "SELECT c_custkey, c_custkey % 5 IN (0, 3) AS official FROM customer",
)(
    lambda s, d: table(s, d, "customer").select(
        "c_custkey",
        selection.official_domain(
            F.concat(
                pick(("https://www.", "https://linkedin.com/", "https://other", "https://docs.allowed.example/", "https://sub.directory.example/"), "c_custkey"),
                F.replace(F.lower("c_name"), F.lit("#"), F.lit("")),
                F.lit(".com/about"),
            ),
            F.replace("c_name", F.lit("#"), F.lit(" ")),
            ["linkedin.com", "directory.example"],
            ["allowed.example"],
        ).alias("official"),
    )
)

register("reject_only_judge", "SELECT o_orderkey FROM orders WHERE o_totalprice > 100000")(
    lambda s, d: (lambda o: selection.reject_only(o.select("o_orderkey"), o.where("o_totalprice > 100000").select("o_orderkey"), "o_orderkey"))(table(s, d, "orders"))
)

register(
    "exclusion_counts",
    """SELECT reason, count(*) AS rows FROM (SELECT unnest(list_distinct(list_filter([CASE WHEN o_totalprice < 50000 THEN 'small' END, CASE WHEN o_orderstatus = 'F' THEN 'closed' END,
       CASE WHEN o_orderpriority LIKE '5%' THEN 'low' END], lambda x: x IS NOT NULL))) AS reason FROM orders) GROUP BY 1""",
)(
    lambda s, d: selection.exclusion_counts(
        table(s, d, "orders"),
        F.array_compact(F.array(F.when(F.col("o_totalprice") < 50000, "small"), F.when(F.col("o_orderstatus") == "F", "closed"), F.when(F.col("o_orderpriority").startswith("5"), "low"))),
    )
)

register(
    "segment_counts",
    "SELECT v.value, (SELECT count(*) FROM customer WHERE c_mktsegment = v.value) AS rows FROM (VALUES ('BUILDING'), ('FURNITURE'), ('NONE SUCH')) AS v(value)",
)(lambda s, d: selection.counts_with_zeros(table(s, d, "customer"), "c_mktsegment", ["BUILDING", "FURNITURE", "NONE SUCH"]))

register(
    "program_scorecard",
    """WITH a AS (SELECT l_suppkey AS program, count(*) AS attempts, count(*) FILTER (l_returnflag = 'R') AS failures, sum(l_linenumber)::BIGINT AS calls,
         CASE WHEN count(*) FILTER (l_linestatus = 'O' AND l_suppkey % 3 = 0) > 0 THEN NULL ELSE round(sum(l_quantity), 4) END AS credits,
         count(*) FILTER (l_linestatus = 'O' AND l_suppkey % 3 = 0) AS unobserved,
         count(*) FILTER (l_quantity > 25) AS complete_results, count(DISTINCT l_partkey) FILTER (l_quantity > 25) AS complete_units,
         sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END)::BIGINT AS verified_claims FROM lineitem GROUP BY 1)
       SELECT *, round(CASE WHEN verified_claims > 0 THEN calls / verified_claims END, 4) AS calls_per_claim, round(CASE WHEN verified_claims > 0 THEN credits / verified_claims END, 4) AS credits_per_claim FROM a""",
)(
    lambda s, d: selection.program_scorecard(
        table(s, d, "lineitem").select(F.col("l_suppkey").alias("program"), F.col("l_linenumber").alias("calls"), F.when(~((F.col("l_linestatus") == "O") & (F.col("l_suppkey") % 3 == 0)), F.col("l_quantity")).alias("credits"), F.when(F.col("l_returnflag") == "R", "error").alias("error")),
        table(s, d, "lineitem").select(F.col("l_suppkey").alias("program"), F.col("l_partkey").alias("unit"), (F.col("l_quantity") > 25).alias("complete"), F.when(F.col("l_returnflag") == "A", 1).otherwise(0).alias("claims")),
    ).select("program", "attempts", "failures", "calls", F.round("credits", 4).alias("credits"), "unobserved", "complete_results", "complete_units", "verified_claims", F.round("calls_per_claim", 4).alias("calls_per_claim"), F.round("credits_per_claim", 4).alias("credits_per_claim"))
)

register(
    "known_identities",
    """SELECT c_nationkey, list_sort(list(DISTINCT lower(replace(c_name, '#', '.')) || '@example.com') FILTER (c_custkey % 2 = 0)) AS emails,
       list_sort(list(DISTINCT lower(c_name) || '|' || lower(c_mktsegment) || '|buyer')) AS identities FROM customer GROUP BY 1
       HAVING count(*) FILTER (c_custkey % 2 = 0) > 0
       UNION ALL SELECT c_nationkey, [], list_sort(list(DISTINCT lower(c_name) || '|' || lower(c_mktsegment) || '|buyer')) FROM customer GROUP BY 1 HAVING count(*) FILTER (c_custkey % 2 = 0) = 0""",
)(
    lambda s, d: selection.known_identities(
        table(s, d, "customer").select("c_nationkey", F.lit(None).cast("string").alias("linkedin"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@Example.com"))).alias("email"), F.concat(F.lit(" "), "c_name").alias("name"), F.col("c_mktsegment").alias("company"), F.lit("Buyer").alias("title")),
        "c_nationkey",
    ).select("c_nationkey", "emails", "identities")
)

register(
    "fit_tiers",
    """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'low' WHEN p_partkey % 4 = 1 THEN 'high' WHEN p_partkey % 4 = 2 THEN 'medium' ELSE 'low' END AS tier,
       CASE WHEN p_size % 3 <> 0 AND p_size > 10 THEN 'complete' ELSE 'insufficient_evidence' END AS status FROM part""",
)(
    lambda s, d: table(s, d, "part").select(
        "p_partkey",
        selection.fit_tier(F.lit(True), F.col("p_size") % 3 != 0, F.concat_ws(" ", F.lit("We sell a"), "p_name", pick(("widgetdata", "to Customer teams", "for cloud risk", "maintenance"), "p_partkey"))).alias("tier"),
        selection.research_status(F.col("p_size") % 3 != 0, F.col("p_size") > 10).alias("status"),
    )
)

register("idempotent_transitions", "SELECT user_id::VARCHAR || ':' || event_type AS k, min(event_id) AS event_id FROM events WHERE event_type IS NOT NULL AND user_id % 3 <> 0 GROUP BY 1")(
    lambda s, d: (
        lambda e: selection.net_transitions(e.select("k", "event_id"), e.where("user_id % 3 = 0").select("k"), "k", "event_id")
    )(table(s, d, "events").withColumn("k", F.concat_ws(":", F.col("user_id").cast("string"), "event_type")))
)

register(
    "path_signals",
    """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'direct_introduction' WHEN 1 THEN 'verified_work_overlap' WHEN 2 THEN 'company_proximity' WHEN 3 THEN 'role_industry' ELSE '' END AS signal,
       CASE o_orderkey % 5 WHEN 0 THEN o_custkey::VARCHAR || ';e2' WHEN 1 THEN o_orderpriority || ', 2020-01 to 2021:02' WHEN 2 THEN o_orderpriority || '; second' WHEN 3 THEN o_orderstatus ELSE '' END AS detail FROM orders""",
)(
    lambda s, d: table(s, d, "orders")
    .withColumn("n", F.col("o_orderkey") % 5)
    .withColumn(
        "reasons",
        F.when(F.col("n") <= 1, F.array(F.lit("shared_city:x"), F.concat(F.lit("dated_work_overlap:"), "o_orderpriority", F.lit(":2020-01:2021:02"))))
        .when(F.col("n") == 2, F.array(F.lit("role_proximity:r"), F.concat(F.lit("company_proximity:"), "o_orderpriority"), F.lit("company_proximity:second")))
        .when(F.col("n") == 3, F.array(F.lit("investor_overlap:i"), F.concat(F.lit("role_proximity:"), "o_orderstatus")))
        .otherwise(F.array(F.lit("other:o"))),
    )
    .withColumn("s", selection.path_signal(F.col("n") == 0, F.array(F.col("o_custkey").cast("string"), F.lit("e2")), F.col("reasons")))
    .select("o_orderkey", F.col("s.signal").alias("signal"), F.col("s.detail").alias("detail"))
)

register(
    "figures_in_text",
    """SELECT p_partkey, 'usd' AS unit, CASE p_partkey % 3 WHEN 0 THEN p_size * 1e9 WHEN 1 THEN p_size * 1e6 ELSE p_size * 1000 + 250.0 END::DOUBLE AS value FROM part
       UNION ALL SELECT p_partkey, 'percent', p_size + 0.5::DOUBLE FROM part
       UNION ALL SELECT p_partkey, 'count', p_partkey * 1e3::DOUBLE FROM part""",
)(
    lambda s, d: table(s, d, "part")
    .select(
        "p_partkey",
        F.explode(
            tx.all_figures(
                F.concat(
                    F.lit("Raised "),
                    F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("$"), "p_size", F.lit("bn"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("USD "), "p_size", F.lit(" million"))).otherwise(F.concat(F.lit("$"), "p_size", F.lit(",250"))),
                    F.lit(" in 2024, up "), "p_size", pick((".5%", ".5 percent"), "p_partkey"), F.lit(", for "), "p_partkey", F.lit(" Thousand users of "), "p_name",
                )
            )
        ).alias("f"),
    )
    .select("p_partkey", "f.unit", "f.value")
)
