"""Domain, url, name and contact normalisation queries."""

from pyspark.sql import functions as F

from signal_engine.catalogue import register, table
from signal_engine.functions import text as tx
from signal_engine.operators import entity, joins, sets, signals

_HOST = r"regexp_replace(regexp_extract(regexp_replace(lower(trim(coalesce(url, ''))), '^[a-z][a-z0-9+.-]*://', ''), '^(?:[^/?#@]*@)?([^/?#:]*)', 1), '^(?:www\.)+', '')"
_SUFFIXES = ", ".join(f"'{x}'" for x in tx.MULTI_LABEL_SUFFIXES)
_APEX_CTE = f"""h AS (SELECT page_id, url, {_HOST} AS host FROM pages),
a AS (SELECT *, string_split(host, '.') AS p FROM h),
x AS (SELECT page_id, url, host, CASE WHEN NOT contains(host, '.') OR contains(host, ' ') THEN ''
      WHEN len(p) >= 3 AND array_to_string(p[-2:], '.') IN ({_SUFFIXES}) THEN array_to_string(p[-3:], '.') ELSE array_to_string(p[-2:], '.') END AS apex FROM a)"""

register("apex_domain", f"WITH {_APEX_CTE} SELECT page_id, apex FROM x")(lambda s, d: table(s, d, "pages").select("page_id", tx.extract_apex(F.col("url")).alias("apex")))
register("registrable_domain", f"WITH {_APEX_CTE} SELECT page_id, CASE WHEN contains(host, '.') THEN array_to_string(string_split(host, '.')[-2:], '.') END AS domain FROM x")(
    lambda s, d: table(s, d, "pages").select("page_id", tx.registrable_domain(F.col("url")).alias("domain"))
)


@register(
    "canonical_url",
    rf"""WITH s AS (SELECT page_id, url, regexp_replace(trim(coalesce(url, '')), '#.*$', '') AS s, {_HOST} AS host FROM pages),
    p AS (SELECT *, regexp_replace(regexp_extract(s, '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?[^/?]*([^?]*)', 1), '/+$', '') AS path,
      array_to_string(list_filter(string_split(regexp_extract(s, '\?(.*)$', 1), '&'), lambda q: q <> '' AND NOT regexp_matches(q, '^(?:utm_[^=]*|ref|source|trk)(?:=|$)')), '&') AS query FROM s)
    SELECT page_id, host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS canonical FROM p""",
)
def canonical_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.canonical_url(F.col("url")).alias("canonical"))


def _halves(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", tx.canonical_url(F.col("url")).alias("u")).select("page_id", F.substring_index("u", "/", 1).alias("host"))
    return pages.where("page_id % 2 = 0"), pages.where("page_id % 2 = 1")


_HALVES = f"h AS (SELECT page_id, {_HOST} AS host FROM pages)"
register("split_matched", f"WITH {_HALVES} SELECT page_id, host FROM h WHERE page_id % 2 = 0 AND host IN (SELECT host FROM h WHERE page_id % 2 = 1)")(lambda s, d: joins.split_matched(*_halves(s, d), "host")[1].select("page_id", "host"))
register("split_actionable", f"WITH {_HALVES} SELECT page_id, host FROM h WHERE page_id % 2 = 0 AND host NOT IN (SELECT host FROM h WHERE page_id % 2 = 1)")(lambda s, d: joins.split_matched(*_halves(s, d), "host")[0].select("page_id", "host"))

_WORDS = "|".join(tx.CORPORATE_WORDS)


@register(
    "norm_name",
    rf"""WITH n AS (SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(p_name || ' Systems, Inc.')), '\b(?:{_WORDS})\b\.?', '', 'g'), '[^a-z0-9 ]', '', 'g'), '\s+', ' ', 'g')) AS n FROM part)
    SELECT p_partkey, CASE WHEN length(n) < 3 THEN '' ELSE n END AS name FROM n""",
)
def norm_name(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", tx.norm_name(F.concat("p_name", F.lit(" Systems, Inc."))).alias("name"))


_LEGAL = "|".join(tx.LEGAL_FORMS)
register(
    "normalize_company",
    rf"""SELECT p_partkey, regexp_replace(trim(regexp_replace(lower(p_name || ' GmbH & Co. Ltd'), '[^a-z0-9]+', ' ', 'g')), '(?:(?:^| )(?:{_LEGAL}))+$', '') AS company FROM part""",
)(lambda s, d: table(s, d, "part").select("p_partkey", tx.normalize_company(F.concat("p_name", F.lit(" GmbH & Co. Ltd"))).alias("company")))


@register("fuzzy_name_match")
def fuzzy_name_match(spark, sf_dir):
    """Rows-only: block matching ratio has no SQL form."""
    part = table(spark, sf_dir, "part")
    rows = part.select(F.col("p_partkey").alias("id"), F.lit("").alias("apex"), F.concat("p_name", F.lit("s")).alias("name"))
    known = part.select(F.col("p_partkey").alias("known_id"), F.lit("").alias("apex"), F.col("p_name").alias("name"))
    return joins.layered_match(rows, known, 0.85)


@register(
    "token_subset_match",
    """WITH t AS (SELECT p_partkey AS id, list_distinct(string_split(p_name, ' ')) AS w FROM part)
    SELECT a.id AS left_id, b.id AS right_id FROM t a, t b WHERE a.id < b.id AND len(list_intersect(a.w, b.w)) = least(len(a.w), len(b.w))""",
)
def token_subset_match(spark, sf_dir):
    side = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.split("p_name", " ").alias("tokens"))
    return joins.token_subset(side, side, once=True)


_EMAIL = "lower(replace(c_name, '#', '.')) || '@' || lower(c_mktsegment) || '.com'"


def _contacts(spark, sf_dir):
    email = F.concat(F.lower(F.replace(F.col("c_name"), F.lit("#"), F.lit("."))), F.lit("@"), F.lower("c_mktsegment"), F.lit(".com"))
    return table(spark, sf_dir, "customer").withColumn("email", email)


@register(
    "hash_audience",
    f"SELECT DISTINCT sha256({_EMAIL}) AS hash FROM customer",
)
def hash_audience(spark, sf_dir):
    from signal_engine.operators.enrichment import hash_audience

    return hash_audience(_contacts(spark, sf_dir).withColumn("given", F.lit("not a hash")), "email", "given")


register(
    "hash_audit",
    f"""WITH v AS (SELECT CASE WHEN c_custkey % 5 = 0 THEN {_EMAIL} ELSE sha256(c_mktsegment || (c_custkey % 100)) END AS v FROM customer),
    o AS (SELECT v, regexp_matches(v, '^[a-f0-9]{{64}}$') AS ok FROM v)
    SELECT count(*) AS input, count(DISTINCT v) FILTER (ok) AS output, count(*) FILTER (NOT ok) AS malformed, count(*) FILTER (ok) - count(DISTINCT v) FILTER (ok) AS duplicate, bool_or(contains(v, '@')) AS raw_email_present FROM o""",
)(lambda s, d: signals.hash_audit(_contacts(s, d).select(F.when(F.col("c_custkey") % 5 == 0, F.col("email")).otherwise(F.sha2(F.concat("c_mktsegment", (F.col("c_custkey") % 100).cast("string")), 256)).alias("v")), "v"))

register(
    "double_hash_check",
    "WITH s AS (SELECT sha256(c_name) AS hash FROM customer), p AS (SELECT CASE WHEN c_custkey % 7 = 0 THEN sha256(sha256(c_name)) ELSE sha256(c_name) END AS hash FROM customer) SELECT hash FROM p WHERE hash IN (SELECT sha256(hash) FROM s)",
)(
    lambda s, d: joins.double_hashed(
        table(s, d, "customer").select(F.when(F.col("c_custkey") % 7 == 0, F.sha2(F.sha2("c_name", 256), 256)).otherwise(F.sha2("c_name", 256)).alias("hash")), table(s, d, "customer").select(F.sha2("c_name", 256).alias("hash"))
    )
)


@register(
    "coverage_lift",
    """WITH r AS (SELECT c_mktsegment AS audience, count(*) AS rows, count(*) FILTER (c_acctbal > 0) AS matched FROM customer GROUP BY 1),
    b AS (SELECT matched::DOUBLE / rows AS b FROM r WHERE audience = 'BUILDING')
    SELECT audience, round(100 * (matched::DOUBLE / rows), 2) AS pct, round(100 * (matched::DOUBLE / rows - b), 2) AS points, round((matched::DOUBLE / rows - b) / b, 4) AS relative,
           round((matched::DOUBLE / rows - b) * rows, 0)::BIGINT AS gained FROM r, b""",
)
def coverage_lift(spark, sf_dir):
    report = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("audience")).agg(F.count("*").alias("rows"), F.count_if(F.col("c_acctbal") > 0).alias("matched"))
    return signals.coverage_lift(report, "BUILDING")


# sets
register("keep_first_dedupe", "SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")(
    lambda s, d: sets.keep_first(table(s, d, "events").select("event_id", "user_id", "event_type", "ts"), ["user_id", "event_type"], "ts", "event_id").drop("ts")
)
register("drop_ambiguous_keys", "SELECT event_id, user_id FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY user_id HAVING min(event_type) = max(event_type)) OR user_id IS NULL")(
    lambda s, d: sets.drop_ambiguous(table(s, d, "events").select("event_id", "user_id", "event_type"), "user_id", "event_type").select("event_id", "user_id")
)
register(
    "net_new",
    "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events WHERE event_id % 2 = 0 AND user_id NOT IN (SELECT user_id FROM events WHERE event_id % 97 = 1)) WHERE r = 1",
)(lambda s, d: sets.net_new(table(s, d, "events").where("event_id % 2 = 0").select("user_id", "event_id"), table(s, d, "events").where("event_id % 97 = 1"), "user_id", "event_id"))
register(
    "upsert",
    "SELECT coalesce(n.c_custkey, o.c_custkey) AS c_custkey, coalesce(n.seg, o.seg) AS seg FROM (SELECT c_custkey, c_mktsegment AS seg FROM customer WHERE c_custkey % 2 = 0) o FULL JOIN (SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE 'NEW' END AS seg FROM customer WHERE c_custkey % 3 = 0) n ON o.c_custkey = n.c_custkey",
)(
    lambda s, d: sets.upsert(
        table(s, d, "customer").where("c_custkey % 2 = 0").select("c_custkey", F.col("c_mktsegment").alias("seg")),
        table(s, d, "customer").where("c_custkey % 3 = 0").select("c_custkey", F.when(F.col("c_custkey") % 9 != 0, "NEW").alias("seg")),
        "c_custkey",
    )
)
register(
    "replace_children",
    "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49) UNION ALL SELECT l_orderkey, -l_linenumber FROM lineitem WHERE l_quantity > 49",
)(
    lambda s, d: sets.replace_children(
        table(s, d, "lineitem").select("l_orderkey", "l_linenumber"), table(s, d, "lineitem").where("l_quantity > 49").select("l_orderkey", (-F.col("l_linenumber")).alias("l_linenumber")), "l_orderkey"
    )
)
register(
    "union_first",
    "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY phase, event_id) AS r FROM (SELECT user_id, event_id, 0 AS phase FROM events WHERE event_type = 'purchase' UNION ALL SELECT user_id, event_id, 1 FROM events WHERE event_type = 'click') WHERE user_id IS NOT NULL) WHERE r = 1",
)(lambda s, d: sets.union_first([table(s, d, "events").where(F.col("event_type") == t).select("user_id", "event_id") for t in ("purchase", "click")], "user_id", "event_id"))
register(
    "chunks",
    "WITH x AS (SELECT s_suppkey, count(*) OVER () AS n, row_number() OVER (ORDER BY s_suppkey) AS rn FROM supplier) SELECT s_suppkey, CASE WHEN n % 9 > 0 AND n % 9 < 5 AND n > 9 AND rn > n - 5 THEN (n - 1) // 9 ELSE (rn - 1) // 9 END AS chunk FROM x",
)(lambda s, d: sets.chunks(table(s, d, "supplier").select("s_suppkey"), ["s_suppkey"], 9, 5))
register(
    "prune_or_all",
    "SELECT c_custkey, c_nationkey FROM (SELECT *, max((c_acctbal > 9500)::INT) OVER (PARTITION BY c_nationkey) AS a FROM customer) WHERE c_acctbal > 9500 OR a = 0",
)(lambda s, d: sets.prune_or_all(table(s, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), "c_nationkey", F.col("c_acctbal") > 9500).select("c_custkey", "c_nationkey"))
register("run_if_gate", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN upper(o_orderpriority) END AS label FROM orders")(
    lambda s, d: sets.gated(table(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), F.col("o_orderstatus") == "F", "label", F.upper("o_orderpriority")).select("o_orderkey", "label")
)

# entities
# a customer is linked to its orders and to its block of five customers
_EDGES = "SELECT o_custkey AS a, 1000000000 + o_orderkey AS b FROM orders UNION SELECT c_custkey, 2000000000 + c_custkey // 5 FROM customer"


def _edges(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("long").alias("a"), (F.col("o_orderkey") + 1000000000).cast("long").alias("b"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("a"), (F.floor(F.col("c_custkey") / 5) + 2000000000).cast("long").alias("b"))
    return orders.unionByName(customers)


register(
    "connected_components",
    f"""WITH RECURSIVE e AS ({_EDGES}), n AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e),
    r AS (SELECT x AS node, x AS other FROM n UNION SELECT r.node, n.y FROM r JOIN n ON r.other = n.x)
    SELECT node, min(other) AS component FROM r GROUP BY node""",
)(lambda s, d: entity.connected_components(_edges(s, d)))
register(
    "neighbourhood_3hop",
    f"""WITH RECURSIVE e AS ({_EDGES}), n AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e),
    r AS (SELECT c_custkey AS node, 0 AS hop FROM customer WHERE c_acctbal < 0 UNION SELECT n.y, r.hop + 1 FROM r JOIN n ON r.node = n.x WHERE r.hop < 3)
    SELECT node, min(hop) AS hop FROM r GROUP BY node""",
)(lambda s, d: entity.neighbourhood(_edges(s, d).withColumn("edge_id", F.concat_ws("-", "a", "b")), table(s, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").cast("long").alias("node"))).select("node", "hop"))
register(
    "component_merge",
    "SELECT c_nationkey AS component, min(c_custkey) AS canonical, list_sort(list(c_custkey)) AS aliases, arg_min(CASE WHEN c_custkey % 3 = 0 THEN c_name END, CASE WHEN c_custkey % 3 = 0 THEN c_custkey END) AS name FROM customer GROUP BY 1",
)(
    lambda s, d: entity.merge(
        table(s, d, "customer").select(F.col("c_nationkey").alias("component"), "c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).alias("name")), "component", "c_custkey", ["name"]
    )
)
register(
    "weak_collisions",
    "SELECT identity, list_sort(list(DISTINCT c_custkey)) AS ids FROM (SELECT c_custkey, c_mktsegment || '|' || c_nationkey || '|' || (c_custkey % 50) AS identity FROM customer) GROUP BY identity HAVING count(DISTINCT c_custkey) > 1",
)(lambda s, d: entity.weak_collisions(table(s, d, "customer").select("c_custkey", F.concat_ws("|", "c_mktsegment", "c_nationkey", F.col("c_custkey") % 50).alias("identity")), "identity", "c_custkey"))


@register(
    "manager_prediction",
    """WITH p AS (SELECT s_nationkey AS company, s_suppkey AS person, s_suppkey % 13 AS rank, 'team' || (s_suppkey % 3) AS team, s_suppkey % 5 AS city, s_suppkey % 17 AS years FROM supplier),
    x AS (SELECT p.person, m.person AS manager, CASE p.rank - m.rank WHEN 1 THEN 10 WHEN 2 THEN 5 ELSE 0 END + CASE WHEN p.team = m.team THEN 8 ELSE 0 END + CASE WHEN p.city = m.city THEN 2 ELSE 0 END + CASE WHEN m.years - p.years >= 3 THEN 2 ELSE 0 END AS score
          FROM p JOIN p m ON p.company = m.company AND m.rank < p.rank AND m.rank >= p.rank - 2)
    SELECT person, manager, score FROM (SELECT *, row_number() OVER (PARTITION BY person ORDER BY score DESC, manager) AS r FROM x WHERE score >= 5) WHERE r = 1""",
)
def manager_prediction(spark, sf_dir):
    s = F.col("s_suppkey")
    people = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("company"), s.alias("person"), (s % 13).alias("rank"), F.concat(F.lit("team"), (s % 3).cast("string")).alias("team"), (s % 5).alias("city"), (s % 17).alias("years"))
    return entity.predict_manager(people)


register(
    "edge_violations",
    "WITH e AS (SELECT s_suppkey AS edge_id, s_suppkey % 10 AS a, s_suppkey % 7 AS b, CASE WHEN s_suppkey % 11 = 0 THEN 'odd' ELSE 'reports_to' END AS type, (s_suppkey % 4) / 4.0 AS confidence FROM supplier) SELECT edge_id, unnest(list_filter([CASE WHEN a = b THEN 'self_edge' END, CASE WHEN a > 8 OR b > 8 THEN 'unknown_node' END, CASE WHEN type <> 'reports_to' THEN 'unknown_type' END, CASE WHEN confidence < 0.5 THEN 'low_confidence' END], lambda x: x IS NOT NULL)) AS problem FROM e",
)(
    lambda s, d: entity.edge_violations(
        table(s, d, "supplier").select(F.col("s_suppkey").alias("edge_id"), (F.col("s_suppkey") % 10).alias("a"), (F.col("s_suppkey") % 7).alias("b"), F.when(F.col("s_suppkey") % 11 == 0, "odd").otherwise("reports_to").alias("type"), (F.col("s_suppkey") % 4 / 4.0).alias("confidence")),
        s.range(9).select(F.col("id").alias("node")),
        ["reports_to"],
        0.5,
    )
)
register("hiring_velocity", "SELECT c_mktsegment, count(*) FILTER (t < 90) AS recent, count(*) AS headcount, count(*) FILTER (t < 90)::DOUBLE / count(*) AS ratio, CASE WHEN count(*) FILTER (t < 90)::DOUBLE / count(*) >= 0.3 THEN 'HIGH' WHEN count(*) FILTER (t < 90)::DOUBLE / count(*) >= 0.15 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM (SELECT c_mktsegment, c_custkey % 500 AS t FROM customer) GROUP BY 1")(
    lambda s, d: entity.hiring_velocity(table(s, d, "customer").select("c_mktsegment", (F.col("c_custkey") % 500).alias("t")), "c_mktsegment", "t")
)
