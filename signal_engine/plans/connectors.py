"""Connector scores and role lookups over customers and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from signal_engine.catalogue import register, table
from signal_engine.operators import connectors

AS_OF = "1999-06-30"
_CONFIDENCE = ["low", "medium", "high", " Confirmed", "unknown", "", None]
_KINDS_SQL = """SELECT c_custkey AS c, kind, v FROM (SELECT c_custkey, unnest([
  {'kind': 'direct_intro', 'v': CASE WHEN c_custkey % 11 = 0 THEN 'intro-' || c_custkey END}, {'kind': 'evidence', 'v': CASE WHEN c_custkey % 4 = 0 THEN 'note-' || c_custkey END},
  {'kind': 'school', 'v': CASE WHEN c_custkey % 6 = 0 THEN 'School ' || (c_custkey % 4) END}, {'kind': 'city', 'v': CASE WHEN c_custkey % 10 = 0 THEN 'City ' || c_nationkey END},
  {'kind': 'role_industry', 'v': CASE WHEN c_custkey % 9 = 0 THEN lower(c_mktsegment) END}, {'kind': 'investor', 'v': CASE WHEN c_custkey % 3 = 0 THEN 'Fund A' END},
  {'kind': 'investor', 'v': CASE WHEN c_custkey % 5 = 0 THEN 'Fund B' END}, {'kind': 'investor', 'v': CASE WHEN c_custkey % 15 = 0 THEN 'Fund C' END}, {'kind': 'investor', 'v': CASE WHEN c_custkey % 30 = 0 THEN 'Fund D' END}], recursive := true) FROM customer) WHERE v IS NOT NULL"""


def _roles(spark, sf_dir):
    k, d = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    company = F.concat(F.lit("Acme"), (k % 30).cast("string"), F.when(k % 3 == 0, " Inc.").when(k % 3 == 1, " Labs").otherwise(""))
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("person"), F.concat(F.lit("role-"), k.cast("string")).alias("role_id"), company.alias("company"), d.alias("start"), F.when(k % 7 != 0, F.date_add(d, (k % 900).cast("int"))).alias("end"), (k % 14 == 0).alias("is_current"))


def _signals(spark, sf_dir):
    k = F.col("c_custkey")
    text = k.cast("string")
    kinds = [
        ("direct_intro", F.when(k % 11 == 0, F.concat(F.lit("intro-"), text))), ("evidence", F.when(k % 4 == 0, F.concat(F.lit("note-"), text))), ("school", F.when(k % 6 == 0, F.concat(F.lit("School "), (k % 4).cast("string")))),
        ("city", F.when(k % 10 == 0, F.concat(F.lit("City "), F.col("c_nationkey").cast("string")))), ("role_industry", F.when(k % 9 == 0, F.lower("c_mktsegment"))),
        *[("investor", F.when(k % m == 0, f"Fund {n}")) for m, n in ((3, "A"), (5, "B"), (15, "C"), (30, "D"))],
    ]
    each = F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), v.alias("value")) for kind, v in kinds]))
    return table(spark, sf_dir, "customer").select(k.alias("connector"), (k + 1).alias("target"), each.alias("s")).select("connector", "target", "s.*")


@register(
    "target_connectors",
    f"""WITH p AS (SELECT a.c_custkey AS c, b.c_custkey AS t, coalesce(nullif(lower(trim([{", ".join("NULL" if x is None else f"'{x}'" for x in _CONFIDENCE)}][a.c_custkey % {len(_CONFIDENCE)} + 1])), ''), 'unknown') AS conf FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1),
r AS (SELECT o_custkey AS person, 'role-' || o_orderkey AS role, 'Acme' || (o_orderkey % 30) || CASE o_orderkey % 3 WHEN 0 THEN ' Inc.' WHEN 1 THEN ' Labs' ELSE '' END AS company, 'acme' || (o_orderkey % 30) || CASE o_orderkey % 3 WHEN 1 THEN ' labs' ELSE '' END AS ident,
  o_orderdate::DATE AS s, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate::DATE + (o_orderkey % 900)::INTEGER WHEN o_orderkey % 14 = 0 THEN DATE '{AS_OF}' END AS e FROM orders),
m AS (SELECT p.c, p.t, a.company, a.ident, a.role AS ra, b.role AS rb, greatest(a.s, b.s) AS os, least(a.e, b.e, DATE '{AS_OF}') AS oe, a.ident = b.ident AND a.e IS NOT NULL AND b.e IS NOT NULL AND greatest(a.s, b.s) <= least(a.e, b.e, DATE '{AS_OF}') AS ov
  FROM p JOIN r a ON a.person = p.c JOIN r b ON b.person = p.t WHERE list_has_all(string_split(a.ident, ' '), string_split(b.ident, ' ')) OR list_has_all(string_split(b.ident, ' '), string_split(a.ident, ' '))),
w AS (SELECT c, t, count(*) FILTER (ov) AS n, arg_min(company || ', ' || os || ' to ' || oe, (os, oe, ident, company)) FILTER (ov) AS first, list_sort(list(DISTINCT company)) AS companies, list(DISTINCT ra) FILTER (ov) AS r1, list(DISTINCT rb) FILTER (ov) AS r2 FROM m GROUP BY 1, 2),
k AS ({_KINDS_SQL}),
g AS (SELECT c, coalesce(list(v ORDER BY v) FILTER (kind = 'direct_intro'), []) AS di, coalesce(list(v) FILTER (kind = 'evidence'), []) AS ev, coalesce(list(v ORDER BY kind = 'city') FILTER (kind IN ('school', 'city')), []) AS com, coalesce(list(v) FILTER (kind = 'role_industry'), []) AS ri, coalesce(list(v ORDER BY v) FILTER (kind = 'investor'), []) AS inv FROM k GROUP BY 1),
x AS (SELECT p.c, p.t, conf, coalesce(n, 0) AS n, first, coalesce(companies, []) AS companies, coalesce(r1, []) AS r1, coalesce(r2, []) AS r2, coalesce(di, []) AS di, coalesce(ev, []) AS ev, coalesce(com, []) AS com, coalesce(ri, []) AS ri, coalesce(inv, []) AS inv FROM p LEFT JOIN w USING (c, t) LEFT JOIN g ON g.c = p.c),
y AS (SELECT *, CASE WHEN len(di) > 0 THEN 160.0 ELSE 0.0 END::DOUBLE AS s1, CASE WHEN n > 0 THEN 80.0 ELSE 0.0 END::DOUBLE AS s2, CASE conf WHEN 'low' THEN 5.0 WHEN 'medium' THEN 10.0 WHEN 'high' THEN 15.0 WHEN 'confirmed' THEN 15.0 ELSE 0.0 END::DOUBLE AS s3,
  CASE WHEN len(com) > 0 THEN 40.0 ELSE 0.0 END::DOUBLE AS s4, CASE WHEN len(ri) > 0 THEN 20.0 ELSE 0.0 END::DOUBLE AS s5, least(len(inv), 3)::DOUBLE AS s6,
  CASE WHEN len(di) > 0 THEN 'direct_introduction' WHEN n > 0 THEN 'verified_work_overlap' WHEN len(companies) > 0 THEN 'company_proximity' WHEN len(com) > 0 THEN 'school_city_community' WHEN len(ri) > 0 THEN 'role_industry' WHEN len(inv) > 0 THEN 'investor_overlap' ELSE '' END AS sig FROM x)
SELECT c AS connector, t AS target, conf AS relationship_confidence, s1 AS direct_intro_score, s2 AS work_overlap_score, s3 AS relationship_score, s4 AS school_city_community_score, s5 AS role_industry_score, s6 AS investor_score, s1 + s2 + s3 + s4 + s5 + s6 AS score, sig AS shared_signal,
  CASE sig WHEN 'direct_introduction' THEN array_to_string(di, '; ') WHEN 'verified_work_overlap' THEN first WHEN 'company_proximity' THEN companies[1] || '; employment dates unavailable or non-overlapping' WHEN 'school_city_community' THEN array_to_string(com, '; ') WHEN 'role_industry' THEN array_to_string(ri, '; ') WHEN 'investor_overlap' THEN array_to_string(inv, '; ') ELSE '' END AS shared_detail,
  CASE WHEN s1 + s2 > 0 AND s3 > 0 THEN 'strong_warm_intro' WHEN sig NOT IN ('', 'investor_overlap') THEN 'review_warm_intro' ELSE 'no_strong_path' END AS segment, companies AS shared_companies, list_sort(list_distinct(list_concat(di, ev, r1, r2))) AS evidence_ids FROM y""",
)
def target_connectors(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("connector"))
    pairs = c.join(c.select((F.col("connector") - 1).alias("connector")), "connector").withColumn("target", F.col("connector") + 1)
    pairs = pairs.withColumn("confidence", F.get(F.array(*map(F.lit, _CONFIDENCE)), (F.col("connector") % len(_CONFIDENCE)).cast("int")))
    return connectors.target_connectors(pairs, _roles(spark, sf_dir), _signals(spark, sf_dir), F.to_date(F.lit(AS_OF)))


@register("latest_role", "SELECT o_custkey AS person, arg_min('role-' || o_orderkey, (-(o_orderdate::DATE - DATE '1970-01-01'), 'role-' || o_orderkey)) AS role_id FROM orders WHERE o_orderkey % 7 = 0 OR o_orderkey % 3 = 0 GROUP BY 1")
def latest_role(spark, sf_dir):
    number = F.substring("role_id", 6, 20).cast("long")
    return connectors.latest_role(_roles(spark, sf_dir), "person", F.col("start"), F.col("end").isNull() | (number % 3 == 0), "role_id").select("person", "role_id")


@register("last_row_wins", "SELECT c_custkey, f.s AS last_status, f.p AS last_priority FROM customer LEFT JOIN (SELECT o_custkey, arg_max({'s': CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END, 'p': o_orderpriority}, o_orderkey) AS f FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def last_row_wins(spark, sf_dir):
    facts = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("last_status"), F.col("o_orderpriority").alias("last_priority"))
    return connectors.last_wins(table(spark, sf_dir, "customer").select("c_custkey"), facts, "c_custkey", "o_orderkey", ["last_status", "last_priority"])


@register("affiliated_contacts", "SELECT DISTINCT c_custkey, c_name FROM customer JOIN orders ON o_custkey = c_custkey WHERE lower('Fund ' || o_orderpriority || ' Partners') LIKE lower('%d 1-urg%')")
def affiliated_contacts(spark, sf_dir):
    held = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("contact_id"), F.concat(F.lit("Fund "), "o_orderpriority", F.lit(" Partners")).alias("entity_name"))
    return connectors.affiliated(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), held, "c_custkey", "D 1-URG")
