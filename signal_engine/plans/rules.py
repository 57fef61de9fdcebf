"""Text rules over the given tables: names, titles, error messages, research questions, hosts."""

from __future__ import annotations

from pyspark.sql import functions as F

from signal_engine.catalogue import register, table
from signal_engine.functions import text as tx
from signal_engine.operators import campaign, enrichment

# names: those of a customer's record against those of a profile, both by the key
_FIRST = ["Rob", "robert", "Bill", "J", "Mary Ann", "Liz", "Anna", "Ed", "Theodore", "Jon", "Max", "Zoë"]
_FULL = ["Robert", "William", "Jane", "Mary", "Elizabeth", "Ann", "Edward", "Ted", "John", "Maximilian", "Zoe", "R"]
_LAST, _OTHER = ["Smith", "Lee-Jones", "O'Neill", "Poe", "P", "de la Cruz"], ["Smith Jones", "Jones", "ONeill", "Poe (she)", "Pabiot", "Cruz"]


def _pick(names: list[str], at):
    return F.get(F.array(*map(F.lit, names)), at.cast("int"))


def _sql_list(names: list[str]) -> str:
    return "[" + ", ".join("'" + n.replace("'", "''") + "'" for n in names) + "]"


_NICK_SQL = "MAP {" + ", ".join(f"'{k}': {_sql_list(list(v))}" for k, v in campaign.NICKNAMES.items()) + "}"


@register(
    "names_match",
    f"""WITH x AS (SELECT c_custkey AS k, {_sql_list(_FIRST)}[c_custkey % 12 + 1] AS f, {_sql_list(_LAST)}[c_custkey // 12 % 6 + 1] AS l, {_sql_list(_FULL)}[c_custkey // 5 % 12 + 1] AS pf, {_sql_list(_OTHER)}[c_custkey // 3 % 6 + 1] AS pl FROM customer),
    n AS (SELECT k, {", ".join(f"trim(regexp_replace(lower(strip_accents({c})), '[^a-z -]', '', 'g')) AS {c}" for c in ("f", "l", "pf", "pl"))} FROM x),
    w AS (SELECT *, list_append(coalesce(({_NICK_SQL})[f], []), f) AS fv, list_append(coalesce(({_NICK_SQL})[pf], []), pf) AS pv FROM n)
    SELECT k, (f = pf OR (length(f) >= 3 AND (starts_with(f, pf) OR starts_with(pf, f))) OR list_has_any(fv, pv) OR (length(f) = 1 AND starts_with(pf, f)) OR (length(pf) = 1 AND starts_with(f, pf))
        OR (contains(f, ' ') AND len(list_filter(string_split(f, ' '), lambda p: p = pf OR (length(p) >= 3 AND (starts_with(p, pf) OR starts_with(pf, p))) OR list_has_any(list_append(coalesce(({_NICK_SQL})[p], []), p), pv))) > 0))
      AND (l = pl OR list_has_any(string_split(replace(l, '-', ' '), ' '), string_split(replace(pl, '-', ' '), ' ')) OR contains(l, pl) OR contains(pl, l)) AS ok FROM w""",
)
def names_match(spark, sf_dir):
    k = F.col("c_custkey")
    full = F.concat(_pick(_FULL, F.floor(k / 5) % 12), F.lit(" "), _pick(_OTHER, F.floor(k / 3) % 6))
    return table(spark, sf_dir, "customer").select(k.alias("k"), campaign.names_match(_pick(_FIRST, k % 12), _pick(_LAST, F.floor(k / 12) % 6), full).alias("ok"))


_TITLES = ["CEO", "Chief Data Officer", "CTO and founder", "EVP Sales", "Senior Vice President", "VP Marketing", "Senior Director", "Head of Ops", "Director, People", "Senior Manager", "Manager", "Staff Engineer", "Principal", "Tech Lead", "Sr. Analyst", "Senior Engineer", "Engineer", ""]


@register(
    "seniority",
    f"""WITH t AS (SELECT c_custkey, lower({_sql_list(_TITLES)}[c_custkey % {len(_TITLES)} + 1] || CASE WHEN c_custkey % 5 = 0 THEN ', ' || c_mktsegment ELSE '' END) AS t, c_custkey % 31 AS months FROM customer),
    r AS (SELECT *, CASE WHEN regexp_matches(t, '\\bceo\\b|chief executive') THEN 0 WHEN regexp_matches(t, '\\bchief\\b|\\bc[tfomr]o\\b') THEN 1 WHEN t LIKE '%executive vice president%' OR regexp_matches(t, '\\bevp\\b') THEN 2
      WHEN t LIKE '%senior vice president%' OR regexp_matches(t, '\\bsvp\\b') THEN 3 WHEN t LIKE '%vice president%' OR regexp_matches(t, '\\bvp\\b') THEN 4 WHEN t LIKE '%senior director%' THEN 5 WHEN t LIKE '%head of%' OR t LIKE '%director%' THEN 6
      WHEN t LIKE '%senior manager%' THEN 7 WHEN t LIKE '%manager%' THEN 8 WHEN t LIKE '%principal%' OR t LIKE '%staff%' THEN 9 WHEN regexp_matches(t, '\\blead\\b') THEN 10 WHEN regexp_matches(t, '\\bsenior\\b|\\bsr\\.') THEN 11 ELSE 12 END AS rank FROM t)
    SELECT c_custkey, rank, CASE WHEN rank <= 4 THEN 'exec' WHEN rank <= 6 THEN 'director' WHEN rank <= 10 THEN 'manager' ELSE 'ic' END AS level, CASE WHEN rank BETWEEN 5 AND 8 AND months < 6 THEN rank + 1 WHEN rank BETWEEN 5 AND 8 AND months >= 24 THEN rank - 1 ELSE rank END AS effective FROM r""",
)
def seniority(spark, sf_dir):
    k = F.col("c_custkey")
    title = F.concat(_pick(_TITLES, k % len(_TITLES)), F.when(k % 5 == 0, F.concat(F.lit(", "), "c_mktsegment")).otherwise(""))
    rank = tx.seniority_rank(title)
    return table(spark, sf_dir, "customer").select("c_custkey", rank.alias("rank"), tx.seniority_level(rank).alias("level"), tx.effective_rank(rank, k % 31).alias("effective"))


@register(
    "error_classes",
    """SELECT doc_id, CASE WHEN regexp_matches(t, '422|validation failed|schema|invalid response|malformed') THEN 'schema-drift' WHEN regexp_matches(t, '401|403|auth|credential|permission|entitlement') THEN 'auth-failed'
      WHEN regexp_matches(t, '429|rate.?limit') THEN 'rate-limited' WHEN regexp_matches(t, 'timeout|timed out') THEN 'timeout' WHEN regexp_matches(t, 'network|unreachable|dns|connect') THEN 'unreachable' ELSE 'error' END AS class FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)""",
)
def error_classes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.error_class(F.col("text")).alias("class"))


# a question for each part: the form by the key, the subject from its name
_FORMS = ["{} vs {}", "how to configure {}", "{} pricing", "should i trust {}", "forecast for {}", "what is {}", "latest on {}", "{}", "{} migrate to {}", "difference between {} and {}"]
_QUESTION_SQL = f"replace({_sql_list(_FORMS)}[p_partkey % 10 + 1], '{{}}', p_name)"
_TYPE_SQL = "CASE " + " ".join("WHEN regexp_matches(topic, '(?i)\\b(?:" + pattern.replace("'", "''") + ")\\b') THEN '" + name + "'" for name, pattern in tx.QUERY_TYPES) + " ELSE 'breaking_news' END"


def _questions(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.replace(_pick(_FORMS, F.col("p_partkey") % 10), F.lit("{}"), F.col("p_name")).alias("topic"))


@register("query_types", f"SELECT p_partkey, {_TYPE_SQL} AS type FROM (SELECT p_partkey, {_QUESTION_SQL} AS topic FROM part)")
def query_types(spark, sf_dir):
    return _questions(spark, sf_dir).select("p_partkey", tx.query_type(F.col("topic")).alias("type"))


_VARIANTS = [("product", "web", "site", "plans"), ("concept", "web", "top", "2024"), ("concept", "forum", "", "thread"), ("how_to", "video", "", "guide"), ("breaking_news", "news", "today", "")]


@register(
    "query_variants",
    f"""WITH q AS (SELECT topic, {_TYPE_SQL} AS type FROM (SELECT DISTINCT {_QUESTION_SQL} AS topic FROM part)), r(type, source, prefix, suffix) AS (VALUES {", ".join(f"{v}" for v in _VARIANTS)})
    SELECT topic, source, trim(concat_ws(' ', prefix, array_to_string(list_filter(string_split(lower(topic), ' '), lambda w: w NOT IN {tx.RELEVANCE_STOPWORDS + tx.LOW_SIGNAL_WORDS}), ' '), suffix)) AS query FROM q JOIN r USING (type)""",
)
def query_variants(spark, sf_dir):
    rules = spark.createDataFrame(_VARIANTS, "type string, source string, prefix string, suffix string")
    return enrichment.query_variants(_questions(spark, sf_dir).select("topic").distinct(), rules)


@register(
    "role_similarity",
    """WITH x AS (SELECT a.p_partkey, list_distinct(string_split(a.p_name, ' ')) AS v, list_distinct(string_split(lower(b.p_name || ' ' || b.p_type), ' ')) AS w FROM part a JOIN part b ON b.p_partkey = a.p_partkey // 2)
    SELECT p_partkey, round(len(list_intersect(v, w))::DOUBLE / greatest(len(v), len(w)), 6) AS s FROM x""",
)
def role_similarity(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    other = p.select(F.col("p_partkey").alias("half"), F.concat_ws(" ", "p_name", "p_type").alias("other"))
    both = p.withColumn("half", F.floor(F.col("p_partkey") / 2).cast("long")).join(other, "half")
    return both.select("p_partkey", F.round(tx.role_similarity(F.col("p_name"), F.col("other")), 6).alias("s"))


_HOSTS = ["medium.com", "notes.substack.com", "ab.example.net", "x.io", "github.io", "wordpress.org", "mediums.com"]


@register(
    "suspicious_domains",
    rf"""WITH h AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN {_sql_list(_HOSTS)}[page_id // 2 % {len(_HOSTS)} + 1] ELSE lower(regexp_extract(url, '://(?:www\.)?([^/?#:]+)', 1)) END AS host FROM pages)
    SELECT page_id, CASE WHEN regexp_matches(host, '(^|\.)(medium|substack|wordpress|blogspot|github|youtube|facebook|linkedin|twitter|wikipedia)\.(com|org|io)$') THEN 'content_platform' WHEN length(string_split(host, '.')[1]) <= 2 THEN 'short_label' END AS reason FROM h""",
)
def suspicious_domains(spark, sf_dir):
    host = F.when(F.col("page_id") % 2 == 0, _pick(_HOSTS, F.floor(F.col("page_id") / 2) % len(_HOSTS))).otherwise(tx.host_of(F.col("url")))
    return table(spark, sf_dir, "pages").select("page_id", tx.suspicious_domain(host).alias("reason"))


@register(
    "set_dedupe_keep_order",
    """WITH x AS (SELECT p_partkey, list_concat(string_split(p_name, ' '), [upper(p_type)], string_split(upper(p_name), ' '), [p_brand, lower(p_type), lower(p_brand)]) AS v FROM part)
    SELECT p_partkey, list_transform(list_filter(range(1, len(v) + 1), lambda i: list_position(list_transform(v, lambda y: lower(y)), lower(v[i])) = i), lambda i: v[i]) AS kept FROM x""",
)
def set_dedupe_keep_order(spark, sf_dir):
    values = F.concat(F.split("p_name", " "), F.array(F.upper("p_type")), F.split(F.upper("p_name"), " "), F.array(F.col("p_brand"), F.lower("p_type"), F.lower("p_brand")))
    kept = F.aggregate(values, F.array().cast("array<string>"), lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.concat(acc, F.array(x))))
    return table(spark, sf_dir, "part").select("p_partkey", kept.alias("kept"))
