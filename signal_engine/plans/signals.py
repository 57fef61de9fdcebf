"""Signal-analysis queries: keyword lift, roles, coverage, profiles, relevance and snippets."""

from pyspark.sql import functions as F

from signal_engine.catalogue import register, table
from signal_engine.functions import text as tx
from signal_engine.operators import joins, signals

KEYWORDS = ("the", "tion", "heit", "idiot", "license")
KEYWORD_SQL = "unnest(['the', 'tion', 'heit', 'idiot', 'license'])"

_COUNTS_SQL = f"""
WITH d AS (SELECT lower(coalesce(text, '')) AS t, lower(coalesce(source, '')) AS s, l.quality = 1 AS won
           FROM documents JOIN labels l USING (doc_id)),
k AS (SELECT {KEYWORD_SQL} AS keyword),
tot AS (SELECT count(*) FILTER (won) AS w, count(*) FILTER (NOT won) AS l FROM d),
c AS (SELECT keyword,
        count(*) FILTER (won AND contains(t || ' ' || s, keyword)) AS won_hits,
        count(*) FILTER (NOT won AND contains(t || ' ' || s, keyword)) AS lost_hits,
        count(*) FILTER (contains(t, keyword) AND NOT contains(s, keyword)) AS website_only,
        count(*) FILTER (NOT contains(t, keyword) AND contains(s, keyword)) AS jobs_only,
        count(*) FILTER (contains(t, keyword) AND contains(s, keyword)) AS "both"
      FROM d, k GROUP BY keyword),
r AS (SELECT c.*, round(((won_hits + 0.5::DOUBLE) / (w + 1)) / ((lost_hits + 0.5::DOUBLE) / (l + 1)), 2) AS lift FROM c, tot)
SELECT * FROM r"""


def _counts(spark, sf_dir):
    rows = (
        table(spark, sf_dir, "documents")
        .select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("t"), F.lower(F.coalesce("source", F.lit(""))).alias("s"))
        .join(table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("won")), "doc_id")
    )
    return signals.keyword_counts(rows, KEYWORDS, F.col("won"), F.col("t"), F.col("s"))


register("lift_by_keyword", _COUNTS_SQL)(_counts)
register("tool_lift_min_support", _COUNTS_SQL + " WHERE won_hits >= 2 OR lost_hits >= 1")(lambda s, d: signals.with_support(_counts(s, d)))
register("anti_fit_signals", _COUNTS_SQL + " WHERE lift < 1.0 AND lost_hits >= 3")(lambda s, d: signals.anti_fit(_counts(s, d), below=1.0))


@register(
    "role_prevalence",
    """WITH d AS (SELECT lower(coalesce(text, '')) AS t, role = 'assistant' AS won FROM conversations),
    x AS (SELECT count(*) FILTER (won AND t <> '') AS w, count(*) FILTER (NOT won AND t <> '') AS l,
      count(*) FILTER (won AND (contains(t, 'the ') OR contains(t, 'and '))) AS w0, count(*) FILTER (NOT won AND (contains(t, 'the ') OR contains(t, 'and '))) AS l0,
      count(*) FILTER (won AND (contains(t, 'der ') OR contains(t, 'die '))) AS w1, count(*) FILTER (NOT won AND (contains(t, 'der ') OR contains(t, 'die '))) AS l1 FROM d)
    SELECT w, l, 'en' AS role, w0 AS won_hits, l0 AS lost_hits FROM x UNION ALL SELECT w, l, 'de', w1, l1 FROM x""",
)
def role_prevalence(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.lower(F.coalesce("text", F.lit(""))).alias("t"), (F.col("role") == "assistant").alias("won"))
    return signals.role_prevalence(rows, {"en": ("the ", "and "), "de": ("der ", "die ")}, F.col("t"), F.col("won"))


register(
    "coverage_stats",
    """SELECT lang, count(*) AS n, count(*) FILTER (length(text) > 100) AS covered, round(100 * count(*) FILTER (length(text) > 100)::DOUBLE / count(*), 1) AS pct,
       round(avg(length(text)) FILTER (length(text) > 100), 1) AS avg_chars FROM documents GROUP BY lang""",
)(lambda s, d: signals.coverage(table(s, d, "documents"), "lang", F.col("text")))

register(
    "column_profile",
    """SELECT 'lang' AS "column", count(lang) AS present, count(*) - count(lang) AS missing, count(DISTINCT lang) AS distinct_values FROM documents
       UNION ALL SELECT 'source', count(source), count(*) - count(source), count(DISTINCT source) FROM documents
       UNION ALL SELECT 'n_chars', count(n_chars), count(*) - count(n_chars), count(DISTINCT n_chars) FROM documents""",
)(lambda s, d: signals.column_profile(table(s, d, "documents"), ["lang", "source", "n_chars"]))

register(
    "confusion_matrix",
    """WITH x AS (SELECT count(*) FILTER (quality = 1 AND toxic = 0) AS tp, count(*) FILTER (quality <> 1 AND toxic = 0) AS fp,
       count(*) FILTER (quality = 1 AND toxic <> 0) AS fn, count(*) FILTER (quality <> 1 AND toxic <> 0) AS tn FROM labels),
       y AS (SELECT *, tp::DOUBLE / (tp + fp) AS precision, tp::DOUBLE / (tp + fn) AS recall FROM x)
       SELECT *, 2 * precision * recall / (precision + recall) AS f1 FROM y""",
)(lambda s, d: signals.confusion(table(s, d, "labels"), F.col("quality") == 1, F.col("toxic") == 0))

register(
    "mismatch_rate", "SELECT avg((toxic = 1)::INT::DOUBLE) AS rate, avg((toxic = 1)::INT::DOUBLE) > 0.2 AS warning FROM labels"
)(lambda s, d: signals.mismatch_rate(table(s, d, "labels"), F.col("toxic") == 1))


@register(
    "snippet_evidence",
    """WITH x AS (SELECT doc_id, text AS b, instr(lower(text), 'license') AS pos FROM documents WHERE contains(lower(text), 'license')),
    y AS (SELECT *, greatest(1, pos - 40) AS f, least(length(b), pos + 6 + 40) AS l FROM x),
    z AS (SELECT *, substr(b, f, l - f + 1) AS cut FROM y),
    w AS (SELECT *, CASE WHEN f > 1 THEN '...' || regexp_replace(cut, '^\\S*\\s', '') ELSE cut END AS lft FROM z)
    SELECT doc_id, trim(regexp_replace(CASE WHEN l < length(b) THEN regexp_replace(lft, '\\s\\S*$', '') || '...' ELSE lft END, '\\s+', ' ', 'g')) AS snippet FROM w""",
)
def snippet_evidence(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select("doc_id", tx.snippet(F.col("text"), F.lit("license")).alias("snippet"))
    return found.where("snippet IS NOT NULL")


_TOKENS_SQL = r"list_distinct(list_filter(string_split(trim(regexp_replace(lower(coalesce({}, '')), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' '), lambda w: length(w) > 1{}))"


@register(
    "jaccard_pairs",
    f"""WITH a AS (SELECT p_partkey, {_TOKENS_SQL.format("p_name", "")} AS t, p_brand FROM part),
    b AS (SELECT p_partkey AS other, t AS u, p_brand FROM a)
    SELECT p_partkey, other, round(len(list_intersect(t, u))::DOUBLE / len(list_distinct(list_concat(t, u))), 6) AS similarity
    FROM a JOIN b USING (p_brand) WHERE p_partkey < other""",
)
def jaccard_pairs(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_brand", tx.tokens(F.col("p_name")).alias("tokens"))
    return joins.similar_within(rows, "p_brand", 6).select(F.col("id").alias("p_partkey"), "other", "similarity")


_STOP = ", ".join(f"'{w}'" for w in tx.RELEVANCE_STOPWORDS)


@register(
    "token_overlap_relevance",
    f"""WITH q AS (SELECT ['edion', 'latest', 'erthat'] AS q, ['edion', 'erthat'] AS inf),
    v AS (SELECT doc_id, {_TOKENS_SQL.format("text", f" AND w NOT IN ({_STOP})")} AS v,
                 trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS plain FROM documents),
    x AS (SELECT doc_id, len(list_intersect(q, v)) AS h, len(list_intersect(inf, v)) AS hi, len(v) AS nv, contains(plain, 'edion latest erthat') AS phrase FROM v, q),
    y AS (SELECT *, 0.55 * pow(h / 3::DOUBLE, 1.35) + 0.25 * hi / 2 + 0.2 * (h::DOUBLE / greatest(1, least(nv, 7))) AS base FROM x)
    SELECT doc_id, round(CASE WHEN h = 0 THEN 0.0 WHEN hi = 0 THEN least(0.24, base) ELSE greatest(0.0, least(1.0, base + CASE WHEN phrase THEN 0.12 ELSE 0 END)) END, 6) AS relevance FROM y""",
)
def token_overlap_relevance(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(tx.token_overlap_relevance(F.lit("the edion latest erthat"), F.col("text")), 6).alias("relevance"))


register(
    "semantic_metric_by_quarter",
    """SELECT date_trunc('quarter', o_orderdate) AS quarter, o_orderstatus AS status, count(*) AS orders, round(sum(o_totalprice), 2) AS revenue
       FROM orders WHERE o_totalprice > 1000 AND o_orderpriority = '1-URGENT' GROUP BY 1, 2""",
)(
    lambda s, d: signals.metrics(
        table(s, d, "orders"),
        {"orders": F.count("*"), "revenue": F.round(F.sum("o_totalprice"), 2)},
        ["orders", "revenue"],
        {"quarter": F.date_trunc("quarter", "o_orderdate").cast("timestamp_ntz"), "status": F.col("o_orderstatus")},
        base=F.col("o_totalprice") > 1000,
        filters=[F.col("o_orderpriority") == "1-URGENT"],
    )
)
register(
    "semantic_latest_periods",
    """SELECT date_trunc('month', o_orderdate) AS month, count(*) AS orders FROM orders GROUP BY 1 ORDER BY 1 DESC LIMIT 6""",
)(lambda s, d: signals.metrics(table(s, d, "orders"), {"orders": F.count("*")}, ["orders"], {"month": F.date_trunc("month", "o_orderdate").cast("timestamp_ntz")}, limit=6, order=[F.desc("month")]))
