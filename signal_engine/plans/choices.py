"""Choices by rounds, portfolios, causal order and component safety over the star schema and events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from signal_engine.catalogue import register, table
from signal_engine.operators import choosing, entity, graphs, portfolio

# diverse samples
_SAMPLE = 8


def _sample_sql(tokens: str, size: int) -> str:
    """CTEs p1, p2, ... of a farthest-point sample over t(id, tokens), whose definition is given."""
    steps = [
        f"t AS ({tokens})",
        "f AS (SELECT x, count(*) AS n FROM (SELECT unnest(tokens) AS x FROM t) GROUP BY x)",
        "w AS (SELECT id, list({'t': x, 'w': 1.0::DOUBLE / n} ORDER BY x) AS w FROM (SELECT id, unnest(tokens) AS x FROM t) JOIN f USING (x) GROUP BY id)",
        "s0 AS MATERIALIZED (SELECT id, tokens, coalesce(w, []) AS w, 1.0::DOUBLE AS least FROM t LEFT JOIN w USING (id))",
    ]
    for r in range(1, size + 1):
        steps += [
            f"p{r} AS MATERIALIZED (SELECT id, tokens FROM s{r - 1} ORDER BY round(least * 1000 + coalesce(list_sum(list_transform(w, lambda x: x.w)), 0), 9) DESC, id LIMIT 1)",
            f"s{r} AS MATERIALIZED (SELECT s.id, s.tokens, list_filter(s.w, lambda x: NOT list_contains(p.tokens, x.t)) AS w, least(s.least, CASE WHEN len(list_distinct(list_concat(s.tokens, p.tokens))) = 0 THEN 0.0 ELSE 1 - len(list_intersect(s.tokens, p.tokens))::DOUBLE / len(list_distinct(list_concat(s.tokens, p.tokens))) END) AS least FROM s{r - 1} s, p{r} p WHERE s.id <> p.id)",
        ]
    return "WITH " + ", ".join(steps)


_WORDS_SQL = "SELECT p_partkey AS id, list_sort(list_distinct(list_concat(string_split(p_name, ' '), [p_brand, p_type, 'size' || (p_size // 10)]))) AS tokens FROM part"


@register("diverse_sample", f"{_sample_sql(_WORDS_SQL, _SAMPLE)} {' UNION ALL '.join(f'SELECT {r} AS rank, id FROM p{r}' for r in range(1, _SAMPLE + 1))}")
def diverse_sample(spark, sf_dir):
    tokens = F.concat(F.split("p_name", " "), F.array("p_brand", "p_type", F.concat(F.lit("size"), F.floor(F.col("p_size") / 10).cast("string"))))
    return choosing.farthest_sample(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), tokens.alias("tokens")), "id", _SAMPLE)


_SHAPES_SQL = """SELECT c_custkey AS id, list_sort(list_concat(
  CASE WHEN c_acctbal < 0 THEN ['balance:missing'] ELSE ['balance:type:number'] END,
  CASE WHEN c_mktsegment IS NULL THEN ['segment:missing'] ELSE ['segment:type:string', 'segment:value:' || lower(c_mktsegment), 'segment:length:' || CASE WHEN length(c_mktsegment) < 16 THEN 'short' WHEN length(c_mktsegment) < 64 THEN 'medium' ELSE 'long' END] END,
  ['site:type:string', 'site:length:medium', 'site:host:' || lower(c_mktsegment) || '.' || (c_nationkey % 5) || '.example.org'])) AS tokens FROM customer"""


@register(
    "pilot_split",
    f"{_sample_sql(_SHAPES_SQL, 5)}, p AS ({' UNION ALL '.join(f'SELECT {r} AS rank, id FROM p{r}' for r in range(1, 6))}) SELECT c_custkey AS id, CASE WHEN rank <= 3 THEN 'pilot' WHEN rank IS NOT NULL THEN 'holdout' ELSE 'exploit' END AS role, rank, coalesce(rank <= 2, false) AS compared FROM customer LEFT JOIN p ON id = c_custkey",
)
def pilot_split(spark, sf_dir):
    site = F.concat(F.lit("https://"), "c_mktsegment", F.lit("."), (F.col("c_nationkey") % 5).cast("string"), F.lit(".example.org/c/"), F.col("c_custkey").cast("string"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"), site.alias("site"))
    return choosing.pilot_split(choosing.row_tokens(rows, "id", ["segment", "balance", "site"]), "id")


# greedy choices
_PICKS, _BUDGET = 5, 14.0


def _routes_sql() -> str:
    steps = [
        "q AS MATERIALIZED (SELECT l_suppkey AS s, l_partkey AS u, max(l_quantity)::BIGINT AS x FROM lineitem GROUP BY 1, 2)",
        "z AS (SELECT s_suppkey AS s, 1.0::DOUBLE + s_suppkey % 5 AS credits, 1 - (s_suppkey % 3) * 0.25::DOUBLE AS reliability, ['n' || s_nationkey, 'g' || (s_suppkey % 4)] AS tags FROM supplier)",
        "c0 AS (SELECT 0::BIGINT AS u, 0::BIGINT AS v WHERE false)",
        "t0 AS (SELECT * FROM z WHERE false)",
    ]
    for r in range(1, _PICKS + 1):
        steps += [
            f"""w{r} AS MATERIALIZED (SELECT s, marginal, novelty, credits, reliability, tags FROM (
                SELECT z.*, g.marginal, coalesce((SELECT min(1 - len(list_intersect(z.tags, t.tags))::DOUBLE / len(list_distinct(list_concat(z.tags, t.tags)))) FROM t{r - 1} t), 1.0) AS novelty, g.gain
                FROM z JOIN (SELECT s, sum(greatest(x - coalesce(v, 0), 0)) AS gain, count(*) FILTER (x > coalesce(v, 0)) AS marginal FROM q LEFT JOIN c{r - 1} c ON c.u = q.u GROUP BY s) g ON g.s = z.s
                WHERE z.s NOT IN (SELECT s FROM t{r - 1}) AND g.marginal > 0 AND z.credits + coalesce((SELECT sum(credits) FROM t{r - 1}), 0) <= {_BUDGET})
                ORDER BY round(gain * reliability / greatest(credits, 0.0001) + 0.15 * novelty, 9) DESC, marginal DESC, novelty DESC, credits, s LIMIT 1)""",
            f"t{r} AS MATERIALIZED (SELECT * FROM t{r - 1} UNION ALL SELECT s, credits, reliability, tags FROM w{r})",
            f"c{r} AS MATERIALIZED (SELECT u, max(x) AS v FROM q WHERE s IN (SELECT s FROM t{r}) GROUP BY u)",
        ]
    return f"WITH {', '.join(steps)} " + " UNION ALL ".join(f'SELECT {r} AS rank, s AS "set", marginal, (SELECT count(*) FROM c{r}) AS cumulative, novelty, credits FROM w{r}' for r in range(1, _PICKS + 1))


@register("route_selection", _routes_sql())
def route_selection(spark, sf_dir):
    pairs = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("set"), F.col("l_partkey").alias("unit")).agg(F.max("l_quantity").cast("long").alias("score"))
    s = F.col("s_suppkey")
    routes = table(spark, sf_dir, "supplier").select(
        s.alias("set"), (F.lit(1.0) + s % 5).alias("credits"), (1 - (s % 3) * 0.25).alias("reliability"), F.array(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")), F.concat(F.lit("g"), (s % 4).cast("string"))).alias("tags")
    )
    return choosing.select_routes(pairs, routes, _PICKS, _BUDGET)


def _features_sql() -> str:
    steps = ["q AS MATERIALIZED (SELECT DISTINCT o_custkey AS s, strftime(o_orderdate, '%Y-%m') AS u FROM orders)", "z AS (SELECT c_custkey AS s, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS credits FROM customer)", "t0 AS (SELECT 0::BIGINT AS s WHERE false)"]
    for r in range(1, _PICKS + 1):
        steps += [
            f"w{r} AS MATERIALIZED (SELECT z.s, coalesce(novel, 0) AS novel FROM z LEFT JOIN (SELECT s, count(*) AS novel FROM q WHERE u NOT IN (SELECT u FROM q WHERE s IN (SELECT s FROM t{r - 1})) GROUP BY s) g ON g.s = z.s WHERE z.s NOT IN (SELECT s FROM t{r - 1}) ORDER BY 2 DESC, credits NULLS LAST, z.s LIMIT 1)",
            f"t{r} AS MATERIALIZED (SELECT s FROM t{r - 1} UNION ALL SELECT s FROM w{r})",
        ]
    return f"WITH {', '.join(steps)} " + " UNION ALL ".join(f'SELECT {r} AS rank, s AS "set", novel FROM w{r}' for r in range(1, _PICKS + 1))


@register("feature_cover", _features_sql())
def feature_cover(spark, sf_dir):
    features = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("set"), F.date_format("o_orderdate", "yyyy-MM").alias("unit"))
    return choosing.cover_features(features, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("set"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("credits")), _PICKS)


_ROUTES = ["click", "purchase", "view", "signup"]


@register(
    "best_cover",
    """WITH u AS (SELECT DISTINCT user_id * 100000 + dayofyear(ts) AS unit, CASE event_type WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 WHEN 'view' THEN 4 ELSE 8 END AS b FROM events WHERE event_type IN ('click', 'purchase', 'view', 'signup')),
    g AS (SELECT unit, bit_or(b) AS bits FROM u GROUP BY 1), m AS (SELECT unnest(range(1, 16)) AS mask)
    SELECT mask::INTEGER AS mask, (mask & 1)::DOUBLE + 2.0 * ((mask >> 1) & 1) + 3.0 * ((mask >> 2) & 1) + 4.0 * ((mask >> 3) & 1) AS cost, (SELECT count(*) FROM g WHERE bits & mask <> 0) AS covered FROM m ORDER BY covered DESC, cost, mask LIMIT 1""",
)
def best_cover(spark, sf_dir):
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin(*_ROUTES))
    units = e.select((F.col("user_id") * 100000 + F.dayofyear("ts")).alias("unit"), F.col("event_type").alias("route"))
    return portfolio.best_cover(portfolio.set_covers(units, spark.createDataFrame([(r, float(i + 1)) for i, r in enumerate(_ROUTES)], "route string, credits double"), _ROUTES))


# portfolios of programs
_PROGRAMS, _CLAIMS, _LARGEST = [f"p{i}" for i in range(10)], ["view", "click", "signup"], 4


@register(
    "program_portfolios",
    f"""WITH x AS (SELECT user_id AS u, event_type AS c, bit_or(1 << (event_id % 10)::INTEGER) AS b FROM events WHERE value > 18 AND event_type IN ('view', 'click', 'signup') GROUP BY 1, 2),
k AS (SELECT u, coalesce(max(b) FILTER (c = 'view'), 0) AS b1, coalesce(max(b) FILTER (c = 'click'), 0) AS b2, coalesce(max(b) FILTER (c = 'signup'), 0) AS b3 FROM x GROUP BY 1),
n AS (SELECT event_id % 10 AS p, count(*) AS calls, CASE WHEN event_id % 10 <> 9 THEN 1.5 + event_id % 10 % 4 END AS credits FROM events GROUP BY ALL),
m AS (SELECT unnest(range(1, 1024))::INTEGER AS mask),
o AS (SELECT mask, bit_count(mask)::INTEGER AS size, (SELECT count(*) FROM k WHERE b1 & mask <> 0 AND b2 & mask <> 0 AND b3 & mask <> 0) AS complete, (SELECT count(*) FROM x WHERE b & mask <> 0) AS verified,
      (SELECT CASE WHEN count(credits) = count(*) THEN sum(credits) END FROM n WHERE (mask >> p::INTEGER) & 1 = 1)::DOUBLE AS credits, (SELECT sum(calls) FROM n WHERE (mask >> p::INTEGER) & 1 = 1)::BIGINT AS calls FROM m WHERE bit_count(mask) <= {_LARGEST} AND mask & 1 = 1)
SELECT *, NOT EXISTS (SELECT 1 FROM o b WHERE b.credits <= a.credits AND b.complete >= a.complete AND b.verified >= a.verified AND (b.credits < a.credits OR b.complete > a.complete OR b.verified > a.verified)) AS frontier,
       mask = (SELECT mask FROM o ORDER BY complete DESC, verified DESC, credits NULLS LAST, calls, size, mask LIMIT 1) AS winner FROM o a""",
)
def program_portfolios(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("program", F.concat(F.lit("p"), (F.col("event_id") % 10).cast("string")))
    programs = e.groupBy("program").agg(F.count("*").alias("calls"), F.first(F.when(F.col("event_id") % 10 != 9, 1.5 + F.col("event_id") % 10 % 4)).alias("credits"))
    return choosing.program_portfolios(e.where("value > 18").select(F.col("user_id").alias("unit"), F.col("event_type").alias("claim"), "program"), programs, _PROGRAMS, _CLAIMS, _LARGEST, ["p0"])


# causal order: an order depends on the one before it of the same customer and year; some also on the one after
_GRAPH_SQL = """WITH RECURSIVE g AS MATERIALIZED (SELECT lag(o_orderkey) OVER w AS a, o_orderkey AS b, o_orderpriority AS pr FROM orders WINDOW w AS (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderdate, o_orderkey)),
e AS MATERIALIZED (SELECT a, b FROM g WHERE a IS NOT NULL UNION SELECT b, a FROM g WHERE a IS NOT NULL AND pr = '1-URGENT' AND b % 3 = 0)"""


def _graph(spark, sf_dir):
    w = Window.partitionBy("o_custkey", F.year("o_orderdate")).orderBy("o_orderdate", "o_orderkey")
    g = table(spark, sf_dir, "orders").select(F.lag("o_orderkey").over(w).alias("a"), F.col("o_orderkey").alias("b"), "o_orderpriority").where("a IS NOT NULL")
    back = g.where("o_orderpriority = '1-URGENT' AND b % 3 = 0").select(F.col("b").alias("a"), F.col("a").alias("b"))
    return g.select("a", "b").unionByName(back).distinct()


@register(
    "causal_closure",
    f"{_GRAPH_SQL}, r AS (SELECT o_orderkey AS seed, b AS node, 1 AS depth FROM orders JOIN e ON a = o_orderkey WHERE o_orderstatus = 'F' UNION SELECT r.seed, e.b, r.depth + 1 FROM r JOIN e ON e.a = r.node WHERE r.depth < 40) SELECT seed, node, min(depth) AS depth FROM r GROUP BY 1, 2",
)
def causal_closure(spark, sf_dir):
    return graphs.closure(_graph(spark, sf_dir), table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("seed")))


@register(
    "causal_order",
    f"""{_GRAPH_SQL}, r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b), c AS (SELECT a AS n FROM r WHERE a = b),
v AS (SELECT o_orderkey AS n FROM orders), f AS (SELECT n, n IN (SELECT n FROM c) OR n IN (SELECT r.b FROM r JOIN c ON c.n = r.a) AS late, n IN (SELECT n FROM c) OR n IN (SELECT r.a FROM r JOIN c ON c.n = r.b) AS early FROM v),
d AS (SELECT n, 0 AS level FROM f WHERE NOT late AND n NOT IN (SELECT b FROM e) UNION SELECT e.b, d.level + 1 FROM d JOIN e ON e.a = d.n JOIN f ON f.n = e.b WHERE NOT f.late)
SELECT f.n AS node, max(d.level) AS level, CASE WHEN NOT late THEN 'ordered' WHEN early THEN 'cyclic' ELSE 'blocked' END AS status FROM f LEFT JOIN d ON d.n = f.n GROUP BY f.n, late, early""",
)
def causal_order(spark, sf_dir):
    return graphs.causal_order(_graph(spark, sf_dir), table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node")))


# component safety: parts of one brand and size are one component
@register(
    "unsafe_components",
    """WITH m AS (SELECT p_brand || '/' || (p_size % 10) AS component, p_type, list_filter(string_split(lower(p_name), ' '), lambda x: x <> 'large') AS w FROM part),
d AS (SELECT DISTINCT a.component FROM (SELECT DISTINCT component, w FROM m) a JOIN (SELECT DISTINCT component, w FROM m) b ON a.component = b.component WHERE len(a.w) > 0 AND len(b.w) > 0 AND NOT list_has_any(a.w, b.w)),
t AS (SELECT component FROM m WHERE p_type IN ('SMALL', 'LARGE') GROUP BY 1 HAVING count(DISTINCT p_type) > 1)
SELECT component, list_sort(list_filter([CASE WHEN component IN (SELECT component FROM t) THEN 'conflicting_kind' END, CASE WHEN component IN (SELECT component FROM d) THEN 'disjoint_titles' END], lambda x: x IS NOT NULL)) AS reasons
FROM (SELECT component FROM t UNION SELECT component FROM d)""",
)
def unsafe_components(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.concat("p_brand", F.lit("/"), (F.col("p_size") % 10).cast("string")).alias("component"), F.when(F.col("p_type").isin("SMALL", "LARGE"), F.col("p_type")).alias("kind"), F.col("p_name").alias("title"))
    return entity.unsafe_components(parts, "component", ["kind"], "title", ["large"])
