"""Entity resolution and small-graph operators on edge tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signal_engine.operators.ordered import cut_lineage


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable; alternating large and small stars until nothing changes."""
    now = cut_lineage(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    alone = edges.select(F.col(a).alias("node")).unionByName(edges.select(F.col(b).alias("node"))).distinct()
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        now = cut_lineage(small.where("u <> v").distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return alone.join(now.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def identity_edges(contacts: DataFrame, id_col: str, identities: list[str]) -> DataFrame:
    """Edges from each contact to the smallest contact with the same strong identity (stars, not all pairs)."""
    long = contacts.select(id_col, F.explode(F.array(*[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}:"), F.col(c))) for c in identities])).alias("identity")).where("identity IS NOT NULL")
    first = long.groupBy("identity").agg(F.min(id_col).alias("b"))
    return long.join(first, "identity").select(F.col(id_col).alias("a"), "b").distinct()


def resolve(contacts: DataFrame, id_col: str, identities: list[str]) -> DataFrame:
    """(id, component) over shared strong identities; contacts without one stand alone."""
    comp = connected_components(identity_edges(contacts, id_col, identities))
    return contacts.select(id_col).join(comp.withColumnRenamed("node", id_col), id_col, "left").withColumn("component", F.coalesce("component", id_col))


MOST_WORDS = 10  # sets of more words are compared by their words


def unsafe_components(members: DataFrame, component: str, exact: list[str], title: str, noise: Sequence[str] = ()) -> DataFrame:
    """(component, reasons): components whose members differ in an exact field (case and white space aside) or two of
    whose titles have no word in common (``noise`` words aside). Blank values and titles without words say nothing.

    No pairs are made: each component keeps its distinct word sets, and a set meets all of them if as many contain one
    of its words as there are. How many do comes from counts of sets by contained words, with alternating signs over
    the subsets of its words; sets of more than MOST_WORDS words meet the others by their words instead. Components
    with a word in all sets are safe at once."""
    text = lambda c: F.nullif(F.lower(F.trim(F.regexp_replace(F.col(c).cast("string"), r"\s+", " "))), F.lit(""))
    marks = [F.when(F.count_distinct(text(c)) > 1, F.lit(f"conflicting_{c}")) for c in exact]
    differ = members.groupBy(component).agg(F.array_compact(F.array(*marks) if marks else F.array().cast("array<string>")).alias("reasons")).select(F.col(component).alias("_c"), F.explode("reasons").alias("reason"))

    words = F.array_sort(F.array_distinct(F.filter(F.split(F.lower(title), r"[^\p{L}\p{N}_]+"), lambda w: (w != "") & ~w.isin(list(noise)))))
    sets = members.select(F.col(component).alias("_c"), words.alias("w")).where(F.size("w") > 0).distinct()
    sizes = sets.groupBy("_c").agg(F.count("*").alias("n"), F.count_if(F.size("w") <= MOST_WORDS).alias("short")).where("n > 1")
    shared = sets.select("_c", F.explode("w").alias("x")).groupBy("_c", "x").agg(F.count("*").alias("m"))
    common = shared.join(sizes, "_c").where("m = n").select("_c").distinct()
    open_ones = cut_lineage(sets.join(sizes, "_c").join(common, "_c", "left_anti"))

    short = open_ones.where(F.size("w") <= MOST_WORDS)
    subsets = F.transform(F.sequence(F.lit(1), F.expr("shiftleft(1, size(w)) - 1")), lambda mask: F.filter("w", lambda _, i: F.call_function("getbit", mask, i) == 1))
    held = short.select("_c", "w", "short", F.explode(subsets).alias("part"))
    counts = held.groupBy("_c", "part").agg(F.count("*").alias("m"))
    met = held.join(counts, ["_c", "part"]).groupBy("_c", "w").agg(F.sum(F.when(F.size("part") % 2 == 1, F.col("m")).otherwise(-F.col("m"))).alias("met"), F.first("short").alias("short"))
    apart = met.where("met < short").select("_c")

    long = open_ones.where(F.size("w") > MOST_WORDS)
    near = long.select("_c", "n", F.col("w").alias("v"), F.explode("w").alias("x")).join(open_ones.select("_c", "w", F.explode("w").alias("x")), ["_c", "x"]).select("_c", "n", "v", "w").distinct()
    apart = apart.unionByName(near.groupBy("_c", "n", "v").agg(F.count("*").alias("met")).where("met < n").select("_c")).distinct()
    found = differ.unionByName(apart.select("_c", F.lit("disjoint_titles").alias("reason")))
    return found.groupBy(F.col("_c").alias(component)).agg(F.array_sort(F.collect_set("reason")).alias("reasons"))


def split_unsafe(members: DataFrame, unsafe: DataFrame, component: str, id_col: str) -> DataFrame:
    """Members of unsafe components become singletons marked for review."""
    return members.join(unsafe.select(component, F.lit(True).alias("review")), component, "left").withColumn(component, F.when(F.col("review"), F.col(id_col)).otherwise(F.col(component))).withColumn("review", F.coalesce("review", F.lit(False)))


def merge(members: DataFrame, component: str, id_col: str, fields: list[str]) -> DataFrame:
    """One row per component: canonical id (smallest), all ids, and each field from the smallest id that has it."""
    return members.groupBy(component).agg(F.min(id_col).alias("canonical"), F.array_sort(F.collect_set(id_col)).alias("aliases"), *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(id_col))).alias(c) for c in fields])


def weak_collisions(canonical: DataFrame, identity: str, id_col: str) -> DataFrame:
    """Weak identities that several canonical records share."""
    return canonical.where(F.col(identity).isNotNull()).groupBy(identity).agg(F.array_sort(F.collect_set(id_col)).alias("ids")).where(F.size("ids") > 1)


def neighbourhood(edges: DataFrame, seeds: DataFrame, hops: int = 3) -> DataFrame:
    """(node, hop, edge_id): nodes within ``hops`` undirected steps, with the smallest edge that first found each.
    edges: (edge_id, a, b); seeds: (node)."""
    both = edges.select("edge_id", F.col("a").alias("node"), F.col("b").alias("next")).unionByName(edges.select("edge_id", F.col("b").alias("node"), F.col("a").alias("next")))
    seen = seeds.select("node").distinct().select("node", F.lit(0).alias("hop"), F.lit(None).cast(edges.schema["edge_id"].dataType).alias("edge_id"))
    front = seen
    for hop in range(1, hops + 1):
        found = front.select("node").join(both, "node").groupBy(F.col("next").alias("node")).agg(F.min("edge_id").alias("edge_id"))
        front = cut_lineage(found.join(seen.select("node"), "node", "left_anti").select("node", F.lit(hop).alias("hop"), "edge_id"))
        seen = seen.unionByName(front)
    return seen


def edge_violations(edges: DataFrame, nodes: DataFrame, types: list[str], least: float = 0.0) -> DataFrame:
    """(edge_id, problem) for duplicate ids, equal or unknown ends, unknown types and low confidence."""
    known = nodes.select("node", F.lit(True).alias("k"))
    joined = edges.withColumn("n", F.count("*").over(Window.partitionBy("edge_id")))
    joined = joined.join(known.select(F.col("node").alias("a"), F.col("k").alias("ka")), "a", "left").join(known.select(F.col("node").alias("b"), F.col("k").alias("kb")), "b", "left")
    marks = [
        F.when(F.col("n") > 1, F.lit("duplicate_id")), F.when(F.col("a") == F.col("b"), F.lit("self_edge")), F.when(F.col("ka").isNull() | F.col("kb").isNull(), F.lit("unknown_node")),
        F.when(~F.col("type").isin(*types), F.lit("unknown_type")), F.when(F.col("confidence") < least, F.lit("low_confidence")),
    ]
    return joined.select("edge_id", F.explode(F.array_compact(F.array(*marks))).alias("problem"))


def _managers(people: DataFrame) -> DataFrame:
    """Those of people (company, rank, team, city, years, manager) who may be a person's best manager: among managers of
    the same company, rank, team and city one with a smaller id and no fewer years is never worse, and few have none
    such beside them."""
    older = Window.partitionBy("company", "rank", "team", "city").orderBy(F.desc_nulls_last("years")).rowsBetween(Window.unboundedPreceding, -1)
    return people.withColumn("_least", F.min("manager").over(older)).where("_least IS NULL OR manager < _least").drop("_least")


def predict_manager(people: DataFrame, least: int = 5) -> DataFrame:
    """(person, manager, score) within a company by seniority gap, team, city and experience; the best of at least
    ``least``. people: (company, person, rank, team, city, years)."""
    traits = ["company", "rank", "team", "city", "years"]
    rows = people.where("company IS NOT NULL AND rank IS NOT NULL").withColumn("team", F.lower("team"))
    # persons of the same traits have the same best manager
    alike = rows.groupBy(*traits).agg(F.min("person").alias("manager"))
    m = _managers(alike).select("company", F.col("rank").alias("m_rank"), *[F.col(c).alias(f"m_{c}") for c in ("team", "city", "years")], "manager", F.explode(F.transform(F.array(*map(F.lit, range(3))), lambda i: F.floor("rank") + i)).alias("_near"))
    gap = F.col("rank") - F.col("m_rank")
    team, other = F.col("team"), F.col("m_team")
    score = (
        F.when(gap == 1, 10).when(gap == 2, 5).otherwise(0)
        + F.when(team == other, 8).when(team.contains(other) | other.contains(team), 3).otherwise(0)
        + F.when(F.col("city") == F.col("m_city"), 2).otherwise(0)
        + F.when(F.col("m_years") - F.col("years") >= 3, 2).otherwise(0)
    )
    met = alike.select(*traits, F.floor("rank").alias("_near")).join(m, ["company", "_near"]).where("m_rank < rank AND m_rank >= rank - 2")
    scored = met.select(*traits, "manager", score.alias("score")).where(F.col("score") >= least)
    first = scored.groupBy(*traits, "score").agg(F.min("manager").alias("manager")).groupBy(*traits).agg(F.max_by(F.struct("manager", "score"), "score").alias("b"))
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"f.{c}")) for c in traits]
    each = rows.alias("p").join(first.alias("f"), same).select("p.person", "f.b.manager", "f.b.score")
    return each.groupBy("person").agg(F.max_by(F.struct("manager", "score"), F.struct("score", -F.col("manager"))).alias("b")).select("person", "b.manager", "b.score")


def hiring_velocity(people: DataFrame, team: str, tenure_days: str) -> DataFrame:
    ratio = F.count_if(F.col(tenure_days) < 90) / F.count("*")
    return people.groupBy(team).agg(F.count_if(F.col(tenure_days) < 90).alias("recent"), F.count("*").alias("headcount"), ratio.alias("ratio")).withColumn("risk", F.when(F.col("ratio") >= 0.3, "HIGH").when(F.col("ratio") >= 0.15, "MEDIUM").otherwise("LOW"))
