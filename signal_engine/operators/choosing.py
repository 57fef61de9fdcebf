"""Choosing rows, routes and programs round by round: each round is an aggregate over the whole table, and only the
round's winner is seen by the driver. The number of picks is a parameter; rows, sets and units may be many."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from signal_engine.operators.ordered import cut_lineage

FEW_VALUES = 12
CUT_EVERY = 8
DIGITS = 9  # scores are compared to so many decimals, so that the order of a sum decides nothing


def row_tokens(rows: DataFrame, id_col: str, fields: Sequence[str]) -> DataFrame:
    """(id, tokens): what a row shows of its fields' shapes: missing or its type; its value, where the field has at
    most FEW_VALUES ones; a string's length class and, for a URL, its host. Blank strings count as missing."""
    kinds = {f.name: f.dataType.typeName() for f in rows.schema.fields}
    text = {c: F.substring(F.lower(F.trim(F.regexp_replace(F.col(c).cast("string"), r"\s+", " "))), 1, 120) for c in fields}
    distinct = rows.agg(*[F.count_distinct(F.nullif(text[c], F.lit(""))).alias(c) for c in fields]).first()
    tokens = []
    for c in sorted(fields):
        kind = "string" if kinds[c] in ("string", "varchar", "char") else "boolean" if kinds[c] == "boolean" else "number" if kinds[c] in ("byte", "short", "integer", "long", "float", "double", "decimal") else "object"
        parts = [F.lit(f"{c}:type:{kind}")]
        if distinct[c] <= FEW_VALUES:
            parts.append(F.concat(F.lit(f"{c}:value:"), text[c]))
        if kind == "string":
            n = F.length(c)
            parts.append(F.concat(F.lit(f"{c}:length:"), F.when(n < 16, "short").when(n < 64, "medium").otherwise("long")))
            parts.append(F.concat(F.lit(f"{c}:host:"), F.lower(F.nullif(F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))))
        missing = F.col(c).isNull() | (F.col(c).cast("string") == "")
        tokens.append(F.when(missing, F.array(F.lit(f"{c}:missing"))).otherwise(F.array_compact(F.array(*parts))))
    return rows.select(F.col(id_col), F.array_sort(F.array_distinct(F.concat(*tokens))).alias("tokens"))


def farthest_sample(rows: DataFrame, id_col: str, size: int) -> DataFrame:
    """(rank, id): farthest-point traversal over token sets (id, tokens). A round takes the row with the largest
    1000 x least Jaccard distance to the rows taken plus the rarity (sum of 1 / rows that have it) of its tokens that
    none of them has; ties go to the smaller id. Rows of the same tokens stay alike but for their ids, so the table is
    read once, into its distinct token sets with their ``size`` smallest ids, and a round is one pass over these, each
    with its least distance; lineage is cut every CUT_EVERY rounds. Null tokens are an empty set; rows without an id
    take no part."""
    spark = rows.sparkSession
    tokens = F.array_sort(F.array_distinct(F.array_compact(F.coalesce("tokens", F.array().cast("array<string>")))))
    own = rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), tokens.alias("tokens"))
    first = own.distinct().withColumn("_n", F.row_number().over(Window.partitionBy("tokens").orderBy("id"))).where(F.col("_n") <= size)
    ids = first.groupBy("tokens").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    sets = cut_lineage(own.groupBy("tokens").agg(F.count("*").alias("n")).join(ids, "tokens"))
    each = sets.select("tokens", "n", F.explode("tokens").alias("token"))
    weights = each.groupBy("token").agg(F.sum("n").alias("uses"))
    rare = each.join(weights, "token").groupBy("tokens").agg(F.array_sort(F.collect_list(F.struct("token", (1 / F.col("uses")).alias("w")))).alias("rare"))
    state = cut_lineage(sets.join(rare, "tokens", "left").select("ids", F.coalesce("rare", F.array().cast("array<struct<token:string,w:double>>")).alias("rare"), "tokens", F.lit(1.0).alias("least")))
    picked: list[Row] = []
    for rank in range(size):
        novelty = F.aggregate("rare", F.lit(0.0), lambda total, t: total + t["w"])
        score = F.round(F.col("least") * 1000 + novelty, DIGITS)
        best = state.where(F.size("ids") > 0).agg(F.min(F.struct((-score).alias("s"), F.col("ids")[0].alias("id"), "tokens")).alias("b")).first()["b"]
        if best is None:
            break
        picked.append(Row(rank=rank + 1, id=best["id"]))
        seen = F.array(*map(F.lit, best["tokens"])).cast("array<string>")
        both = F.size(F.array_union("tokens", seen))
        distance = F.when(both > 0, 1 - F.size(F.array_intersect("tokens", seen)) / both).otherwise(0.0)
        state = state.select(F.array_remove("ids", F.lit(best["id"])).alias("ids"), F.filter("rare", lambda t: ~F.array_contains(seen, t["token"])).alias("rare"), "tokens", F.least("least", distance).alias("least"))
        if rank % CUT_EVERY == CUT_EVERY - 1:
            state = cut_lineage(state)
    kind = rows.schema[id_col].dataType.simpleString()
    return spark.createDataFrame(picked, f"rank int, id {kind}").withColumnRenamed("id", id_col)


def split_sizes(rows: int, pilot: int | None = None, holdout: int | None = None) -> tuple[int, int]:
    """(pilot, holdout) units of a table: by default 3 and 2, fewer in tables under 8 rows, which keep one to exploit."""
    reserve = 1 if pilot is None and holdout is None and rows > 1 else 0
    wanted = holdout if holdout is not None else 2 if rows >= 8 else 1 if rows >= 4 else 0
    held = min(wanted, max(0, rows - 1 - reserve))
    first = pilot if pilot is not None else min(3, rows - held - reserve)
    return max(1, min(first, rows - held)) if rows else 0, held


def pilot_split(rows: DataFrame, id_col: str, pilot: int | None = None, holdout: int | None = None, comparison: int = 2) -> DataFrame:
    """(id, role, rank, compared) of every row of (id, tokens): the most diverse rows are the pilot, the next ones the
    holdout, all others are to exploit; the first of the pilot are compared. Ids are unique."""
    first, held = split_sizes(rows.count(), pilot, holdout)
    chosen = farthest_sample(rows, id_col, first + held)
    role = F.when(F.col("rank") <= first, "pilot").when(F.col("rank").isNotNull(), "holdout").otherwise("exploit")
    # first + held rows, both parameters
    return rows.select(id_col).join(F.broadcast(chosen), id_col, "left").select(id_col, role.alias("role"), "rank", F.coalesce(F.col("rank") <= max(1, min(comparison, first)), F.lit(False)).alias("compared"))


def _greedy(pairs: DataFrame, sets: DataFrame, size: int, best: Callable[[DataFrame, list[Row]], DataFrame], start: Sequence[str] = ()) -> list[Row]:
    """Rounds over a gain table. pairs: (set, unit, score), one row a pair, scores above 0; sets: (set, ...).

    A set's gain is what its units would add to the best score that the sets taken give them; marginal counts the
    units that it would improve. Only the pairs of units that the last winner improved change gains: these are
    subtracted, so a round reads the winner's units and their pairs, not all gains anew."""
    gains = cut_lineage(sets.join(pairs.groupBy("set").agg(F.sum("score").alias("gain"), F.count("*").alias("marginal")), "set", "left").fillna(0, ["gain", "marginal"]))
    taken: list[Row] = []
    waiting = list(start)
    while len(taken) < size:
        names = [r["set"] for r in taken]
        left = gains.where(~F.col("set").isin(names)) if names else gains
        row = left.where(F.col("set") == waiting.pop(0)).first() if waiting else best(left, taken).first()
        if row is None:
            break
        before = pairs.where(F.col("set").isin(names)).groupBy("unit").agg(F.max("score").alias("old")) if names else None
        mine = pairs.where(F.col("set") == row["set"]).select("unit", F.col("score").alias("new"))
        mine = mine.withColumn("old", F.lit(0) * F.col("new")) if before is None else mine.join(before, "unit", "left").withColumn("old", F.coalesce("old", F.lit(0) * F.col("new")))
        better = mine.where(F.col("new") > F.col("old"))
        above = lambda floor: F.greatest(F.col("score") - F.col(floor), F.lit(0) * F.col("score"))
        lost = pairs.join(better, "unit").groupBy("set").agg(F.sum(above("old") - above("new")).alias("_g"), (F.count_if(F.col("score") > F.col("old")) - F.count_if(F.col("score") > F.col("new"))).alias("_m"))
        taken.append(row)
        if len(taken) < size:
            gains = cut_lineage(gains.join(lost, "set", "left").withColumns({"gain": F.col("gain") - F.coalesce("_g", F.lit(0)), "marginal": F.col("marginal") - F.coalesce("_m", F.lit(0))}).drop("_g", "_m"))
    return taken


def _novelty(taken: list[Row]) -> Column:
    """Least Jaccard distance of a set's tags to those of the sets taken (1 without any)."""
    out = F.lit(1.0)
    for r in taken:
        tags = F.array(*map(F.lit, r["tags"] or [])).cast("array<string>")
        both = F.size(F.array_union("tags", tags))
        out = F.least(out, F.when(both > 0, 1 - F.size(F.array_intersect("tags", tags)) / both).otherwise(0.0))
    return out


def select_routes(pairs: DataFrame, routes: DataFrame, size: int, budget: float | None = None) -> DataFrame:
    """(rank, set, marginal, cumulative, novelty, credits): greedy choice by gain x reliability a credit plus 0.15 x
    novelty of the tags, while a route still improves a unit and fits the budget. routes: (set, credits, reliability,
    tags); pairs as in _greedy. Ties: more units, more novelty, less cost, the smaller name."""
    spark = pairs.sparkSession

    def best(left: DataFrame, taken: list[Row]) -> DataFrame:
        spent = sum(r["credits"] for r in taken)
        scored = left.withColumn("novelty", _novelty(taken)).withColumn("utility", F.round(F.col("gain") * F.col("reliability") / F.greatest("credits", F.lit(0.0001)) + F.col("novelty") * 0.15, DIGITS))
        fits = F.lit(True) if budget is None else F.col("credits") + spent <= budget
        return scored.where((F.col("marginal") > 0) & fits).orderBy(F.desc("utility"), F.desc("marginal"), F.desc("novelty"), "credits", "set").limit(1)

    rows, covered = [], 0
    for rank, r in enumerate(_greedy(pairs, routes, size, best), 1):
        names = [x["set"] for x in rows] + [r["set"]]
        covered = pairs.where(F.col("set").isin(names)).select("unit").distinct().count()
        rows.append(Row(rank=rank, set=r["set"], marginal=r["marginal"], cumulative=covered, novelty=float(r["novelty"]), credits=float(r["credits"])))
    return spark.createDataFrame(rows, f"rank int, set {pairs.schema['set'].dataType.simpleString()}, marginal long, cumulative long, novelty double, credits double")


def cover_features(features: DataFrame, sets: DataFrame, size: int, incumbent: object | None = None, covered: DataFrame | None = None) -> DataFrame:
    """(rank, set, novel): greedy maximum coverage: the set with most features that no earlier one has, then a known
    cost before an unknown one, the lower cost, the smaller name, until ``size`` are taken. features: (set, unit);
    sets: (set, credits or null); features in ``covered`` (unit) count as had; an incumbent is taken first."""
    open_ones = features.distinct() if covered is None else features.distinct().join(covered.select("unit").distinct(), "unit", "left_anti")
    pairs = open_ones.withColumn("score", F.lit(1).cast("long"))
    picked = _greedy(pairs, sets, size, lambda left, _: left.orderBy(F.desc("marginal"), F.asc_nulls_last("credits"), "set").limit(1), [] if incumbent is None else [incumbent])
    rows = [Row(rank=i, set=r["set"], novel=r["marginal"]) for i, r in enumerate(picked, 1)]
    return features.sparkSession.createDataFrame(rows, f"rank int, set {features.schema['set'].dataType.simpleString()}, novel long")


def _subset_sums(counts: DataFrame, bits: int, columns: Sequence[str]) -> DataFrame:
    """From counts by mask to sums over all subsets of each mask: one pass a bit over at most 2^bits rows."""
    out = counts
    for i in range(bits):
        bit = 1 << i
        up = F.when(F.col("mask").bitwiseAND(F.lit(bit)) == 0, F.array("mask", F.col("mask").bitwiseOR(F.lit(bit)))).otherwise(F.array("mask"))
        out = out.select(F.explode(up).alias("mask"), *columns).groupBy("mask").agg(*[F.sum(c).alias(c) for c in columns])
    return out


def program_portfolios(evidence: DataFrame, programs: DataFrame, order: Sequence[str], claims: Sequence[str], largest: int, required: Sequence[str] = ()) -> DataFrame:
    """(mask, size, complete, verified, credits, calls, frontier, winner) of every portfolio of at most ``largest`` of
    at most 12 programs (bit i of mask: order[i]) that has the required ones.

    evidence: (unit, claim, program), a program verified a unit's claim; programs: (program, credits or null, calls).
    verified counts (unit, claim) pairs that one of the programs verified; complete counts units with all of
    ``claims``, by signed sums over the claims' subsets. Both come from sums over the lattice of subsets, whatever the
    number of units. frontier: no other portfolio has at least the coverage at no more cost and is better in one;
    without a known cost a portfolio neither dominates nor is dominated. winner: most complete, most verified, least
    cost, fewest calls, fewest programs, smallest mask."""
    k, wanted = len(order), list(claims)
    if k > 12 or len(wanted) > 6:
        raise ValueError("the lattice takes at most 12 programs and 6 claims")
    spark = evidence.sparkSession
    bit = F.create_map(*[F.lit(x) for i, p in enumerate(order) for x in (p, 1 << i)])
    seen = evidence.where(F.col("claim").isin(wanted)).select("unit", "claim", bit[F.col("program")].alias("bit")).where("bit IS NOT NULL")
    cells = seen.groupBy("unit", "claim").agg(F.bit_or("bit").alias("mask"))
    total = cells.count()
    verified = cells.groupBy("mask").agg(F.lit(0).cast("long").alias("complete"), F.count("*").alias("verified"))
    units = cells.groupBy("unit").agg(*[F.coalesce(F.max(F.when(F.col("claim") == c, F.col("mask"))), F.lit(0)).alias(f"c{i}") for i, c in enumerate(wanted)])
    signed = []
    for subset in range(1 << len(wanted)):
        union = F.lit(0)
        for i in range(len(wanted)):
            if subset >> i & 1:
                union = union.bitwiseOR(F.col(f"c{i}"))
        signed.append(F.struct(union.alias("mask"), F.lit((-1) ** subset.bit_count()).cast("long").alias("complete")))
    complete = units.select(F.explode(F.array(*signed)).alias("s")).groupBy("s.mask").agg(F.sum("s.complete").alias("complete"), F.lit(0).cast("long").alias("verified"))
    sums = _subset_sums(verified.unionByName(complete).groupBy("mask").agg(F.sum("complete").alias("complete"), F.sum("verified").alias("verified")), k, ["complete", "verified"])
    full = (1 << k) - 1
    by_mask = sums.select(F.lit(full).bitwiseXOR(F.col("mask")).alias("mask"), "complete", (F.lit(total) - F.col("verified")).alias("verified"))
    # one row a program
    facts = {r["program"]: r for r in programs.where(F.col("program").isin(list(order))).select("program", F.col("credits").cast("double").alias("credits"), "calls").collect()}
    need = sum(1 << order.index(p) for p in required)
    rows = []
    for mask in range(1, 1 << k):
        members = [facts.get(p) for i, p in enumerate(order) if mask >> i & 1]
        if len(members) <= largest and mask & need == need:
            credits = None if any(m is None or m["credits"] is None for m in members) else sum(m["credits"] for m in members)
            rows.append((mask, len(members), credits, sum(m["calls"] for m in members if m)))
    offered = spark.createDataFrame(rows, "mask int, size int, credits double, calls long").join(by_mask, "mask", "left").fillna(0, ["complete", "verified"])
    offered = cut_lineage(offered)
    # at most 2^12 portfolios, whatever the evidence
    points = offered.where("credits IS NOT NULL").select(F.col("complete").alias("c"), F.col("verified").alias("v"), F.col("credits").alias("k")).distinct()
    better = (F.col("c") >= F.col("complete")) & (F.col("v") >= F.col("verified")) & (F.col("k") <= F.col("credits")) & ((F.col("c") > F.col("complete")) | (F.col("v") > F.col("verified")) | (F.col("k") < F.col("credits")))
    frontier = offered.join(F.broadcast(points), better, "left_anti").select("mask", F.lit(True).alias("frontier"))
    top = offered.orderBy(F.desc("complete"), F.desc("verified"), F.asc_nulls_last("credits"), "calls", "size", "mask").first()
    return offered.join(frontier, "mask", "left").select("mask", "size", "complete", "verified", "credits", "calls", F.coalesce("frontier", F.lit(False)).alias("frontier"), (F.col("mask") == F.lit(None if top is None else top["mask"]).cast("int")).alias("winner"))
