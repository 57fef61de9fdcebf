"""What a query's steps hold and deal when groups are large: pairs, equal rows, candidates and keyed state."""

import itertools
import random

from pyspark.sql import functions as F

from signal_engine.operators import choosing, entity, joins
from signal_engine.streaming import machines


def test_role_proximity_deals_a_hot_key(spark):
    rows = spark.range(300).groupBy("id").agg(F.lit(1).alias("k"), F.to_date(F.lit("2020-01-01")).alias("start"), F.to_date(F.lit("2021-01-01")).alias("end"), F.lit(False).alias("is_current"))
    pairs = joins.role_proximity(rows, rows, "k", F.to_date(F.lit("2022-01-01")))
    assert pairs.count() == 300 * 300
    assert pairs.select(F.spark_partition_id()).distinct().count() > 1  # few bytes, many pairs: not one task's work

def test_similarity_is_computed_once_for_equal_rows(spark):
    rng = random.Random(3)
    side = [(i, rng.choice("xy"), rng.sample("abcd", rng.randint(0, 3))) for i in range(1200)]
    df = spark.createDataFrame(side, "id long, k string, tokens array<string>")
    got = {(r["id"], r["other"]): r["similarity"] for r in joins.similar_within(df, "k").collect()}
    expected = {(a, b): len({*x} & {*y}) / len({*x} | {*y}) if x or y else None for (a, k, x), (b, j, y) in itertools.combinations(side, 2) if k == j}
    assert got == expected
    same = spark.range(5000).select("id", F.lit("x").alias("k"), F.array(F.lit("a")).alias("tokens"))
    blocks = joins.id_blocks(same, "id", "k", "tokens").select(F.size("ids").alias("n")).collect()
    assert len(blocks) <= 10 and sum(b["n"] for b in blocks) == 5000
    assert joins.similar_within(same.where("id < 700"), "k").count() == 700 * 699 // 2  # over several blocks

def test_interval_overlap_deals_a_hot_year(spark):
    rows = spark.range(300).groupBy("id").agg(F.lit(1).alias("k"), F.to_date(F.lit("2020-01-01")).alias("start"), F.to_date(F.lit("2020-02-01")).alias("end"), F.lit(False).alias("is_current"))
    pairs = joins.interval_overlap(rows, rows, "k", F.to_date(F.lit("2022-01-01")))
    assert pairs.count() == 300 * 300
    assert pairs.select(F.spark_partition_id()).distinct().count() > 1

def _spans(spark, n):
    """n rows of one key in mixed order of start, with intervals of some weeks to years; some ends are open."""
    rng = random.Random(n)
    rows = [(i, 1, 7300 + (s := rng.randint(0, 900)), 7300 + s + rng.randint(20, 1500) if i % 3 else None, i % 6 == 0) for i in range(n)]
    return spark.createDataFrame(rows, "id long, k int, s int, e int, is_current boolean").select("id", "k", F.date_from_unix_date("s").alias("start"), F.date_from_unix_date("e").alias("end"), "is_current")

def _bytes_a_row(pairs, path):
    pairs.write.parquet(str(path))
    return sum(f.stat().st_size for f in path.glob("*.parquet")) / pairs.count()

def test_interval_overlap_is_written_in_little_space(spark, tmp_path):
    as_of = F.to_date(F.lit("1994-01-01"))
    rows = _spans(spark, 1500)
    assert _bytes_a_row(joins.interval_overlap(rows, rows, "k", as_of), tmp_path / "pairs") < 1.2
    few = rows.where("id % 3 = 0")
    all_pairs = joins.interval_overlap(few, few, "k", as_of)
    once = joins.interval_overlap(few, few, "k", as_of, once=True)
    assert once.count() == once.distinct().count() == all_pairs.where("left_id < right_id").count()
    assert once.exceptAll(all_pairs).count() == 0
    side = few.select("id", F.col("start").alias("s"), F.when(F.col("is_current"), as_of).alias("e")).where("s <= e")
    a, b = side.alias("a"), side.alias("b")
    assert all_pairs.drop("k").exceptAll(a.join(b, F.expr("a.s <= b.e AND b.s <= a.e")).select("a.id", "b.id", F.greatest("a.s", "b.s"), F.least("a.e", "b.e"))).count() == 0
    assert all_pairs.count() == side.count() ** 2  # all of them are open, so all meet

def test_role_proximity_is_written_in_little_space(spark, tmp_path):
    as_of = F.to_date(F.lit("1994-01-01"))
    rows = _spans(spark, 1500)
    pairs = joins.role_proximity(rows, rows, "k", as_of)
    assert _bytes_a_row(pairs, tmp_path / "pairs") < 0.6
    assert pairs.count() == 1500 * 1500
    once = joins.role_proximity(rows, rows, "k", as_of, once=True)
    assert once.count() == 1500 * 1499 // 2 and once.exceptAll(pairs.where("left_id < right_id")).count() == 0
    a, b = rows.alias("a"), rows.alias("b")
    undated = F.expr("(a.end IS NULL AND NOT a.is_current) OR (b.end IS NULL AND NOT b.is_current)")
    assert pairs.where("proximity = 'undated'").count() == a.crossJoin(b).where(undated).count()

def _made_for_one(pairs):
    """How many rows the generators made until the first pair was read."""
    first = pairs.limit(1)
    assert len(first.collect()) == 1
    todo, made = [first._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        if node.nodeName() == "ResultQueryStage":
            todo.append(node.plan())
        if node.nodeName() == "Generate":
            made += node.metrics().apply("numOutputRows").value()
        todo += [node.children().apply(i) for i in range(node.children().size())]
    assert made > 0
    return made

def test_similarity_is_written_row_by_row(spark):
    same = spark.range(1500).select("id", F.lit("x").alias("k"), F.array(F.lit("a")).alias("tokens"))
    assert _made_for_one(joins.similar_within(same, "k")) < 5000  # not all pairs of a block with those it meets
    thirds = spark.createDataFrame([(1, "x", ["a", "b"]), (2, "x", ["b", "c"])], "id long, k string, tokens array<string>")
    assert [tuple(r) for r in joins.similar_within(thirds, "k", 6).collect()] == [(1, 2, 0.333333)]

def test_token_subset_does_not_shuffle_pairs(spark):
    same = spark.range(1100).select("id", F.array((F.col("id") % 2).cast("string"), F.lit("a")).alias("tokens"))
    pairs = joins.token_subset(same, same)
    assert pairs.count() == 2 * 550 * 550
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Exchange" in line and "left_id" in line and "right_id" in line]

def test_token_subset_holds_few_pairs_at_once(spark):
    same = spark.range(1500).select("id", F.array(F.lit("a"), F.lit("b")).alias("tokens"))
    assert _made_for_one(joins.token_subset(same, same)) < 5000
    rng = random.Random(8)
    side = [(i, [f"w{rng.randint(0, 5)}" for _ in range(rng.randint(0, 3))]) for i in range(200)]
    df = spark.createDataFrame(side, "id long, tokens array<string>")
    got = [tuple(r) for r in joins.token_subset(df, df, once=True).collect()]
    assert sorted(got) == [(a, b) for (a, x), (b, y) in itertools.combinations(side, 2) if x and y and (set(x) <= set(y) or set(y) <= set(x))]

def test_few_managers_are_candidates(spark):
    rng = random.Random(5)
    people = [(rng.choice([1, 2, None]), i, rng.choice([1.0, 1.5, 2.0, 3.0, None]), rng.choice(["A", "b", "Ab", None]), rng.choice([1, 2, None]), rng.choice([*range(9), None])) for i in range(150)]

    def score(p, m):
        gap, team, other = p[2] - m[2], (p[3] or "").lower(), (m[3] or "").lower()
        near = 0 if None in (p[3], m[3]) else 8 if team == other else 3 if team in other or other in team else 0
        return {1: 10, 2: 5}.get(gap, 0) + near + 2 * (p[4] is not None and p[4] == m[4]) + 2 * (None not in (p[5], m[5]) and m[5] - p[5] >= 3)

    expected = set()
    for p in people:
        met = [(-score(p, m), m[1]) for m in people if None not in (p[0], p[2], m[2]) and p[0] == m[0] and p[2] - 2 <= m[2] < p[2] and score(p, m) >= 5]
        expected |= {(p[1], min(met)[1], -min(met)[0])} if met else set()
    df = spark.createDataFrame(people, "company int, person long, rank double, team string, city int, years int")
    assert {tuple(r) for r in entity.predict_manager(df).collect()} == expected
    many = spark.range(4000).select(F.lit(1).alias("company"), F.lit(1).alias("rank"), F.lit("a").alias("team"), F.lit(1).alias("city"), F.xxhash64("id").alias("years"), F.col("id").alias("manager"))
    assert entity._managers(many).count() < 50  # of one group of 4,000; they alone meet its members

def test_farthest_sample_works_on_distinct_sets(spark, monkeypatch):
    seen, cut = [], choosing.cut_lineage
    monkeypatch.setattr(choosing, "cut_lineage", lambda df: seen.append(cut(df)) or seen[-1])
    rows = spark.range(400).select("id", F.array((F.col("id") % 5).cast("string")).alias("tokens"))
    assert [r["id"] for r in choosing.farthest_sample(rows, "id", 7).orderBy("rank").collect()] == [0, 1, 2, 3, 4, 5, 6]
    assert max(df.count() for df in seen) == 5


class _Store:
    """A state store in memory that counts its messages."""

    def __init__(self):
        self.calls, self.values, self.timers = 0, {}, set()

    def _variable(self, name, start):
        store = self

        class Variable:
            def __getattr__(self, call):
                def run(*args):
                    store.calls += 1
                    now = store.values.get(name, start)
                    if call == "get":
                        return iter(now) if start == [] else now
                    if call == "exists":
                        return name in store.values
                    store.values[name] = {"put": lambda x: list(x), "update": lambda x: x, "appendList": lambda x: [*now, *x], "clear": lambda: start}[call](*args)

                return run

        return Variable()

    def getValueState(self, name, schema):
        return self._variable(name, None)

    def getListState(self, name, schema):
        return self._variable(name, [])

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)


class _Times:
    def __init__(self, low):
        self.low = low

    def getCurrentWatermarkInMs(self):
        return self.low

    getExpiryTimeInMs = getCurrentWatermarkInMs


def test_a_machine_sends_few_messages_a_batch():
    store = _Store()
    made = machines._MachineProcessor(machines.Machine("new", {("new", "a"): "on", ("on", "a"): "on"}, {"on": (60, "off")}))
    made.init(store)
    rows = [{"at": i * 1_000_000, "event_id": i, "event": "a"} for i in range(1000)]
    assert len(list(made.handleInputRows(("k",), iter(rows), _Times(0)))) == 1000
    assert store.calls <= 6 and store.timers == {1_059_001}
    assert list(made.handleInputRows(("k",), iter(rows[500:]), _Times(500_000))) == []  # a replay
    assert len(store.values["seen"]) == 500 and store.timers == {1_059_001}
    store.timers.clear()  # it fires
    assert [r["to_state"] for r in made.handleExpiredTimer(("k",), _Times(1_100_000), _Times(1_059_001))] == ["off"]
    assert store.values["now"][0] == "off" and not store.timers


def test_calls_of_a_bucket_share_their_messages():
    store = _Store()
    made = machines._TtlProcessor()
    made.init(store)
    rows = [{"key": f"c{i % 100}", "at": i * 1_000_000, "id": i, "ttl": None if i % 100 == 7 else 150} for i in range(300)]
    got = [r["action"] for r in made.handleInputRows((1,), iter(rows), _Times(0))]
    assert got == ["run"] * 100 + ["reuse"] * 100 + ["reuse" if i == 7 else "run" for i in range(100)]
    assert store.calls <= 6 and len(store.timers) == 1
    (at,) = store.timers
    store.timers.clear()
    assert list(made.handleExpiredTimer((1,), _Times(at), _Times(at))) == []
    assert [k for k, *_ in store.values["last"]] == ["c7"] and not store.timers
