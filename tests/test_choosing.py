"""Choices by rounds, graphs, component safety and name candidates against brute force."""

import itertools
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from signal_engine.operators import choosing, entity, graphs, joins


def brute_sample(rows, size):
    count = {}
    for _, t in rows:
        for x in t:
            count[x] = count.get(x, 0) + 1
    taken, have = [], set()

    def score(tokens):
        least = min((1 - len(tokens & s) / len(tokens | s) if tokens | s else 0.0 for _, s in taken), default=1.0)
        return round(1000 * least + sum(1 / count[x] for x in sorted(tokens - have)), 9)

    left = dict(rows)
    while left and len(taken) < size:
        i = min(left, key=lambda i: (-score(left[i]), i))
        taken.append((i, left.pop(i)))
        have |= taken[-1][1]
    return [i for i, _ in taken]


def test_farthest_sample_equals_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, set(rng.sample("abcdefghij", rng.randint(0, 4)))) for i in range(60)]
    df = spark.createDataFrame([(i, sorted(t) or None) for i, t in rows], "id long, tokens array<string>")
    got = [r["id"] for r in choosing.farthest_sample(df, "id", 12).orderBy("rank").collect()]
    assert got == brute_sample(rows, 12)
    assert choosing.farthest_sample(df.where("id < 3"), "id", 12).count() == 3  # fewer rows than picks
    assert choosing.farthest_sample(df.where("false"), "id", 2).count() == 0


def test_row_tokens(spark):
    rows = spark.createDataFrame([(1, "https://u@Docs.Site.org:8/x", 2, True), (2, "  A  b ", None, None), (3, "", 3, False), (4, "x" * 70, 3, False)], "id long, s string, n int, b boolean")
    got = {r["id"]: r["tokens"] for r in choosing.row_tokens(rows, "id", ["s", "n", "b"]).collect()}
    assert got[1] == ["b:type:boolean", "b:value:true", "n:type:number", "n:value:2", "s:host:docs.site.org", "s:length:medium", "s:type:string", "s:value:https://u@docs.site.org:8/x"]
    assert got[2] == ["b:missing", "n:missing", "s:length:short", "s:type:string", "s:value:a b"]
    assert "s:missing" in got[3] and "s:length:long" in got[4]
    many = spark.range(20).select("id", F.concat(F.lit("v"), F.col("id").cast("string")).alias("s"))
    assert all(r["tokens"] == ["s:length:short", "s:type:string"] for r in choosing.row_tokens(many, "id", ["s"]).collect())


@pytest.mark.parametrize(("n", "sizes"), [(0, (0, 0)), (1, (1, 0)), (2, (1, 0)), (4, (2, 1)), (5, (3, 1)), (8, (3, 2)), (100, (3, 2))])
def test_split_sizes(n, sizes):
    assert choosing.split_sizes(n) == sizes


def test_pilot_split(spark):
    df = spark.createDataFrame([(i, [c]) for i, c in enumerate("abcdaabbb")], "id long, tokens array<string>")
    rows = choosing.pilot_split(df, "id").collect()
    assert sorted(r["role"] for r in rows) == ["exploit"] * 4 + ["holdout"] * 2 + ["pilot"] * 3
    assert sum(r["compared"] for r in rows) == 2 and {r["id"] for r in rows} == set(range(9))


def brute_routes(pairs, sets, size, budget):
    have, taken, out = {}, [], []
    while len(taken) < size:
        best = None
        for s, (credits, reliability, tags) in sorted(sets.items()):
            mine = {u: x for (t, u), x in pairs.items() if t == s}
            better = {u: x for u, x in mine.items() if x > have.get(u, 0)}
            if s in taken or not better or sum(sets[t][0] for t in taken) + credits > budget:
                continue
            novelty = min((1 - len(tags & sets[t][2]) / len(tags | sets[t][2]) if tags | sets[t][2] else 0.0 for t in taken), default=1.0)
            utility = round(sum(x - have.get(u, 0) for u, x in better.items()) * reliability / max(credits, 0.0001) + 0.15 * novelty, 9)
            key = (-utility, -len(better), -novelty, credits, s)
            if best is None or key < best[0]:
                best = (key, s, better)
        if best is None:
            break
        taken.append(best[1])
        have |= best[2]
        out.append((best[1], len(best[2]), len(have)))
    return out


def test_route_selection_equals_brute_force(spark):
    for seed in range(3):
        rng = random.Random(seed)
        pairs = {(s, u): rng.randint(1, 9) for s in range(9) for u in rng.sample(range(25), rng.randint(0, 9))}
        sets = {s: (rng.choice([0.0, 1.0, 2.0, 3.5]), rng.choice([1.0, 0.5]), set(rng.sample("pqrs", rng.randint(0, 3)))) for s in range(9)}
        got = choosing.select_routes(
            spark.createDataFrame([(s, u, x) for (s, u), x in pairs.items()], "set long, unit long, score long"),
            spark.createDataFrame([(s, c, r, sorted(t)) for s, (c, r, t) in sets.items()], "set long, credits double, reliability double, tags array<string>"), 5, 7.0,
        )
        assert [(r["set"], r["marginal"], r["cumulative"]) for r in got.orderBy("rank").collect()] == brute_routes(pairs, sets, 5, 7.0)


def test_features_are_covered_in_turn(spark):
    features = {"a": "xyz", "b": "xyzw", "c": "v", "d": "", "e": "v", "f": "u"}
    costs = {"a": 1.0, "b": 9.0, "c": None, "d": 2.0, "e": 5.0, "f": None}
    df = spark.createDataFrame([(s, u) for s, us in features.items() for u in us], "set string, unit string")
    sets = spark.createDataFrame(list(costs.items()), "set string, credits double")
    picks = lambda **kw: [(r["set"], r["novel"]) for r in choosing.cover_features(df, sets, **kw).orderBy("rank").collect()]
    assert picks(size=9) == [("b", 4), ("e", 1), ("f", 1), ("a", 0), ("d", 0), ("c", 0)]
    assert picks(size=3, incumbent="d", covered=spark.createDataFrame([("v",), ("w",)], "unit string")) == [("d", 0), ("a", 3), ("f", 1)]


def test_portfolios_equal_enumeration(spark):
    rng = random.Random(7)
    order, claims = ["p0", "p1", "p2", "p3", "p4"], ["x", "y"]
    evidence = {(u, c, p) for u in range(12) for c in [*claims, "other"] for p in order if rng.random() < 0.25}
    costs = {p: (None if p == "p4" else float(rng.randint(1, 4)), rng.randint(1, 5)) for p in order}
    got = choosing.program_portfolios(
        spark.createDataFrame([(*e,) for e in evidence], "unit long, claim string, program string"), spark.createDataFrame([(p, *c) for p, c in costs.items()], "program string, credits double, calls long"), order, claims, 3, ["p1"]
    )
    rows = {}
    for size in (1, 2, 3):
        for ps in itertools.combinations(range(5), size):
            if 1 in ps:
                names = {order[i] for i in ps}
                hit = {(u, c) for u, c, p in evidence if p in names and c in claims}
                credits = None if any(costs[p][0] is None for p in names) else sum(costs[p][0] for p in names)
                rows[sum(1 << i for i in ps)] = (sum(all((u, c) in hit for c in claims) for u in range(12)), len(hit), credits, sum(costs[p][1] for p in names), size)

    def beats(a, b):
        return a[2] is not None and b[2] is not None and a[0] >= b[0] and a[1] >= b[1] and a[2] <= b[2] and (a[0] > b[0] or a[1] > b[1] or a[2] < b[2])

    top = min(rows, key=lambda m: (-rows[m][0], -rows[m][1], rows[m][2] is None, rows[m][2] or 0, rows[m][3], rows[m][4], m))
    expected = {(m, r[4], r[0], r[1], r[2], r[3], not any(beats(o, r) for o in rows.values()), m == top) for m, r in rows.items()}
    assert {tuple(r) for r in got.collect()} == expected
    assert choosing.program_portfolios(spark.createDataFrame([], "unit long, claim string, program string"), spark.createDataFrame([("p0", 1.0, 1)], "program string, credits double, calls long"), ["p0"], claims, 1).first()["complete"] == 0


def test_closure_and_order(spark):
    edges = [(1, 2), (2, 3), (1, 3), (3, 4), (4, 3), (4, 5), (6, 5), (7, 7), (8, 9), (8, 9)]
    df = spark.createDataFrame([*edges, (None, 1)], "a long, b long")
    reach = {(r["seed"], r["node"]): r["depth"] for r in graphs.closure(df, spark.createDataFrame([(1,), (3,), (99,), (None,)], "seed long")).collect()}
    assert reach == {(1, 2): 1, (1, 3): 1, (1, 4): 2, (1, 5): 3, (3, 4): 1, (3, 3): 2, (3, 5): 2}
    got = {r["node"]: (r["level"], r["status"]) for r in graphs.causal_order(df, spark.createDataFrame([(50,)], "node long")).collect()}
    assert got == {1: (0, "ordered"), 2: (1, "ordered"), 3: (None, "cyclic"), 4: (None, "cyclic"), 5: (None, "blocked"), 6: (0, "ordered"), 7: (None, "cyclic"), 8: (0, "ordered"), 9: (1, "ordered"), 50: (0, "ordered")}
    assert graphs.causal_order(df.where("false")).count() == 0


def test_unsafe_components_equal_pairs(spark):
    rng = random.Random(11)
    rows = []
    for c in range(150):
        pool = rng.sample("abcdefghijklmnopqr", rng.randint(2, 18))
        rows += [(c, rng.choice(["Ann Lee", " ann  lee", "", None]), " ".join(rng.sample(pool, rng.randint(0, min(len(pool), rng.choice([2, 3, 14])))))) for _ in range(rng.randint(1, 6))]
    got = {r["component"]: r["reasons"] for r in entity.unsafe_components(spark.createDataFrame(rows, "component long, name string, title string"), "component", ["name"], "title", ["a"]).collect()}
    expected = {}
    for c in range(150):
        sets = [set(t.split()) - {"a"} for k, _, t in rows if k == c]
        if any(x and y and not x & y for x, y in itertools.combinations(sets, 2)):
            expected[c] = ["disjoint_titles"]
    assert got == expected and 20 < len(expected) < 130


def test_a_large_component_needs_no_pairs(spark):
    # every title shares a word with every other one, but no word is in all
    words = spark.range(10_000).select(F.lit(1).alias("component"), F.concat_ws(" ", F.when(F.col("id") % 3 != 0, "red"), F.when(F.col("id") % 3 != 1, "green"), F.when(F.col("id") % 3 != 2, "blue"), F.concat(F.lit("w"), F.col("id").cast("string"))).alias("title"))
    assert entity.unsafe_components(words, "component", [], "title").count() == 0
    odd = words.unionByName(spark.createDataFrame([(1, "yellow w5 red green")], "component int, title string"))
    assert entity.unsafe_components(odd, "component", [], "title").count() == 0
    apart = words.unionByName(spark.createDataFrame([(1, "yellow red")], "component int, title string"))
    assert entity.unsafe_components(apart, "component", [], "title").first()["reasons"] == ["disjoint_titles"]


@pytest.mark.parametrize("floor", [0.85, 0.6, 0.3])
def test_candidates_hold_every_pair(spark, floor):
    rng = random.Random(int(floor * 100))
    base = ["".join(rng.choices("abcdefgh ", k=rng.randint(1, 18))) for _ in range(50)]
    other = [n[: rng.randint(0, len(n))] + rng.choice("abz") + n[rng.randint(0, len(n)) :] for n in base] + base[:5]
    one, two = (spark.createDataFrame([(n,) for n in names], "name string") for names in (base, other))
    got = {tuple(r) for r in joins.name_candidates(one, two, floor).collect()}
    assert {(a, b) for a in base for b in other if SequenceMatcher(None, a, b, autojunk=False).ratio() >= floor} <= got


def test_candidates_are_far_fewer_than_pairs(spark):
    rng = random.Random(5)
    syllables = ["ba", "ko", "ri", "tan", "mel", "dor", "vis", "lu", "pre", "st", "on", "ex"]
    names = sorted({" ".join("".join(rng.choices(syllables, k=rng.randint(2, 4))) for _ in range(2)) for _ in range(1500)})
    df = spark.createDataFrame([(n,) for n in names], "name string")
    assert joins.name_candidates(df, df, 0.85).count() < len(names) ** 2 / 100


def test_connectors_name_the_strongest_signal(spark):
    import datetime as dt

    from signal_engine.operators import connectors

    day = lambda y: dt.date(y, 1, 1)
    roles = [("c", "r1", "Acme Inc.", day(2001), day(2004), False), ("t", "r2", "acme", day(2003), None, True), ("u", "r3", "Acme Labs", day(2003), None, False), ("v", "r4", "Pineacme", day(2001), day(2009), False)]
    signals = [("c", "u", "city", "Ulm"), ("c", "v", "investor", "F1"), ("c", "v", "investor", "F2"), ("c", "w", "direct_intro", "e9"), ("c", "w", "investor", None)]
    got = connectors.target_connectors(
        spark.createDataFrame([("c", x, r) for x, r in (("t", "High"), ("u", "high"), ("v", " "), ("w", None))], "connector string, target string, confidence string"),
        spark.createDataFrame(roles, "person string, role_id string, company string, start date, end date, is_current boolean"), spark.createDataFrame(signals, "connector string, target string, kind string, value string"), F.to_date(F.lit("2010-01-01")),
    )
    rows = {r["target"]: (r["score"], r["shared_signal"], r["shared_detail"], r["segment"], r["evidence_ids"]) for r in got.collect()}
    assert rows == {
        "t": (95.0, "verified_work_overlap", "Acme Inc., 2003-01-01 to 2004-01-01", "strong_warm_intro", ["r1", "r2"]),
        "u": (55.0, "company_proximity", "Acme Inc.; employment dates unavailable or non-overlapping", "review_warm_intro", []),
        "v": (2.0, "investor_overlap", "F1; F2", "no_strong_path", []), "w": (160.0, "direct_introduction", "e9", "review_warm_intro", ["e9"]),
    }
