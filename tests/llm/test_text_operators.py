"""Decontamination, language identification, license scans, the n-gram join and chat formatting on small tables,
against brute force, with nulls, empty and long texts, repeated rows, empty tables and extra columns."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from signal_engine.llm import chat_format, decontaminate, langid, license_scan, ngram_join

DOCS = "doc_id long, text string, lang string, score string, sid string, n long"


def words(rng, n):
    return [rng.choice("the of and quick brown fox jumps over lazy dog alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randint(0, 40)) for _ in range(n)]


def corpus(seed=1):
    rng = random.Random(seed)
    rows = []
    base = words(rng, 120)
    for i in range(30):  # near copies of one text, more than the class bound
        w = list(base)
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = f"x{i}"
        rows.append((i, " ".join(w)))
    passage = words(rng, 60)
    rows += [(100 + i, " ".join(words(rng, 9) + passage + words(rng, 6))) for i in range(40)]  # a shared passage
    rows += [(200 + i, " ".join(words(rng, rng.randint(1, 90)))) for i in range(60)]
    rows += [(300, None), (301, ""), (302, " \n\t "), (303, "one two three"), (304, "ONE two  three"), (305, rows[0][1]), (306, rows[0][1]), (307, " ".join(words(rng, 30_000)))]
    return [(i, t, "en", "extra", "extra", -1) for i, t in rows]


def brute_components(rows):
    sets = {}
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                inter = len(sets[a] & sets[b])
                if 100 * inter >= 80 * (len(sets[a]) + len(sets[b]) - inter):
                    x, y = sorted((find(a), find(b)))
                    parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("frequent", [24, 3])
def test_ngram_join_equals_brute_force(spark, scratch, monkeypatch, frequent):
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    rows = corpus()
    got = ngram_join.join_documents(spark.createDataFrame(rows, DOCS), scratch("t6"))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == brute_components(rows)


def edited_copies(n=1500, length=60, seed=8):
    """A text's copies with none to many changed words, so that many pairs are near the threshold."""
    rng = random.Random(seed)
    base = words(rng, length)
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(w))
            w[at : at + rng.randint(0, 2)] = [f"e{rng.randrange(400)}" for _ in range(rng.randint(0, 2))]
        rows.append((i, " ".join(w)))
    return rows


def test_ngram_join_of_many_edited_copies(spark, scratch, monkeypatch):
    import numpy as np

    monkeypatch.setattr(ngram_join, "TILE", 200)
    rows = edited_copies()
    got = ngram_join.join_documents(spark.createDataFrame(rows, "doc_id long, text string"), scratch("t6"))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    place = {g: k for k, g in enumerate(sorted(set().union(*sets)))}
    m = np.zeros((len(sets), len(place)), np.float32)
    for i, own in enumerate(sets):
        m[i, [place[g] for g in own]] = 1
    inter, size = m @ m.T, m.sum(1)
    linked = 100 * inter >= 80 * (size[:, None] + size[None] - inter)
    label = np.arange(len(sets))
    while True:
        low = np.where(linked, label[None], len(sets)).min(1)
        if (low == label).all():
            break
        label = low
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == dict(enumerate(label.tolist()))
    assert 10 < len(set(label.tolist())) < len(sets)


def two_groups(size, length=204, seed=4):
    """Two groups of near copies; every text of one has a similarity of 178 / 224 with every text of the other."""
    rng = random.Random(seed)
    base = words(rng, length)
    other = base[:80] + [f"y{k}" for k in range(18)] + base[98:]
    return [(2 * i + g, " ".join([*w, f"end{g}x{i}"])) for i in range(size) for g, w in enumerate((base, other))]


@pytest.mark.parametrize("tile", [1024, 5])
def test_ngram_join_makes_no_pairs_of_two_groups_below_the_threshold(spark, scratch, monkeypatch, tile):
    monkeypatch.setattr(ngram_join, "TILE", tile)
    made, verify = [], ngram_join._Join.verify
    monkeypatch.setattr(ngram_join._Join, "verify", lambda self, pairs, label: made.append(pairs.count()) or verify(self, pairs, label))
    rows = two_groups(60)
    got = ngram_join.join_documents(spark.createDataFrame(rows, "doc_id long, text string"), scratch("t6"))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == {i: (201, i % 2) for i, _ in rows} == brute_components(rows)
    assert sum(made) <= 4 * len(rows)


def test_pipeline_makes_no_pairs_of_two_groups_below_the_threshold(spark, monkeypatch):
    import corpus_pipeline

    made, verify = [], ngram_join._Join.verify
    monkeypatch.setattr(ngram_join._Join, "verify", lambda self, pairs, label: made.append(pairs.count()) or verify(self, pairs, label))
    rows = two_groups(60)
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(map(tuple, kept.collect())) == rows[:2]
    assert sum(made) <= 4 * len(rows)


def test_tiles_return_fewer_pairs_than_rows():
    import numpy as np

    hashes = {}
    tokens = [np.sort(np.asarray([hashes.setdefault(tuple(w[k : k + 5]), ngram_join.set_id(np.asarray([len(hashes)], np.uint64))) for k in range(len(w) - 4)], np.int64).view(np.uint64)) for w in (t.split() for _, t in [*edited_copies(300), *two_groups(60)])]
    tokens = [np.unique(x) for x in tokens]
    n = np.asarray([len(x) for x in tokens])
    sid, tile = np.arange(len(n)), np.zeros(len(n), np.int64)
    sketch = ngram_join.sketches(np.concatenate(tokens), n)
    brute = np.arange(len(n))
    linked = []
    for i in range(len(n)):
        for j in range(i):
            common = len(np.intersect1d(tokens[i], tokens[j], assume_unique=True))
            if 100 * common >= 80 * (n[i] + n[j] - common):
                linked.append((i, j))
                brute[brute == brute[i]] = brute[j]
    pairs = ngram_join.true_forest(sid, n, sid, sketch, tokens, 80)
    got = sid.copy()
    for i, j in pairs:
        got[got == got[i]] = got[j]
    assert len(set(zip(brute.tolist(), got.tolist(), strict=True))) == len(set(brute.tolist())) == len(set(got.tolist()))
    assert len(pairs) == len(n) - len(set(brute.tolist())) < len(linked) // 10
    assert len(pairs) // 2 < len(ngram_join.likely_forest(sid, n, sid, tile, sketch, 80)) < len(n)
    across = ngram_join.likely_forest(sid, n, sid, sid % 2, sketch, 80)
    assert across and all((i + j) % 2 for i, j in across)
    assert ngram_join.has_partner(sid, n, sid, tile, sketch, 80)[[i for pair in linked for i in pair]].all()
    assert not ngram_join.has_partner(sid, n, tile, tile, sketch, 80).any()


def test_sketches_bound_the_difference():
    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(50):
        a = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 400), dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 1 << 63, rng.integers(0, 60), dtype=np.uint64)]))
        x, y = ngram_join.sketches(np.concatenate([a, b]), np.asarray([len(a), len(b)]))
        while len(x) != len(y):
            x, y = sorted((x, y), key=len)
            y = y[: len(y) // 2] ^ y[len(y) // 2 :]
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_rows_are_told_apart_by_id_and_text(spark, scratch):
    rng = random.Random(2)
    one, two = (" ".join(words(rng, 40)) for _ in range(2))
    rows = [(5, one), (5, two), (7, two), (None, one), (None, " ".join(words(rng, 30))), (3, one), (9, None), (9, "")]
    got = ngram_join.group_rows(spark.createDataFrame(rows, "doc_id long, text string"), scratch("t6")).collect()
    stays = {(r["doc_id"], r["n_shingles"]) for r in got if r["doc_id"] == r["component_id"] and r["row"] == r["first_row"]}
    assert stays == {(3, 36), (5, 36), (9, 0), (None, 26)} and len(got) == len(rows)


def test_ngram_join_empty(spark, scratch):
    assert ngram_join.join_documents(spark.createDataFrame([], DOCS), scratch("t6")).count() == 0


def brute_matches(docs, items, percent=80):
    def cut(t):
        return re.findall(r"[^\W_]+", (t or "").lower())

    out = {}
    for d, t in docs:
        w = cut(t)
        for i, x in items:
            v = cut(x)
            k = min(5, len(v))
            if not v or len(w) < k:
                continue
            grams = lambda u, k=k: [tuple(u[j : j + k]) for j in range(len(u) - k + 1)]
            own, best = Counter(grams(v)), None
            for s in range(max(1, len(w) - len(v) + 1)):
                there = Counter(grams(w[s : s + len(v)]))
                inter = sum((own & there).values())
                total = sum((own | there).values())
                if 100 * inter >= percent * total and (best is None or inter / total > best[1]):
                    best = (s, inter / total)
            if best:
                out[d, i] = best
    return out


def test_decontamination_equals_brute_force(spark, scratch):
    rng = random.Random(5)
    items = [(i, " ".join(words(rng, n))) for i, n in enumerate((40, 40, 70, 12, 5, 3, 1, 55))] + [(90, None), (91, ""), (92, "..."), (93, "a a a a a a a a a a")]
    docs = []
    for i, x in items[:6]:
        w = x.split()
        docs += [(10 * i, " ".join(words(rng, 30) + w + words(rng, 20))), (10 * i + 1, " ".join(w).upper() + "!!"), (10 * i + 2, " ".join(words(rng, 8) + w[: len(w) // 2] + words(rng, 9)))]
    changed = items[2][1].split()
    changed[35] = "changed"
    docs += [(500, " ".join(words(rng, 200) + changed)), (501, None), (502, ""), (503, "a a a a a a a a a a a"), (504, " ".join(words(rng, 20_000) + items[0][1].split()))]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs] + [(500, docs[-5][1], "x", 1)], "doc_id long, text string, item_id string, hamming int")
    bench = spark.createDataFrame([(i, x, "y") for i, x in items], "item_id long, text string, doc_id string")
    got = {(r["doc_id"], r["item_id"]): (r["start_word"], r["similarity"]) for r in decontaminate.find_matches(df, bench, scratch("t1")).collect()}
    expected = brute_matches(docs, items)
    assert set(got) == set(expected)
    assert all(abs(got[k][1] - expected[k][1]) < 1e-12 for k in got)
    again = {(r["doc_id"], r["item_id"]): (r["start_word"], r["similarity"]) for r in decontaminate.find_matches(df, bench, scratch("t1"), block_rows=60).collect()}
    assert again == got


def test_decontamination_finds_reordered_items(spark, scratch):
    rng = random.Random(15)
    items = [(i, " ".join(words(rng, n))) for i, n in enumerate((59, 60, 150, 44))] + [(9, " ".join(["a b c d e f g"] * 9))]
    docs = []
    for i, x in items:
        w = x.split()
        half, third = len(w) // 2, len(w) // 3
        docs += [(10 * i, " ".join(words(rng, 70) + w[half:] + w[:half] + words(rng, 80))), (10 * i + 1, " ".join(w[half:] + w[:half])), (10 * i + 2, " ".join(words(rng, 9) + w[2 * third :] + w[third : 2 * third] + w[:third] + words(rng, 3))), (10 * i + 3, " ".join(words(rng, 20) + w[: len(w) - 6]))]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["start_word"], r["similarity"]) for r in decontaminate.find_matches(df, bench, scratch("t1")).collect()}
    expected = brute_matches(docs, items)
    assert (0, 0) in expected and set(got) == set(expected)
    assert all(got[k][0] == expected[k][0] and abs(got[k][1] - expected[k][1]) < 1e-12 for k in got)


def test_long_items_take_time_in_proportion_to_their_length(spark, scratch):
    import time

    rng = random.Random(17)
    words = [f"w{rng.randint(0, 3000)}" for _ in range(20_000)]
    text = " ".join(["x"] * 300 + words[9_000:] + words[:9_000] + ["y"] * 300)  # the item with its halves swapped
    docs = spark.createDataFrame([(1, text), (2, " ".join(words[:12_000])), (3, " ".join(words))], "doc_id long, text string")
    items = spark.createDataFrame([("i", " ".join(words))], "item_id string, text string")
    at = time.perf_counter()
    got = {r["doc_id"]: (r["start_word"], r["similarity"]) for r in decontaminate.find_matches(docs, items, scratch("t1")).collect()}
    assert set(got) == {1, 3} and got[3] == (0, 1.0) and got[1][0] == 300 and got[1][1] > 0.99
    assert time.perf_counter() - at < 60


def test_decontamination_with_repeats_ties_and_null_ids(spark, scratch):
    item = "a b c d e f g h a b c d e f g h a b c"
    docs = spark.createDataFrame([(1, f"{item} {item}"), (1, f"z {item}"), (2, f"q q {item} q {item}"), (2, f"q q {item} q {item}"), (None, item), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([("x", item), ("x", item), ("y", item.upper()), (None, item), ("e", ""), ("n", None)], "item_id string, text string")
    got = {(r["doc_id"], r["item_id"]): (r["start_word"], r["similarity"]) for r in decontaminate.find_matches(docs, items, scratch("t1")).collect()}
    assert got == {(d, i): (0 if d == 1 else 2, 1.0) for d in (1, 2) for i in "xy"}


def test_decontamination_empty(spark, scratch):
    docs, items = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_matches(docs, items, scratch("t1")).count() == 0
    assert decontaminate.find_matches(docs.where("false"), spark.createDataFrame([(1, "a b c d e")], "item_id long, text string"), scratch("t1")).count() == 0


def test_blocks_cover_the_radius():
    rng = random.Random(3)
    bounds = decontaminate.block_bounds(decontaminate.RADIUS)
    assert bounds[0][0] == 0 and sum(n for _, n in bounds) == 64
    for _ in range(200):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), decontaminate.RADIUS):
            b ^= 1 << bit
        assert any((a >> f) & ((1 << n) - 1) == (b >> f) & ((1 << n) - 1) for f, n in bounds)


def test_license_scan(spark):
    text = "Under the MIT License. Or the mit-license; GNU General Public License"
    rows = [(1, text), (2, None), (3, ""), (4, "Licensed under CC BY-NC 4.0."), (5, "general license public"), (6, "K mit license İ"), (7, "w " * 40_000 + "apache license"), (1, text)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, label string")
    rows = license_scan.digest(license_scan.scan(df)).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(got) == 7 and len(rows) == 8
    assert (got[1]["n_words"], got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["base_labels"]) == (12, 3, 2, 9, "gpl,mit")
    assert (got[2]["n_words"], got[2]["n_base"], got[2]["first_word"], got[2]["labels"], got[2]["score"]) == (0, 0, None, "", 0.0)
    assert got[4]["labels"] == "cc-by-nc" and got[4]["base_labels"] == "" and got[5]["n_base"] == 0 and got[6]["n_base"] == 1
    assert (got[7]["n_words"], got[7]["first_word"]) == (40_002, 40_000)
    assert license_scan.digest(license_scan.scan(df.where("false"))).count() == 0


def brute_scan(text, phrases, templates):
    """(n_words, base places, verified spans) of one text, template by template."""
    w = [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if x]
    base = sorted((label, i) for label, phrase in phrases for p in [phrase.split()] for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p)
    spans = []
    for label, phrase in templates:
        t = phrase.split()
        k = min(4, len(t))
        votes = {}
        for i in range(len(w) - k + 1):
            for off in range(len(t) - k + 1):
                if w[i : i + k] == t[off : off + k]:
                    votes.setdefault(i - off, []).append((i, off))
        groups, last = [], None
        for d in sorted(votes):
            if last is None or d - last > 3:
                groups.append([])
            groups[-1] += votes[d]
            last = d
        for g in groups:
            cover = len({off for _, off in g}) / (len(t) - k + 1)
            if cover >= 0.6:
                spans.append((label, min(i for i, _ in g), max(i for i, _ in g) + k, cover))
    return len(w), base, sorted(spans)


def test_license_spans_equal_brute_force(spark):
    rng = random.Random(23)
    texts = [None, "", "...", "MIT license mit-license MIT  license"]
    for _ in range(150):
        parts = []
        for _ in range(rng.randint(1, 4)):
            t = rng.choice(license_scan.TEMPLATES)[1].split()
            a = rng.randint(0, len(t) - 1)
            t = t[: rng.randint(a, len(t))] if rng.random() < 0.3 else t  # cut near the cover that is asked for
            for _ in range(rng.randint(0, 4)):  # near copies: a word in, out or changed, so that neighbouring diagonals vote
                if t:
                    i = rng.randrange(len(t))
                    t = t[:i] + rng.choice([[], [t[i], "extra"], ["other"]]) + t[i + 1 :]
            parts += [rng.choice(["so", "it", "The", "é"])] * rng.randint(0, 5) + [x.upper() if rng.random() < 0.2 else x for x in t]
        texts.append(rng.choice([" ", ", ", "\n* "]).join(parts))
    rows = list(enumerate(texts)) + [(7, texts[7]), (7, texts[7]), (7, texts[9])]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n long, label string").repartition(4)
    got = sorted((r["doc_id"], r["n_words"], [tuple(x) for x in r["base"]], [tuple(x) for x in r["spans"]]) for r in license_scan.scan(df).collect())
    expected = sorted((i, *brute_scan(t, license_scan.BASE_PHRASES, license_scan.TEMPLATES)) for i, t in rows)
    assert got == expected and sum(len(s) for *_, s in got) > 100


def test_license_base_columns_equal_sql(spark):
    import duckdb

    from signal_engine.llm import queries

    columns = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    got = sorted(tuple(r[c] for c in columns) for r in queries.op5_license_scan(spark, "/root/testdata/sf0.01").collect())
    phrases = ", ".join(f"('{label}', '{phrase}')" for label, phrase in license_scan.BASE_PHRASES)
    sql = rf"""WITH t AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM '/root/testdata/sf0.01/documents.parquet'),
    p(label, phrase) AS (VALUES {phrases}), q AS (SELECT label, string_split(phrase, ' ') AS v FROM p),
    h AS (SELECT doc_id, label, unnest(list_filter(range(len(w)), lambda i: w[i + 1:i + len(v)] = v)) AS i FROM t, q)
    SELECT t.doc_id, any_value(len(w)), count(i), min(i), max(i), coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') FROM t LEFT JOIN h USING (doc_id) GROUP BY 1 ORDER BY 1"""
    assert got == duckdb.sql(sql).fetchall()


def test_language_identification(spark):
    import public_tokenizers

    rng = random.Random(7)
    syllables = {"aa": "the tion ing er and".split(), "bb": "sch ung heit ein keit".split()}
    rows = []
    for i in range(400):
        lang = ("aa", "bb")[i % 2]
        rows.append((i, " ".join("".join(rng.choices(syllables[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(3, 40))), lang, 0.5, "x"))
    rows += [(1000, None, "aa", 0.5, "x"), (1001, "", None, 0.5, "x"), (1002, "123 !!", "bb", 0.5, "x"), (1003, "SCHUNG! heitkeit", None, 0.5, "x"), (1004, "thetion " * 20_000, None, 0.5, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, lang_pred string")
    model = langid.fit(df.where(~langid.held_out()), public_tokenizers.path("piece_bpe_32k.model"))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(df, model).collect()}
    right = [got[i][0] == lang for i, _, lang, *_ in rows[:400]]
    assert sum(right) / len(right) > 0.97
    assert [got[i] for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert got[1003][0] == "bb" and got[1004][0] == "aa" and all(0 <= s <= 1 for _, s in got.values())
    kept = langid.keep_languages(df, model)
    assert kept.columns == df.columns and {1000, 1001, 1002} & {r["doc_id"] for r in kept.collect()} == set()
    assert langid.predict(df.where("false"), model).count() == 0
    nothing = langid.fit(df.where("false"), public_tokenizers.path("piece_bpe_32k.model"))
    assert {r["lang_pred"] for r in langid.predict(df.limit(3), nothing).collect()} == {"und"}


def test_forward_sums_all_segmentations():
    import numpy as np

    pieces = tuple(sorted(("▁", "▁a", "a", "b", "ab", "▁ab")))
    lattice = langid.Lattice(pieces)
    p = np.asarray([[0.1 + 0.05 * i] for i in range(len(pieces))] + [[0.0]])
    (_, chars), = langid._by_length(["ab"])
    prob = {x: p[i, 0] for i, x in enumerate(pieces)}

    def every(s):
        return 1.0 if not s else sum(prob.get(s[:k], langid.UNKNOWN if k == 1 else 0.0) * every(s[k:]) for k in range(1, len(s) + 1))

    assert abs(langid.forward(lattice.edges(chars), p)[-1][0, 0] - every("▁ab")) < 1e-12


def brute_text(text, pieces, p, language):
    """A text's log probability: every segmentation of every word, character by character, in plain floats."""
    import math

    prob = {x: float(p[i, language]) for i, x in enumerate(pieces)}

    def word(w):
        rest = [0.0] * len(w) + [0.0]
        for at in range(len(w) - 1, -1, -1):
            terms = [math.log(x) + rest[at + k] for k in range(1, min(20, len(w) - at) + 1) if (x := max(prob.get(w[at : at + k], 0.0), langid.UNKNOWN if k == 1 else 0.0))]
            top = max(terms)
            rest[at] = top + math.log(math.fsum(math.exp(x - top) for x in terms))
        return rest[0]

    return sum(word("▁" + w) for w in text.split())


def test_texts_are_scored_over_all_segmentations_in_every_language():
    import numpy as np
    import pyarrow as pa

    rng = random.Random(13)
    pieces = tuple(sorted({"▁", "▁a", "a", "b", "ab", "▁ab", "aab", "b\u0301", "bababababab", "▁abababababababab"}))
    p = np.random.default_rng(13).random((len(pieces) + 1, 300)) + 1e-3
    p[-1] = 0
    model = langid.Model(pieces, tuple(f"l{i:03d}" for i in range(300)), p / p.sum(0))
    texts = [" ".join("".join(rng.choice(["a", "b", "ab", "bababababab", "b\u0301", "c"]) for _ in range(rng.choice([1, 3, 40]))) for _ in range(rng.randint(1, 6))) for _ in range(8)] + ["ab" * 800]
    logs, words = langid.Scorer(model).score(pa.array(texts, pa.large_string()))
    assert words.tolist() == [len(t.split()) for t in texts]
    for i, t in enumerate(texts):
        for language in (0, 137, 299):
            want = brute_text(t, pieces, model.p, language)
            assert abs(logs[i, language] - want) < 1e-9 * abs(want) + 1e-9


def test_expected_pieces_of_long_words_equal_those_of_short_ones(monkeypatch):
    import numpy as np

    pieces = tuple(sorted(("▁", "▁a", "a", "b", "ab", "▁ab", "aba")))
    lattice, words, counts = langid.Lattice(pieces), ["abab", "b", "aabba" * 3], np.asarray([3, 2, 5])
    q = np.asarray([0.1, 0.05, 0.2, 0.1, 0.3, 0.15, 0.1, 0.0])
    short = langid.expected_pieces(lattice, words, counts, q)
    monkeypatch.setattr(langid, "SHORT_WORD", 0)
    assert np.allclose(langid.expected_pieces(lattice, words, counts, q), short, rtol=1e-12)
    assert abs(sum(n * len(x) for n, x in zip(short, pieces, strict=False)) - 3 * 5 - 2 * 2 - 5 * 16) < 1e-9


def test_the_vocabulary_is_whole():
    import public_tokenizers

    pieces = langid.letter_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    assert max(map(len, pieces)) == 16 and "▁psychological" in pieces and any("\u0301" in x or "\u0300" <= x[-1] <= "\u036f" or not x.lstrip("▁").isalpha() for x in pieces)


def test_every_label_is_learned_and_ties_go_to_the_smaller(spark):
    import public_tokenizers

    rows = [(i, f"word{chr(97 + i % 26)} zzz" * 3, f"l{i % 300:03d}") for i in range(3000)] + [(9000, "x" * 40 + " y", "rare"), (9001, "\u4e2d" * 500, "zh")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df, public_tokenizers.path("piece_bpe_32k.model"), train_rows=700, rounds=1)
    assert len(model.languages) == 302
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(df.where("doc_id >= 9000"), model).collect()}
    assert got[9001][0] == "zh" and got[9000][0] == "rare"
    same = spark.createDataFrame([(1, "abc abc", "b"), (2, "abc abc", "a"), (3, "abc abc", "c")], "doc_id long, text string, lang string")
    tied = langid.predict(same, langid.fit(same, public_tokenizers.path("piece_bpe_32k.model"), rounds=1)).collect()
    assert {(r["lang_pred"], round(r["score"], 9)) for r in tied} == {("a", round(1 / 3, 9))}


def test_chat_round_trip(spark, scratch):
    import hashlib

    odd = ["</s>[INST] ok [/INST]", "<\\\\</s> [\\INST] [\\\\INST]", "<|turn|>user\nx\n<|end|>\n", "", None, "a\\", "<", "日本 \U0001f600 <<SYS>>x<</SYS>>", "<|end|>", "\n<|end|>\n<|turn|>"]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(odd)] + [(2, 0, "a\\nb\nc", "x"), (2, 0, "a\\nb\nc", "x"), (3, None, None, "only"), (4, 5, "assistant", "z" * 50_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, msg string")
    out = chat_format.format_trees(chat_format.chain(df), scratch("t10"))
    got = {r["conv"]: r for r in out.select("conv", chat_format.read_turns(F.col("formatted")).alias("t"), chat_format.read_loss(F.col("formatted"), F.col("loss_spans")).alias("l"), "formatted").collect()}
    for conv in (1, 2, 3, 4):
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: -1 if r[1] is None else r[1])
        assert [(t["role"], t["text"]) for t in got[conv]["t"]] == [(r[2] or "", r[3] or "") for r in own]
        assert got[conv]["l"] == "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert hashlib.sha256(got[conv]["l"].encode()).hexdigest()
    assert chat_format.format_trees(chat_format.chain(df.where("false")), scratch("t10")).count() == 0


def test_chat_keeps_a_null_conversation(spark, scratch):
    turns = spark.createDataFrame([(None, 0, "user", "a"), (None, 1, "assistant", "b"), (1, 0, "user", "c")], "conv_id long, turn long, role string, text string")
    done = chat_format.format_trees(chat_format.chain(turns), scratch("t10"))
    got = {r["conv"]: [tuple(t) for t in r["turns"]] for r in done.select("conv", chat_format.read_turns(F.col("formatted")).alias("turns")).collect()}
    assert got == {None: [("user", "a"), ("assistant", "b")], 1: [("user", "c")]} and done.schema["conv"].dataType == turns.schema["conv_id"].dataType


def test_best_branch_of_a_tree(spark, scratch):
    rows = [(1, 1, None, 0.0), (1, 2, 1, 1.0), (1, 3, 1, 5.0), (1, 4, 2, 9.0), (1, 5, 3, 0.0), (1, 6, 99, 1.0)]
    df = spark.createDataFrame([(c, m, p, "user", f"m{m}", s) for c, m, p, s in rows], "conv long, msg long, parent long, role string, text string, score double")
    paths = chat_format.choose_paths(df, scratch("t10"), branches=2).collect()
    by_branch = {b: [r["msg"] for r in sorted((x for x in paths if x["branch"] == b), key=lambda r: r["depth"])] for b in (1, 2)}
    assert by_branch == {1: [1, 2, 4], 2: [1, 3, 5]}
