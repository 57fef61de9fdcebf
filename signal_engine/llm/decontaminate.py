"""Benchmark decontamination with SimHash windows, multi-index Hamming blocks and exact verification.

Words are maximal runs of letters and digits, lower-cased; shingles are of five words (an item with fewer
words is one shingle of all its words). A window of an item's length (cut to the document's) is fingerprinted
wherever it begins, in whatever order its shingles are, if it lies in a range that holds enough places of the
item's shingles to reach the similarity. Such a window holds one of the item's rarest shingles, of which as many are
looked up as the similarity allows to miss, and one more; the windows around all of a document's hits are merged to
ranges. A 64-bit SimHash weights every shingle by its number of occurrences. Fingerprints are cut into radius + 1
blocks; two within the radius agree in one block at least, so joining on (item, block, value) finds every
pair within the radius, and each pair is kept at its first common block only. Candidates are verified by the
weighted Jaccard similarity of the two shingle multisets.

Windows are never cut out: the bit counts of a range's places are summed up once, and a window's are the difference of
two sums; its common shingles are those places whose last occurrences before it leave room for them, which is an
interval of window beginnings for each place. So a range takes time in proportion to its length, whatever the item's.

A window is joined to the items whose shingles led to it only: at a similarity of 0.8, fingerprints differ in ten of
64 bits on the average, so a radius that loses none (20) leaves blocks of three bits, which alone select little. The
shingles' index is what keeps candidates few; the blocks and the radius then hold for every pair.

The benchmark is handled in blocks of at most ``block_rows`` shingles; each is broadcast to a pass over
the documents, so documents are neither shuffled nor collected, but those that hold ranges; these are read once more.

Defined results: null or empty texts and items match nothing; a repeated document row or item row gives its
match once; several windows give the most similar, then the first; an empty table gives an empty result;
rows and items without an id are left out (give rows a key of their own to have them judged, as the pipeline
does); other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signal_engine.llm.common import Scratch

SHINGLE = 5
RADIUS = 20
BROADCAST_RANGES = 1_000_000  # ranges up to which they are sent to the documents; more are joined by document
NOT_WORD = r"[^\p{L}\p{N}]+"


def let(value: Column, use) -> Column:
    """use(value) with the value computed once, also where use refers to it inside a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words(text: Column) -> Column:
    """The words of a text, an empty array for null or none."""
    trimmed = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), rf"^{NOT_WORD}|{NOT_WORD}$", "")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, NOT_WORD))


def gram(w: Column, at: Column, k: int) -> Column:
    """Hash of the k words from a place on."""
    return F.xxhash64(*[F.get(w, at + i) for i in range(k)])


def shingles(w: Column, k: int) -> Column:
    """Hashes of all k-word shingles in order."""
    return F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: gram(w, i, k))


def _lanes(hashes: Column) -> Column:
    """How often each bit is set; bits j and j + 32 share a 64-bit counter."""
    ones = F.lit((1 << 32) | 1)
    return F.transform(
        F.sequence(F.lit(0), F.lit(31)),
        lambda j: F.aggregate(hashes, F.lit(0).cast("long"), lambda acc, h: acc + F.call_function("shiftrightunsigned", h, j).bitwiseAND(ones)),
    )


def simhash(hashes: Column) -> Column:
    """64-bit SimHash of a hash multiset."""
    return let(hashes, lambda h: let(_lanes(h), lambda lanes: _signs(lanes, F.size(h).cast("long"))))


_LANES = range(32)
_ONES = (1 << 32) | 1


def _lane(h: Column, j: int) -> Column:
    """Bits j and j + 32 of a hash, as counts of a lane."""
    return F.call_function("shiftrightunsigned", h, F.lit(j)).bitwiseAND(F.lit(_ONES))


def _signs(lanes: Column, n: Column) -> Column:
    def bit(count: Column, at: Column) -> Column:
        return F.when(2 * count > n, F.call_function("shiftleft", F.lit(1).cast("long"), at)).otherwise(F.lit(0).cast("long"))

    def add(acc: Column, j: Column) -> Column:
        lane = F.element_at(lanes, j + 1)
        return acc.bitwiseOR(bit(lane.bitwiseAND(F.lit(0xFFFFFFFF)), j)).bitwiseOR(bit(F.call_function("shiftrightunsigned", lane, F.lit(32)), j + 32))

    return F.aggregate(F.sequence(F.lit(0), F.lit(31)), F.lit(0).cast("long"), add)


def block_bounds(radius: int) -> list[tuple[int, int]]:
    """(first bit, bits) of radius + 1 blocks that cover 64 bits."""
    n = radius + 1
    cuts = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def block_value(fp: Column, first: int, bits: int) -> Column:
    return F.call_function("shiftrightunsigned", fp, F.lit(first)).bitwiseAND(F.lit((1 << bits) - 1))


def _ranges(hit: DataFrame, k: int) -> DataFrame:
    """(rid, doc, th, key, len, s, places, lo, hi): the window beginnings from lo to hi around the hits (doc, th, n,
    key, len, s, pos) of a document and item, overlapping ones merged; places: shingles of a window."""
    size = F.least("len", "n")
    lo, hi = F.greatest(F.lit(0), F.col("pos") - size + k), F.least(F.col("pos"), F.col("n") - size)
    own = Window.partitionBy("doc", "th", "key").orderBy("lo", "hi")
    spans = hit.select("doc", "th", "key", "len", "s", (size - k + 1).alias("places"), lo.alias("lo"), hi.alias("hi")).where("lo <= hi")
    new = F.coalesce(F.max("hi").over(own.rowsBetween(Window.unboundedPreceding, -1)) + 1 < F.col("lo"), F.lit(True))
    spans = spans.withColumn("new", new.cast("int")).withColumn("island", F.sum("new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    merged = spans.groupBy("doc", "th", "key", "len", "s", "places", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return merged.drop("island").withColumn("rid", F.monotonically_increasing_id())


def _window_matches(read: DataFrame, ranges: DataFrame, number: int, counted: DataFrame, scratch: Scratch, label: str, k: int, percent: int) -> DataFrame:
    """(doc, key, len, s, places, start, common, wfp): every window of the ranges that can reach the similarity, its
    shingles in common with the item's and its fingerprint. read: documents (doc, th, t)."""
    sent = F.broadcast if number <= BROADCAST_RANGES else lambda df: df
    held = read.join(sent(ranges.select("doc", "th").distinct()), ["doc", "th"], "left_semi").dropDuplicates(["doc", "th"])
    held = held.select("doc", "th", words(F.col("t")).alias("w")).join(sent(ranges), ["doc", "th"])
    hashes = let(F.col("w"), lambda w: F.transform(F.sequence("lo", F.col("hi") + F.col("places") - 1), lambda i: gram(w, i, k)))
    rows = held.select("rid", "key", "s", "places", "lo", "hi", F.posexplode(hashes).alias("at", "h")).withColumn("pos", F.col("lo") + F.col("at")).drop("at")
    # at most block_rows rows
    rows = scratch.write(rows.join(F.broadcast(counted), ["key", "h"], "left"), f"range-places-{label}")
    enough = rows.groupBy("rid", "s", "places").agg(F.count("c").alias("shared")).where((100 + percent) * F.col("shared") >= percent * (F.col("s") + F.col("places"))).select("rid")
    good = rows.join(enough, "rid")

    so_far = Window.partitionBy("rid").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    sums = good.select("rid", "lo", "hi", "places", "pos", *[F.sum(_lane(F.col("h"), j)).over(so_far).alias(f"l{j}") for j in _LANES])
    # a window's counts: the sum up to its last place less that before its first one
    ends = F.array(F.struct((F.col("pos") - F.col("places") + 1).alias("start"), F.lit(1).alias("sign")), F.struct((F.col("pos") + 1).alias("start"), F.lit(-1).alias("sign")))
    parts = sums.select("*", F.explode(ends).alias("e")).where("e.start BETWEEN lo AND hi")
    lanes = parts.groupBy("rid", "places", F.col("e.start").alias("start")).agg(*[F.sum(F.col("e.sign") * F.col(f"l{j}")).alias(f"l{j}") for j in _LANES])
    prints = lanes.select("rid", "start", F.lit(0).alias("delta"), let(F.array(*[f"l{j}" for j in _LANES]), lambda x: _signs(x, F.col("places").cast("long"))).alias("wfp"))

    # a place is in common with the windows that hold it, but not all the occurrences that the item has, before it
    same = good.where("c IS NOT NULL").groupBy("rid", "h", "c", "lo", "hi", "places").agg(F.array_sort(F.collect_list("pos")).alias("ps"))
    each = same.select("rid", "lo", "hi", "places", F.explode(F.transform("ps", lambda p, i: F.struct(p.alias("p"), F.get(F.col("ps"), i - F.col("c")).alias("before")))).alias("x")).select("rid", "lo", "hi", "places", "x.*")
    since = F.greatest("lo", F.col("p") - F.col("places") + 1, F.coalesce(F.col("before") + 1, F.col("lo")))
    steps = each.select("rid", "hi", F.explode(F.array(F.struct(since.alias("start"), F.lit(1).alias("delta")), F.struct((F.col("p") + 1).alias("start"), F.lit(-1).alias("delta")))).alias("e")).where("e.start <= hi")
    changes = steps.groupBy("rid", F.col("e.start").alias("start")).agg(F.sum("e.delta").alias("delta")).select("rid", "start", "delta", F.lit(None).cast("long").alias("wfp"))

    at = changes.unionByName(prints).groupBy("rid", "start").agg(F.sum("delta").alias("delta"), F.max("wfp").alias("wfp"))
    common = F.sum("delta").over(Window.partitionBy("rid").orderBy("start").rowsBetween(Window.unboundedPreceding, 0))
    found = at.withColumn("common", common).where("wfp IS NOT NULL").join(sent(ranges.select("rid", "doc", "key", "len", "s", "places")), "rid")
    return found.where((100 + percent) * F.col("common") >= percent * (F.col("s") + F.col("places"))).select("doc", "key", "len", "s", "places", "start", "common", "wfp")


def find_matches(
    docs: DataFrame,
    items: DataFrame,
    scratch: Scratch,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    percent: int = 80,
    radius: int = RADIUS,
    block_rows: int = 500_000,
) -> DataFrame:
    """(id, item, start_word, n_words, similarity, hamming) for every document and item with a window of
    weighted shingle similarity of at least percent / 100."""
    bounds = block_bounds(radius)
    item = (
        items.select(F.col(item_col).alias("item"), words(F.col(item_text_col)).alias("iw"))
        .where((F.size("iw") > 0) & F.col("item").isNotNull())
        .dropDuplicates(["item", "iw"])
        .withColumn("len", F.size("iw"))
        .withColumn("k", F.least("len", F.lit(SHINGLE)))
    )
    sizes = item.groupBy("k").agg(F.sum(F.col("len") - F.col("k") + 1).alias("n")).collect()  # five rows at most
    found = None
    for row in sorted(sizes, key=lambda r: -r["k"]):
        k, parts = row["k"], -(-row["n"] // block_rows)
        own = item.where(F.col("k") == k).withColumn("hs", let(F.col("iw"), lambda w: shingles(w, k))).withColumn("fp", simhash(F.col("hs")))
        read = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("t"))
        place = read.select("doc", "th", words(F.col("t")).alias("w")).where(F.size("w") >= k)
        place = place.select("doc", "th", "w", F.explode(F.sequence(F.lit(0), F.size("w") - k)).alias("pos"))
        place = place.select("doc", "th", F.size("w").alias("n"), "pos", gram(F.col("w"), F.col("pos"), k).alias("h"))
        for part in range(parts):
            block = own.where(F.pmod(F.xxhash64("item", "iw"), F.lit(parts)) == part) if parts > 1 else own
            block = block.withColumn("key", F.xxhash64("item", "iw")).withColumn("s", F.size("hs"))
            each = block.select("key", "len", "s", F.explode("hs").alias("h"))
            counted = each.groupBy("key", "h").agg(F.count("*").cast("int").alias("c"))
            each = each.join(each.groupBy("h").agg(F.count("*").alias("times")), "h")
            rarest = Window.partitionBy("key").orderBy("times", "h")
            index = each.withColumn("r", F.row_number().over(rarest)).where(F.col("r") <= F.col("s") - F.ceil(F.col("s") * percent / 100) + 1).select("h", "key", "len", "s").distinct()
            # written, so that no later expression moves into the pass over all places
            hit = scratch.write(place.join(F.broadcast(index), "h").select("doc", "th", "n", "key", "len", "s", "pos"), f"places-{k}-{part}")
            ranges = scratch.write(_ranges(hit, k), f"ranges-{k}-{part}")
            if not (number := ranges.count()):
                continue
            near = _window_matches(read, ranges, number, counted, scratch, f"{k}-{part}", k, percent)
            keyed = near.select("*", F.posexplode(F.array(*[block_value(F.col("wfp"), a, b) for a, b in bounds])).alias("block", "value"))
            entry = block.select("item", "key", "fp", F.posexplode(F.array(*[block_value(F.col("fp"), a, b) for a, b in bounds])).alias("block", "value"))
            pair = keyed.join(F.broadcast(entry), ["key", "block", "value"])
            first = F.coalesce(*[F.when(block_value(F.col("wfp"), a, b) == block_value(F.col("fp"), a, b), F.lit(i)) for i, (a, b) in enumerate(bounds)])
            hamming = F.bit_count(F.col("wfp").bitwiseXOR(F.col("fp")))
            both = F.col("s") + F.col("places") - F.col("common")
            similarity = F.when((F.col("block") == first) & (hamming <= radius) & (100 * F.col("common") >= percent * both), F.col("common") / both)
            one = pair.select("doc", "item", "start", "len", similarity.alias("similarity"), hamming.alias("hamming")).where("similarity IS NOT NULL")
            found = one if found is None else found.unionByName(one)
    if found is None:
        kinds = {f.name: f.dataType.simpleString() for f in [*docs.schema, *items.schema]}
        return docs.sparkSession.createDataFrame([], f"`{id_col}` {kinds[id_col]}, `{item_col}` {kinds[item_col]}, start_word long, n_words long, similarity double, hamming int")
    best = F.max_by(F.struct("start", "len", "similarity", "hamming"), F.struct("similarity", -F.col("start"), -F.col("len"))).alias("best")
    return (
        found.groupBy("doc", "item")
        .agg(best)
        .select(F.col("doc").alias(id_col), F.col("item").alias(item_col), F.col("best.start").cast("long").alias("start_word"), F.col("best.len").cast("long").alias("n_words"), "best.similarity", F.col("best.hamming").cast("int").alias("hamming"))
    )
