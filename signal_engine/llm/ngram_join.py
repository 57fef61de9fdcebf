"""N-gram Jaccard join by token-combination prefixes.

A document's set holds the 64-bit hashes of its distinct five-word shingles. Equal sets are one node. Two
nodes link when 100 x intersection >= 80 x union. With at most t = n - ceil(0.8 n) of a set's tokens missing
from a partner, candidates are found as follows.

* Tokens are ordered by level, then by hash. Level 0 is rare; a token is frequent when more than ``FREQUENT``
  nodes hold it among the tokens counted for them, and every factor of ``STEP`` beyond is a further level. A
  level is a bitmap of bounded size, so two tokens may share a bit: any rule that is the same for all nodes
  is right, the counts only make it fast. Counted are each node's lowest-hashed tokens (a fixed share of its
  set), and all tokens of nodes whose counted ones are mostly frequent ("dense" nodes).
* Rare tokens are indexed singly. Frequent ones fall into 2^j token classes, j growing with the set's size,
  and are indexed as pairs within a class. A prefix is extended until (rare tokens) + sum over classes of
  (tokens - 1) exceeds t: then a partner keeps a rare token or two tokens of one class, so both share a
  signature. Most prefixes are t + 1 rare tokens.
* Every node has a sketch, the parity of its tokens' number in each of 4 n hash cells or more (fewer for very large sets). The cells in which
  two sketches differ are no more than the tokens that only one of the sets holds, so a pair whose sketches
  differ more than a linked pair's sets may is dropped, exactly and without reading the sets.
* In every bucket the smallest member (the pivot) meets all others; what the sketches leave is verified on the
  whole sets, each node's likeliest partner first, then the pairs that still join different components.
* Last, the other members of a bucket that are in different components are compared by sketch, in tiles. A tile
  returns a forest of likely pairs, fewer than it has components; those are verified and components merged,
  first inside tiles, then across them. The members that still have a possible partner in another component are
  returned once more, a row each, and their whole sets meet in groups that return a forest of true links. So no
  bucket is cut off, and no tile returns more rows than it reads, whether pairs link or not.

Nothing that grows with the documents is collected or broadcast but the bitmaps: a level's has at most half the
bits of the one before, so together they take at most twice ``MAX_BITS`` bits (64 MB). Tables that later steps
share are written to the shared folder, so lost executors cost a step at most.

Defined results: null text or text without words has an empty set, no links and component_id = its id; fewer
than five words are one shingle; repeated ids are one row each, with their own text; an empty table gives an
empty result; other columns are ignored; a null id is kept and never names a component that has another id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signal_engine.llm.common import as_arrow_string, Scratch, SLICE_BYTES, slices, sole_cache, tidy

SHINGLE = 5
FREQUENT = 24
STEP = 3
MIN_BITS, MAX_BITS = 16, 28
CELLS, MOST_CELLS = 4, 1 << 14  # sketch cells for each token, at least; all cells of a set of up to so many tokens
BEST = 4
TILE = 1024  # a bucket of c members has sqrt(c / TILE) tiles, so it is dealt so many times
TILE_TOKENS = 1 << 22  # or more tiles, so that the sets of a tile's members take about 32 MB at most
ROUNDS = 60
WHOLE = 64  # sets up to this size are counted whole
_A, _B, _C = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _A
    h = (h ^ (h >> np.uint64(33))) * _B
    return h ^ (h >> np.uint64(33))


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all texts in order, number of each text's)."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    counts = np.diff(np.asarray(lists.offsets)).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    code = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in distinct), np.uint64, len(distinct))
    where = np.asarray(coded.indices)
    empty = distinct.index("") if "" in distinct else -1
    kept = where != empty
    owner = np.repeat(np.arange(len(counts)), counts)[kept]
    words = code[where[kept]]
    counts = np.bincount(owner, minlength=len(counts))
    ends = np.cumsum(counts)
    rolled = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for i in range(size):
        rolled = rolled * _C + words[i : i + len(rolled)]
    rolled = mix(rolled)
    out, sizes = [], np.zeros(len(counts), np.int64)
    for k, (a, n) in enumerate(zip((ends - counts).tolist(), counts.tolist(), strict=True)):
        if n == 0:
            continue
        if n < size:
            h = np.uint64(n)
            for w in words[a : a + n]:
                h = np.uint64((int(h) * int(_C) + int(w)) % (1 << 64))
            own = mix(np.asarray([h ^ _B]))
        else:
            own = np.sort(rolled[a : a + n - size + 1])
            if len(own) > 1:
                own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        out.append(own)
        sizes[k] = len(own)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), sizes


def missing(n: np.ndarray, percent: int) -> np.ndarray:
    """The most tokens of a set of n that a partner can lack."""
    return n - -(-percent * n // 100)


def counted(n: int, percent: int) -> int:
    """How many of a set's lowest-hashed tokens are counted."""
    return n if n <= WHOLE else min(n, -(-13 * (int(missing(n, percent)) + 1) // 10) + 8)


def set_id(own: np.ndarray) -> int:
    return int(mix(np.asarray([mix(own ^ _C).sum(dtype=np.uint64) + np.uint64(len(own))], np.uint64)).astype(np.int64)[0])


def _is_set(bitmap: np.ndarray, bits: int, tokens: np.ndarray) -> np.ndarray:
    at = (tokens * _C) >> np.uint64(64 - bits)
    return (bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def levels(maps, tokens: np.ndarray) -> np.ndarray:
    """The level of each token: the most bitmaps of one count that it is in."""
    out = np.zeros(len(tokens), np.int8)
    for counts in maps:
        out = np.maximum(out, sum((_is_set(bitmap, bits, tokens).astype(np.int8) for bits, bitmap in counts), np.zeros(len(tokens), np.int8)))
    return out


def class_bits(n: int) -> int:
    return max(0, (n // 4).bit_length() - 1)


def signatures(own: np.ndarray, level: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(rare tokens, pair signatures) of a whole set in hash order; level: its tokens' levels."""
    n = len(own)
    need = int(missing(n, percent)) + 1
    rare = own[level == 0]
    if len(rare) >= need:
        return rare[:need], np.zeros(0, np.uint64)
    order = np.argsort(level, kind="stable")
    often, pairs = own[order][len(rare) :], []
    for j in {class_bits(n), class_bits(100 * n // percent)}:
        cls = mix(often ^ _A) >> np.uint64(64 - j) if j else np.zeros(len(often), np.uint64)
        members: dict[int, list[int]] = {}
        have = len(rare)
        for k, c in enumerate(cls.tolist()):
            if have >= need:
                break
            group = members.setdefault(c, [])
            have += bool(group)
            group.append(k)
        for group in members.values():
            for x in range(len(group)):
                for y in range(x):
                    pairs.append((group[y], group[x], j))
    if not pairs:
        return rare, np.zeros(0, np.uint64)
    a, b, j = np.asarray(pairs, np.int64).T
    return rare, mix(mix(often[a] * _C + often[b]) + j.astype(np.uint64) + np.uint64(1))


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)])
    flat = np.concatenate([*values, np.zeros(0, np.uint64)]).astype(np.uint64).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))


def _arrays(column: pa.Array) -> list[np.ndarray]:
    flat = np.asarray(column.flatten()).astype(np.int64).view(np.uint64)
    ends = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(column)).astype(np.int64))])
    return [flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def components(edges: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """(node, comp): the smallest node reachable, for every node of the edges (a, b); alternating stars."""
    now = scratch.write(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), f"{label}-0")
    seen = None
    for step in range(1, ROUNDS + 1):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        now = scratch.write(small, f"{label}-{step}")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(f"{label}-{step - 1}")
        if state == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("comp"))).distinct()
        seen = state
    raise RuntimeError(f"components did not settle in {ROUNDS} rounds")


def sketches(flat: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """For each set the parity of its tokens' number in every hash cell, as 64-bit words; a power of two of words,
    so that a sketch of twice the words folds onto one of half. Large sets have MOST_CELLS, or one a token."""
    cells = np.maximum(np.minimum(CELLS * sizes, MOST_CELLS), np.maximum(sizes, 1))
    words = 1 << np.maximum(0, np.ceil(np.log2(cells / 64))).astype(np.int64)
    ends = np.cumsum(words)
    cell = flat & (np.repeat(words, sizes) * 64 - 1).astype(np.uint64)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    np.bitwise_xor.at(out, np.repeat(ends - words, sizes) + (cell >> np.uint64(6)).astype(np.int64), np.uint64(1) << (cell & np.uint64(63)))
    return [out[e - w : e] for e, w in zip(ends.tolist(), words.tolist(), strict=True)]


def near_blocks(sid: np.ndarray, n: np.ndarray, comp: np.ndarray, tile: np.ndarray, sketch: list[np.ndarray], percent: int):
    """(a, b, ok, differ) for blocks of pairs, each pair in one: rows a and b, which pairs of them are of different
    components and let by their sketches to link, and their sketches' difference. If there are two tiles, only pairs
    across them."""
    words = np.fromiter((len(x) for x in sketch), np.int64, len(sketch))
    across = len(tile) > 0 and bool((tile != tile[0]).any())
    for w in np.unique(words).tolist():
        own = np.flatnonzero(words == w)
        x = np.stack([sketch[i] for i in own])
        for factor in (1, 2):
            other = np.flatnonzero(words == w * factor)
            if not len(other):
                continue
            y = x if factor == 1 else np.stack([sketch[i][:w] ^ sketch[i][w:] for i in other])
            step = max(1, 2_000_000 // (len(other) * w))
            for at in range(0, len(own), step):
                a = own[at : at + step]
                differ = np.bitwise_count(x[at : at + step, None, :] ^ y[None]).sum(-1, dtype=np.int64)
                total = n[a][:, None] + n[other][None]
                ok = differ <= total - 2 * -(-percent * total // (100 + percent))
                ok &= (comp[a][:, None] != comp[other][None]) & (100 * np.minimum(n[a][:, None], n[other][None]) >= percent * np.maximum(n[a][:, None], n[other][None]))
                if across:
                    ok &= tile[a][:, None] != tile[other][None]
                if factor == 1:
                    ok &= sid[a][:, None] < sid[other][None]
                if ok.any():
                    yield a, other, ok, differ


def likely_forest(sid: np.ndarray, n: np.ndarray, comp: np.ndarray, tile: np.ndarray, sketch: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Pairs of rows (places) that would join components, fewer than there are: of each row's BEST likeliest partners,
    by growing difference of the sketches, those that no pair before has joined."""
    found = []
    for a, b, ok, differ in near_blocks(sid, n, comp, tile, sketch, percent):
        if ok.shape[1] > BEST:
            bound = np.partition(np.where(ok, differ, 1 << 40), BEST - 1, axis=1)[:, BEST - 1]
            ok &= differ <= bound[:, None]
            ok &= np.cumsum(ok, axis=1) <= BEST
        i, j = np.nonzero(ok)
        found.append(np.stack([differ[i, j], a[i], b[j]]))
    if not found:
        return []
    pairs = np.concatenate(found, axis=1)
    top: dict[int, int] = {}

    def root(c: int) -> int:
        while (up := top.get(c, c)) != c:
            top[c] = c = top.get(up, up)
        return c

    out = []
    for _, i, j in pairs[:, np.lexsort(pairs[::-1])].T.tolist():
        if (x := root(int(comp[i]))) != (y := root(int(comp[j]))):
            top[y] = x
            out.append((i, j))
    return out


def has_partner(sid: np.ndarray, n: np.ndarray, comp: np.ndarray, tile: np.ndarray, sketch: list[np.ndarray], percent: int) -> np.ndarray:
    """Which rows are in any pair of near_blocks."""
    out = np.zeros(len(sid), bool)
    for a, b, ok, _ in near_blocks(sid, n, comp, tile, sketch, percent):
        out[a[ok.any(1)]] = True
        out[b[ok.any(0)]] = True
    return out


def true_forest(sid: np.ndarray, n: np.ndarray, comp: np.ndarray, sketch: list[np.ndarray], tokens: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Pairs of rows (places) that link, fewer than there are components: every pair of near_blocks that is still in
    different components is verified on the whole sets."""
    distinct, code = np.unique(np.concatenate(tokens), return_inverse=True)
    ends = np.cumsum([len(x) for x in tokens])
    own = [code[e - len(x) : e] for e, x in zip(ends.tolist(), tokens, strict=True)]
    mark, comp, out = np.zeros(len(distinct), np.int64), comp.copy(), []
    for a, b, ok, _ in near_blocks(sid, n, comp.copy(), np.zeros(len(sid), np.int64), sketch, percent):
        for k in np.flatnonzero(ok.any(1)).tolist():
            i = int(a[k])
            others = b[ok[k] & (comp[b] != comp[i])]
            if not len(others):
                continue
            mark[own[i]] = 1
            sizes = n[others]
            common = np.add.reduceat(mark[np.concatenate([own[j] for j in others.tolist()])], np.cumsum(sizes) - sizes)
            mark[own[i]] = 0
            for j in others[100 * common >= percent * (n[i] + sizes - common)].tolist():
                if comp[j] != comp[i]:
                    comp[comp == comp[j]] = comp[i]
                    out.append((i, j))
    return out


def by_group(keys: list[str], handle):
    """A function of batches sorted by keys that calls handle(rows, cuts) with tables of whole groups: group g is
    rows[cuts[g] : cuts[g + 1]]."""

    def run(batches):
        kept = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            now = now if kept is None else pa.concat_tables([kept, now])
            key = np.stack([np.asarray(now[c].combine_chunks()).astype(np.int64) for c in keys])
            cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist()]
            kept = now.slice(cuts[-1])  # the last group may go on in the next batch
            if len(cuts) > 1:
                yield handle(now, cuts)
        if kept is not None and kept.num_rows:
            yield handle(kept, [0, kept.num_rows])

    return run


def _longs(rows: pa.Table, *names: str) -> list[np.ndarray]:
    return [np.asarray(rows[c].combine_chunks()).astype(np.int64) for c in names]


class _Join:
    def __init__(self, docs: DataFrame, scratch: Scratch, id_col: str, text_col: str, percent: int, slice_bytes: int):
        if not 50 < percent <= 100:
            raise ValueError("percent must be above 50: partners are of less than twice the size")
        self.spark, self.scratch, self.percent, self.slice_bytes = docs.sparkSession, scratch, percent, slice_bytes
        self.docs = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("t"), row_key(id_col, text_col).alias("row"))

    def whole(self) -> DataFrame:
        """(doc, row, n, sid, low, sketch) of every document; low: the counted tokens."""
        percent, limit = self.percent, self.slice_bytes

        def run(batches):
            sole_cache("none", lambda: None)
            for batch in batches:
                texts = as_arrow_string(batch.column(1))
                for i, j in slices(texts, limit):
                    flat, sizes = shingle_sets(texts[i:j])
                    ends = np.cumsum(sizes)
                    own = [flat[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                    low = _lists([s[: counted(len(s), percent)] for s in own])
                    ids = pa.array([set_id(s) for s in own], pa.int64())
                    yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], batch.column(2)[i:j], pa.array(sizes), ids, low, _lists(sketches(flat, sizes))], ["doc", "row", "n", "sid", "low", "sketch"])

        return self.docs.mapInArrow(tidy(run), "doc long, row long, n long, sid long, low array<long>, sketch array<long>")

    def read_sets(self, chosen: DataFrame) -> DataFrame:
        """(doc, sid, tokens) of the documents in chosen (rep) and of a few others; a bitmap of bounded size spares
        most other documents the work."""
        reps = chosen.select(F.col("rep").alias("x"), F.lit(0).alias("level")).distinct()
        [(bits, bitmap)] = self.bitmaps(reps, [reps.count()], hashed=False)
        shared, limit = self.spark.sparkContext.broadcast(bitmap), self.slice_bytes

        def run(batches):
            for batch in batches:
                ids = np.asarray(batch.column(0).fill_null(0)).astype(np.int64).view(np.uint64)
                keep = pa.array(_is_set(shared.value, bits, mix(ids)) & np.asarray(batch.column(0).is_valid()))
                rows = batch.filter(keep)
                texts = as_arrow_string(rows.column(1))
                for i, j in slices(texts, limit):
                    flat, sizes = shingle_sets(texts[i:j])
                    ends = np.cumsum(sizes)
                    own = [flat[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([rows.column(0)[i:j], pa.array([set_id(s) for s in own], pa.int64()), _lists(own)], ["doc", "sid", "tokens"])

        return self.docs.select("doc", "t").mapInArrow(tidy(run), "doc long, sid long, tokens array<long>")

    def sets_of(self, chosen: DataFrame, label: str) -> DataFrame:
        """(sid, tokens) of the nodes in chosen (sid, rep), written; a repeated row may repeat its set."""
        named = chosen.select("sid", F.col("rep").alias("doc")).distinct()
        return self.scratch.write(self.read_sets(chosen).join(named, ["sid", "doc"], "left_semi").select("sid", "tokens"), label)

    def bitmaps(self, values: DataFrame, counts: list[int], hashed: bool = True) -> list[tuple[int, np.ndarray]]:
        """Bitmaps of hashed 64-bit values (x, level): bitmap l has the values of level >= l, of which there are
        counts[l]; its size follows their number up to MAX_BITS - l bits."""
        sizes = [min(MAX_BITS - k, max(MIN_BITS, (16 * n).bit_length())) for k, n in enumerate(counts)]

        def run(batches):
            for batch in batches:
                at = np.asarray(batch.column(0).is_valid())
                x = np.asarray(batch.column(0).drop_null()).astype(np.int64).view(np.uint64)
                level = np.asarray(batch.column(1))[at]
                for k, bits in enumerate(sizes):
                    bit = (((x if hashed else mix(x)) * _C) >> np.uint64(64 - bits))[level >= k]
                    word, place = np.unique((bit >> np.uint64(6)).astype(np.int64), return_inverse=True)
                    mask = np.zeros(len(word), np.uint64)
                    np.bitwise_or.at(mask, place, np.uint64(1) << (bit & np.uint64(63)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(word), k), pa.int32()), pa.array(word), pa.array(mask.view(np.int64))], ["k", "word", "mask"])

        out = [np.zeros(1 << (bits - 6), np.uint64) for bits in sizes]
        words = values.select("x", "level").mapInArrow(tidy(run), "k int, word long, mask long").groupBy("k", "word").agg(F.bit_or("mask").alias("mask"))
        for part in words.toArrow().to_batches():  # at most 2^23 rows
            k, word, mask = (np.asarray(c) for c in part.columns)
            for level, bitmap in enumerate(out):
                bitmap[word[k == level]] = mask[k == level].view(np.uint64)
        return list(zip(sizes, out, strict=True))

    def frequent_bits(self, tokens: DataFrame, label: str) -> list[tuple[int, np.ndarray]]:
        """One bitmap for each level that any token reaches."""
        steps = [FREQUENT * STEP**k for k in range(1, 30)]
        often = self.scratch.write(tokens.groupBy("x").count().where(F.col("count") > FREQUENT).select("x", sum(((F.col("count") > b).cast("int") for b in steps), F.lit(0)).alias("level")), label)
        at = {r["level"]: r["n"] for r in often.groupBy("level").agg(F.count("*").alias("n")).collect()}  # 30 rows at most
        return self.bitmaps(often, [sum(n for k, n in at.items() if k >= level) for level in range(max(at) + 1)]) if at else []

    def prefixes(self, nodes: DataFrame, maps) -> DataFrame:
        """(sid, n, rep, rare): the prefix of nodes that have enough rare counted tokens, else null."""
        shared, percent = self.spark.sparkContext.broadcast(maps), self.percent

        def run(batches):
            for batch in batches:
                flat = np.asarray(batch.column(3).flatten()).astype(np.int64).view(np.uint64)
                often = levels(shared.value, flat) > 0
                own, at, out = _arrays(batch.column(3)), 0, []
                for n, low in zip(batch.column(1).to_pylist(), own, strict=True):
                    need = int(missing(n, percent)) + 1
                    rare = low[~often[at : at + len(low)]]
                    at += len(low)
                    out.append(rare[:need] if len(rare) >= need else np.zeros(0, np.uint64))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), _lists(out)], ["sid", "n", "rep", "rare"])

        return nodes.select("sid", "n", "rep", "low").mapInArrow(tidy(run), "sid long, n long, rep long, rare array<long>")

    def dense_signatures(self, sets: DataFrame, maps) -> DataFrame:
        """(sid, n, rare, pairs) from whole sets (sid, tokens)."""
        shared, percent = self.spark.sparkContext.broadcast(maps), self.percent

        def run(batches):
            for batch in batches:
                rare, pairs, sizes = [], [], []
                for own in _arrays(batch.column(1)):
                    a, b = signatures(own, levels(shared.value, own), percent)
                    rare.append(a)
                    pairs.append(b)
                    sizes.append(len(own))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), _lists(rare), _lists(pairs)], ["sid", "n", "rare", "pairs"])

        return sets.select("sid", "tokens").mapInArrow(tidy(run), "sid long, n long, rare array<long>, pairs array<long>")

    def run(self) -> DataFrame:
        s, percent = self.scratch, self.percent
        whole = s.write(self.whole(), "whole")
        members = s.write(whole.select("doc", "row", "n", "sid"), "members")
        first = F.min(F.struct("doc", "row")).alias("first")
        nodes = whole.where("n > 0 AND doc IS NOT NULL").groupBy("sid", "n").agg(first, F.first("low").alias("low"), F.first("sketch").alias("sketch"))
        self.nodes = nodes = s.write(nodes.select("sid", "n", F.col("first.doc").alias("rep"), F.col("first.row").alias("row"), "low", "sketch"), "nodes")
        s.drop("whole")

        low = nodes.select(F.explode("low").alias("x"))
        maps = [self.frequent_bits(low, "often-0")]
        pre = self.prefixes(nodes, maps)
        dense = s.write(pre.where(F.size("rare") == 0).select("sid", "rep"), "dense-0")
        sets = None
        if dense.head(1):
            sets = self.sets_of(dense, "dense-sets-0")
            maps.append(self.frequent_bits(sets.select(F.explode("tokens").alias("x")), "often-1"))
            pre = self.prefixes(nodes, maps)
            later = s.write(pre.where(F.size("rare") == 0).select("sid", "rep").join(dense.select("sid"), "sid", "left_anti"), "dense-1")
            if later.head(1):
                sets = sets.unionByName(self.sets_of(later, "dense-sets-1"))
        single = pre.where(F.size("rare") > 0).select("sid", "n", F.explode("rare").alias("sig"))
        pair = None
        if sets is not None:
            signed = s.write(self.dense_signatures(sets, maps), "signed")
            single = single.unionByName(signed.select("sid", "n", F.explode("rare").alias("sig")))
            pair = signed.select("sid", "n", F.explode("pairs").alias("sig"))

        # buckets of two members or more, with their smallest member
        order = Window.partitionBy("sig").orderBy("n", "sid")
        first = single.withColumn("pivot", F.first("sid").over(order)).withColumn("pn", F.first("n").over(order)).withColumn("more", F.lead("sid").over(order))
        buckets = first.where((F.col("pivot") != F.col("sid")) | F.col("more").isNotNull()).drop("more")
        if pair is not None:
            stats = pair.groupBy("sig").agg(F.count("*").alias("c"), F.min(F.struct("n", "sid")).alias("p")).where("c > 1")
            buckets = buckets.unionByName(pair.join(stats, "sig").select("sid", "n", "sig", F.col("p.sid").alias("pivot"), F.col("p.n").alias("pn")))
        buckets = s.write(buckets.where("sid <> pivot"), "buckets")

        fits = percent * F.greatest("n", "pn") <= 100 * F.least("n", "pn")
        near = s.write(self.prune(buckets.where(fits).select(F.col("sid").alias("a"), F.col("pivot").alias("b")).distinct()), "near")
        likeliest = near.groupBy("a").agg(F.min_by(F.struct("b", "a_rep", "b_rep"), F.struct("differ", "b")).alias("p")).select("a", "p.*")
        comp = components(self.verify(s.write(likeliest, "likeliest"), "links-0"), s, "cc-0")
        comp = self.merged(comp, self.verify(s.write(self.apart(near, comp), "other-stars"), "links-1"), "cc-1")
        size = F.count("*").alias("c"), F.sum("n").alias("w")
        wide = buckets.groupBy("sig").agg(*size).where(self.tiles() > 1).head(1)
        for turn in ("inside", "across") if wide else ("inside",):
            pairs = s.write(self.likely(buckets, comp, turn), f"likely-{turn}")
            if pairs.head(1):
                comp = self.merged(comp, self.verify(pairs, f"links-{turn}"), f"cc-{turn}")
        comp = self.merged(comp, self.rest(buckets, comp), "cc-rest")

        named = nodes.select("sid", "rep", "row").join(comp.withColumnRenamed("node", "sid"), "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
        label = named.groupBy("comp").agg(F.min(F.struct("rep", "row")).alias("first"))
        of_set = named.join(label, "comp").select("sid", F.col("first.rep").alias("id"), F.col("first.row").alias("first_row"))
        some = F.col("n") > 0
        return members.join(of_set, "sid", "left").select(
            "doc", "row", F.col("n").alias("n_shingles"), F.when(some, F.coalesce("id", "doc")).otherwise(F.col("doc")).alias("component_id"), F.when(some, F.coalesce("first_row", "row")).otherwise(F.col("row")).alias("first_row")
        )

    def prune(self, pairs: DataFrame) -> DataFrame:
        """(a, b, differ, a_rep, b_rep): the pairs (a, b) whose sketches let them link."""
        side = lambda p: self.nodes.select(F.col("sid").alias(p), F.col("n").alias(f"{p}n"), F.col("rep").alias(f"{p}_rep"), F.col("sketch").alias(f"{p}s"))

        def cut(x: str, y: str):
            half = F.size(y)
            folded = F.zip_with(F.slice(x, 1, half), F.slice(x, half + 1, half), lambda p, q: p.bitwiseXOR(q))
            return F.when(F.size(x) > half, folded).otherwise(F.col(x))

        differ = F.aggregate(F.zip_with(cut("as", "bs"), cut("bs", "as"), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda acc, x: acc + x)
        total = F.col("an") + F.col("bn")
        most = total - 2 * F.expr(f"({self.percent} * (an + bn) + {99 + self.percent}) div {100 + self.percent}")
        both = pairs.join(side("b"), "b").join(side("a"), "a").withColumn("most", most).withColumn("differ", differ)
        return both.where("differ <= most").select("a", "b", "differ", "a_rep", "b_rep")

    def apart(self, pairs: DataFrame, comp: DataFrame) -> DataFrame:
        """The pairs (a, b) of different components."""
        side = lambda p: comp.select(F.col("node").alias(p), F.col("comp").alias(f"{p}c"))
        both = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
        return both.where(F.coalesce("ac", "a") != F.coalesce("bc", "b")).drop("ac", "bc")

    def merged(self, comp: DataFrame, links: DataFrame, label: str) -> DataFrame:
        """The components (node, comp) with further links, which are contracted to their components first."""
        if not links.head(1):
            return comp
        of = lambda p: comp.select(F.col("node").alias(p), F.col("comp").alias(f"{p}c"))
        edges = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ac", "a").alias("a"), F.coalesce("bc", "b").alias("b"))
        over = components(edges, self.scratch, label).select(F.col("node").alias("comp"), F.col("comp").alias("top"))
        moved = comp.join(over, "comp", "left").select("node", F.coalesce("top", "comp").alias("comp"))
        fresh = over.select(F.col("comp").alias("node"), F.col("top").alias("comp")).join(comp.select("node"), "node", "left_anti")
        return self.scratch.write(moved.unionByName(fresh), f"{label}-all")

    def tiles(self) -> Column:
        """The number of tiles of a bucket of c members whose sets hold w tokens."""
        return F.ceil(F.greatest(F.sqrt(F.col("c") / TILE), F.col("w") / TILE_TOKENS)).cast("int")

    def dealt(self, buckets: DataFrame, comp: DataFrame, which: str) -> DataFrame:
        """(sig, t, u, sid, n, comp, tile, sketch), grouped: the members, but for the pivots, of buckets with more than
        one component, in every pair of tiles; which: only pairs "inside" a tile, "across" two, or "all"."""
        left = buckets.select("sig", "sid", "n").join(comp.withColumnRenamed("node", "sid"), "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
        mixed = left.groupBy("sig").agg(F.count("*").alias("c"), F.sum("n").alias("w"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
        left = left.join(mixed.select("sig", self.tiles().alias("tiles")), "sig").withColumn("tile", F.pmod(F.xxhash64("sid"), F.col("tiles")).cast("int"))
        if which == "inside":
            left = left.withColumn("u", F.col("tile"))
        else:
            left = left.withColumn("u", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
            left = left.where("tile <> u") if which == "across" else left
        left = left.select("sig", "sid", "n", "comp", "tile", F.least("tile", "u").alias("t"), F.greatest("tile", "u").alias("u"))
        both = left.join(self.nodes.select("sid", "sketch"), "sid").repartition("sig", "t", "u").sortWithinPartitions("sig", "t", "u")
        return both.select("sig", "t", "u", "sid", "n", "comp", "tile", "sketch")

    def likely(self, buckets: DataFrame, comp: DataFrame, which: str) -> DataFrame:
        """(a, b, a_rep, b_rep): a likely_forest of each pair of tiles."""
        percent = self.percent

        def forests(rows: pa.Table, cuts: list[int]) -> pa.RecordBatch:
            sid, n, comp_of, tile = _longs(rows, "sid", "n", "comp", "tile")
            sketch, found = _arrays(rows["sketch"].combine_chunks()), []
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                found += [(i + x, i + y) for x, y in likely_forest(sid[i:j], n[i:j], comp_of[i:j], tile[i:j], sketch[i:j], percent)]
            at = np.asarray(found, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(sid[at[:, 0]]), pa.array(sid[at[:, 1]])], ["a", "b"])

        pairs = self.dealt(buckets, comp, which).mapInArrow(tidy(by_group(["sig", "t", "u"], forests)), "a long, b long").distinct()
        rep = lambda p: self.nodes.select(F.col("sid").alias(p), F.col("rep").alias(f"{p}_rep"))
        return pairs.join(rep("a"), "a").join(rep("b"), "b")

    def rest(self, buckets: DataFrame, comp: DataFrame) -> DataFrame:
        """(a, b): links that join all components that any pair of a bucket, not its pivot, joins. Members with a
        possible partner meet with their whole sets, by pairs of tiles; pairs of tiles with the same such members are
        one group, named by a hash of them (if two should share it, they only meet more members)."""
        percent = self.percent

        def open_members(rows: pa.Table, cuts: list[int]) -> pa.RecordBatch:
            sid, n, comp_of, tile = _longs(rows, "sid", "n", "comp", "tile")
            sketch, group, member = _arrays(rows["sketch"].combine_chunks()), [], []
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                own = np.sort(sid[i:j][has_partner(sid[i:j], n[i:j], comp_of[i:j], tile[i:j], sketch[i:j], percent)])
                if len(own):
                    group.append(np.full(len(own), set_id(own.view(np.uint64))))
                    member.append(own)
            none = np.zeros(0, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([none, *group])), pa.array(np.concatenate([none, *member]))], ["grp", "sid"])

        def forests(rows: pa.Table, cuts: list[int]) -> pa.RecordBatch:
            sid, n, comp_of = _longs(rows, "sid", "n", "comp")
            sketch, tokens, found = _arrays(rows["sketch"].combine_chunks()), _arrays(rows["tokens"].combine_chunks()), []
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                found += [(i + x, i + y) for x, y in true_forest(sid[i:j], n[i:j], comp_of[i:j], sketch[i:j], tokens[i:j], percent)]
            at = np.asarray(found, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(sid[at[:, 0]]), pa.array(sid[at[:, 1]])], ["a", "b"])

        opened = self.dealt(buckets, comp, "all").mapInArrow(tidy(by_group(["sig", "t", "u"], open_members)), "grp long, sid long").distinct()
        opened = self.scratch.write(opened, "open")
        if not opened.head(1):
            return opened.select(F.col("grp").alias("a"), F.col("sid").alias("b"))
        nodes = self.nodes.select("sid", "n", "rep", "sketch").join(opened.select("sid").distinct(), "sid", "left_semi")
        nodes = nodes.join(comp.withColumnRenamed("node", "sid"), "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
        nodes = self.scratch.write(nodes, "open-nodes")
        sets = self.sets_of(nodes, "open-sets").dropDuplicates(["sid"])
        groups = opened.join(nodes.join(sets, "sid"), "sid").repartition("grp").sortWithinPartitions("grp")
        links = groups.select("grp", "sid", "n", "comp", "sketch", "tokens").mapInArrow(tidy(by_group(["grp"], forests)), "a long, b long").distinct()
        return self.scratch.write(links, "links-rest")

    def verify(self, pairs: DataFrame, label: str) -> DataFrame:
        """The pairs (a, b) of a written table (a, b, a_rep, b_rep) that link, by their whole sets. The sets of b are
        written; those of a are read from the documents again and go straight to their pairs."""
        right = self.sets_of(pairs.select(F.col("b").alias("sid"), F.col("b_rep").alias("rep")), f"{label}-sets").select(F.col("sid").alias("b"), F.col("tokens").alias("tb"))
        left = self.read_sets(pairs.select(F.col("a_rep").alias("rep"))).select(F.col("sid").alias("a"), F.col("doc").alias("a_rep"), F.col("tokens").alias("ta"))
        both = pairs.select("a", "b", "a_rep").join(right, "b").join(left, ["a", "a_rep"]).withColumn("common", F.size(F.array_intersect("ta", "tb")))
        links = both.where(100 * F.col("common") >= self.percent * (F.size("ta") + F.size("tb") - F.col("common"))).select("a", "b").distinct()
        links = self.scratch.write(links, label)
        self.scratch.drop(f"{label}-sets")
        return links


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """What tells rows apart that repeat an id with another text."""
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"))


def group_rows(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(id, row, n_shingles, component_id, first_row) for every document: row is its row_key, first_row that of the
    row of the smallest id (of these, the smallest key) in its component, its own where it links with nothing."""
    return _Join(docs, scratch, id_col, text_col, percent, slice_bytes).run().withColumnRenamed("doc", id_col)


def join_documents(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id) for every document."""
    return group_rows(docs, scratch, id_col, text_col, percent).drop("row", "first_row")
