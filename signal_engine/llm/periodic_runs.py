"""Runs of words that repeat with a period, found through a suffix automaton.

The automaton of a stretch of words has a state for every set of end positions that some repeated phrase has. The
sets are ordered, and are merged from the longest states up the suffix links, the smaller into the larger. Whenever an
end position gets a new neighbour in a merged set and their distance does not exceed the state's length (times what
the wanted exponent leaves: see ``Shape``), the two phrases make a square; it is extended to both sides while words
that far apart are equal, which gives a run. A distance that is a multiple of the stretch's smallest period is left
out: the smallest one is seeded at a state of its own.

Only stretches that can hold a run go through an automaton: every window of ``Shape.window`` words of a run occurs
once more in it, so windows that occur once in a text cut it. Ordinary prose leaves nothing; the automaton
takes time and memory in proportion to the repeated stretches, a stretch at a time.

Defined results: a null or empty text has no words and no runs; runs are ordered by start, then period; each row gives
its own row, also of repeated ids; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signal_engine.llm.common import as_arrow_string, slices, tidy

_BASE = np.uint64(0x9E3779B97F4A7C15)
_FILTER_ROUNDS = 3


@dataclass(frozen=True)
class Shape:
    """Runs wanted: of ``exponent`` periods (2 or more) and ``least`` words at least."""

    exponent: int = 4
    least: int = 6

    def length(self, period: int) -> int:
        return max(self.least, self.exponent * period)

    @property
    def window(self) -> int:
        """Every window of so many words of a run occurs again one period before or after it, inside the run."""
        return min(self.length(q) - 2 * q + 1 for q in range(1, self.least + 1))

    @property
    def state(self) -> int:
        """The state that holds a run's last two ends one period apart is at least so long."""
        return min(self.length(q) - q for q in range(1, self.least + 1))


def suffix_automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(length of each state, its suffix link, state of each prefix)."""
    length, link, follow, prefixes = [0], [-1], [{}], []
    last = 0
    for word in words:
        new = len(length)
        length.append(length[last] + 1)
        link.append(0)
        follow.append({})
        at = last
        while at >= 0 and word not in follow[at]:
            follow[at][word] = new
            at = link[at]
        if at >= 0:
            to = follow[at][word]
            if length[to] == length[at] + 1:
                link[new] = to
            else:
                copy = len(length)
                length.append(length[at] + 1)
                link.append(link[to])
                follow.append(dict(follow[to]))
                while at >= 0 and follow[at].get(word) == to:
                    follow[at][word] = copy
                    at = link[at]
                link[to] = link[new] = copy
        last = new
        prefixes.append(new)
    return length, link, prefixes


class Ends:
    """An ordered set of end positions in blocks, so that an insertion moves a bounded number of them."""

    __slots__ = ("blocks", "last", "size")
    BLOCK = 512

    def __init__(self, first: int):
        self.blocks, self.last, self.size = [[first]], [first], 1

    def __iter__(self):
        for block in self.blocks:
            yield from block

    def add(self, x: int) -> tuple[int, int]:
        """Insert x, which is not in the set; returns its neighbours (-1: none)."""
        b = min(bisect_left(self.last, x), len(self.last) - 1)
        block = self.blocks[b]
        i = bisect_left(block, x)
        before = block[i - 1] if i else (self.last[b - 1] if b else -1)
        after = block[i] if i < len(block) else -1
        block.insert(i, x)
        self.last[b] = block[-1]
        self.size += 1
        if len(block) > 2 * self.BLOCK:
            self.blocks[b : b + 1] = [block[: self.BLOCK], block[self.BLOCK :]]
            self.last[b : b + 1] = [block[self.BLOCK - 1], block[-1]]
        return before, after


class Runs:
    """The runs of one stretch, from squares."""

    def __init__(self, words: np.ndarray, shape: Shape):
        self.words, self.shape, self.known = words, shape, {}

    def _agree(self, i: int, j: int, step: int) -> int:
        """How far words from i and from j on (step 1) or back (step -1) are equal, i < j."""
        n, total, chunk = len(self.words), 0, 32
        while True:
            room = min(chunk, n - j if step > 0 else i + 1)
            if room <= 0:
                return total
            a, b = (self.words[i : i + room], self.words[j : j + room]) if step > 0 else (self.words[i - room + 1 : i + 1][::-1], self.words[j - room + 1 : j + 1][::-1])
            differ = a != b
            if differ.any():
                return total + int(differ.argmax())
            total, chunk = total + room, 2 * chunk
            i, j = i + step * room, j + step * room

    def square(self, end: int, period: int) -> None:
        """Words up to ``end`` and up to ``end + period`` agree for at least one period."""
        starts, stops = self.known.setdefault(period, ([], []))
        k = bisect_right(starts, end - period + 1) - 1
        if k >= 0 and end + period < stops[k]:
            return  # inside a stretch seen before
        start = end + 1 - self._agree(end, end + period, -1)
        stop = end + 1 + period + self._agree(end + 1, end + 1 + period, 1)
        k = bisect_left(starts, start)
        starts.insert(k, start)
        stops.insert(k, stop)

    def found(self) -> list[tuple[int, int, int]]:
        """(start, length, smallest period)."""
        out = []
        for period, (starts, stops) in self.known.items():
            for start, stop in zip(starts, stops, strict=True):
                if stop - start >= self.shape.length(period) and self._primitive(start, period):
                    out.append((start, stop - start, period))
        return out

    def _primitive(self, start: int, period: int) -> bool:
        rest, factor = period, 2
        block = self.words[start : start + period]
        while rest > 1:
            if factor * factor > rest:
                factor = rest
            if rest % factor == 0:
                part = period // factor
                if (block[part:] == block[:-part]).all():
                    return False
                while rest % factor == 0:
                    rest //= factor
            factor += 1
        return True


def stretch_runs(words: np.ndarray, shape: Shape) -> list[tuple[int, int, int]]:
    """(start, length, period) of a stretch's runs."""
    length, link, prefixes = suffix_automaton(words.tolist())
    ends: list[Ends | None] = [None] * len(length)
    for i, state in enumerate(prefixes):
        ends[state] = Ends(i)
    runs, spare = Runs(words, shape), shape.exponent - 1
    for state in np.argsort(-np.asarray(length), kind="stable").tolist():
        own, up = ends[state], link[state]
        ends[state] = None
        if up <= 0 or length[up] < shape.state:
            continue
        other = ends[up]
        if other is None:
            ends[up] = own
            continue
        large, small = (own, other) if own.size > other.size else (other, own)
        for x in small:
            before, after = large.add(x)
            # with a state of that length, the square's extension may reach the wanted exponent
            if before >= 0 and (x - before) * spare <= length[up]:
                runs.square(before, x - before)
            if after >= 0 and (after - x) * spare <= length[up]:
                runs.square(x, after - x)
        ends[up] = large
    return runs.found()


def _repeated(words: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Maximal [start, stop) ranges whose every window of words occurs at least twice among these words. Windows are
    told apart by a hash, so a range may be too long, never too short."""
    m = len(words) - window + 1
    if m < 2:
        return []
    h = np.zeros(m, np.uint64)
    for k in range(window):
        h = h * _BASE + words[k : k + m].astype(np.uint64) + np.uint64(1)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    twice = np.zeros(m, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edge = np.diff(np.concatenate([[0], twice.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) + window - 1).tolist(), strict=True))


def text_runs(words: np.ndarray, shape: Shape) -> list[tuple[int, int, int]]:
    """(start, length, period) of a text's runs, by start, then period. words: its words' numbers."""
    parts = [(0, len(words))]
    for _ in range(_FILTER_ROUNDS):
        parts = [(a + x, a + y) for a, b in parts for x, y in _repeated(words[a:b], shape.window) if y - x >= shape.least]
    return sorted((a + start, n, q) for a, b in parts for start, n, q in stretch_runs(words[a:b], shape))


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words of all texts, bounds of each text's): maximal runs without ASCII white space."""
    lists = pc.ascii_split_whitespace(texts)
    flat, offsets = lists.flatten(), np.asarray(lists.offsets).astype(np.int64)
    real = np.asarray(pc.binary_length(flat)) > 0
    before = np.concatenate([[0], np.cumsum(real)])
    return flat.filter(pa.array(real)), before[offsets - offsets[0]]


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", exponent: int = 4, least: int = 6) -> DataFrame:
    """(id, n_words, runs, collapsed) of every row: all runs of whole texts, by start, then period, and the text with
    each run's words after its first period left out, words joined by one space."""
    shape = Shape(exponent, least)
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches):
        for batch in batches:
            texts = as_arrow_string(batch.column(1))
            for i, j in slices(texts):
                words, bounds = _words(texts[i:j])
                codes = np.asarray(words.dictionary_encode().indices).astype(np.int32)
                keep, rows = np.ones(len(codes), bool), []
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    rows.append(text_runs(codes[a:b], shape))
                    for start, length, period in rows[-1]:
                        keep[a + start + period : a + start + length] = False
                kept = np.concatenate([[0], np.cumsum(keep)])[bounds]
                lists = pa.ListArray.from_arrays(pa.array(kept, pa.int32()), words.filter(pa.array(keep)))
                runs = pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in row] for row in rows], run_type)
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(np.diff(bounds)), runs, pc.binary_join(lists, pa.scalar(" ", words.type)).cast(pa.string())], ["id", "n_words", "runs", "collapsed"])

    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(tidy(run), f"id {kind}, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
    return found.withColumnRenamed("id", id_col)


def plant(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text): in one of ten documents, by the CRC-32 of the id, the words from a place on repeat those after it
    with a period, both given by the same number; other texts, and those of null ids, stay as they are."""
    h = F.crc32(F.col(id_col).cast("string"))
    g = F.floor(h / 10).cast("long")

    def repeat(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
        facts = F.array(F.struct(a.alias("a"), p.alias("p"), words.alias("w")))  # bound once a row
        taken = F.transform(facts, lambda f: F.transform(f["w"], lambda w, i: F.when(i < f["a"], w).otherwise(F.get(f["w"], (f["a"] + (i - f["a"]) % f["p"]).cast("int")))))
        return F.array_join(F.get(taken, F.lit(0)), " ")

    text = F.col(text_col).cast("string")
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    planted = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeat(w))), F.lit(0))
    return docs.select(id_col, F.when(h % 10 == 0, planted).otherwise(text).alias(text_col))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row a text: its number of runs, the longest (ties: smallest start, then period) and two digests."""
    best = F.get(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("s"), r["period"].alias("q")))), F.lit(0))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        id_col,
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.s").alias("start"),
        (-F.col("best.n")).alias("length"),
        F.col("best.q").alias("period"),
        F.floor(-1000 * F.col("best.n") / F.col("best.q")).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
