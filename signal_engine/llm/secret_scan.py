"""Secret scans judged by corpus-wide ownership frequency.

A pass over the texts finds candidates: assignments to a password-like name, access keys, long hex runs (the base
kinds), tokens of known providers, and other long strings that mix letters and digits with the entropy of a random
one. Only the candidates' places and the hash of their secret value go on. For each hash the distinct repositories
and owners are counted over the whole corpus: a value that many of them hold is an example that was copied
around; one that few of them hold is theirs, and live-looking if its characters are those of a random string. Base
candidates are always reported, with that verdict; the other kinds only where they are live and lie outside the base
spans.

Counting is two-stepped: rows are first reduced to distinct (hash, repository) and (hash, owner) pairs, which are
spread over all tasks, then counted with partial sums, so a value that a third of the corpus holds is no hot key. To
bring the verdicts back, hashes with more than a thousandth of all candidates (hence fewer than a thousand hashes)
are broadcast; the others meet by hash.

Defined results: a null text is empty; an empty text, or one without candidates, gives a row without findings; each
row of a repeated id gives its own row; findings are ordered by start, then kind as listed; a null repository or owner
counts as one of its own kind; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signal_engine.llm.common import Scratch, as_arrow_string, slices, tidy

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "provider", "random")
HOT_SHARE = 1000
# The base kinds as given. Letters of the names count in either case, ASCII only.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_LEAST = 8
# Published token formats of providers.
PROVIDER = re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}|glpat-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|[rs]k_live_[A-Za-z0-9]{16,}|eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
RANDOM = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_NAMES = ("pass", "secret", "token", "key", "api")


def entropy(value: str) -> float:
    """Bits a character, by the value's own frequencies."""
    return -sum(c / len(value) * math.log2(c / len(value)) for c in Counter(value).values())


def looks_random(value: str) -> bool:
    """Letters and digits mixed, and close to the entropy that a random hex string of the length has."""
    digits = sum(c.isdigit() for c in value)
    return 0 < digits < len(value) and entropy(value) >= min(3.0, 0.75 * math.log2(len(value)))


def candidates(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, secret value) in a whole text: base kinds leftmost and without overlap within a kind (a
    match that fails its length is dropped after it has been taken), others outside the base spans."""
    found = []
    low = text.lower()
    if any(name in low for name in _NAMES):
        found += [("assign", m.start(), m.end(), m.group(2)) for m in ASSIGN.finditer(text) if len(m.group(2)) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), m.group()) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end(), m.group()) for m in HEX.finditer(text)]
    taken = sorted((s, e) for _, s, e, _ in found)
    for kind, pattern in (("provider", PROVIDER), ("random", RANDOM)):
        new = [(kind, m.start(), m.end(), m.group()) for m in pattern.finditer(text) if kind == "provider" or looks_random(m.group())]
        new = _outside(new, taken)
        found += new
        taken = sorted(taken + [(s, e) for _, s, e, _ in new])
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def _outside(new: list, taken: list[tuple[int, int]]) -> list:
    """Those of ``new`` (by start, without overlap) that overlap none of ``taken`` (by start)."""
    kept, i, reach = [], 0, -1
    for x in new:
        while i < len(taken) and taken[i][0] < x[2]:
            reach = max(reach, taken[i][1])
            i += 1
        if reach <= x[1]:
            kept.append(x)
    return kept


def _search(batches):
    fields = [("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("hash", pa.binary()), ("random", pa.bool_())]
    kind = pa.list_(pa.struct(fields))
    for batch in batches:
        texts = as_arrow_string(batch.column(3))
        for i, j in slices(texts):
            rows = [[{"kind": k, "start": s, "stop": e, "hash": hashlib.sha256(v.encode()).digest(), "random": looks_random(v)} for k, s, e, v in candidates(t)] for t in texts[i:j].to_pylist()]
            yield pa.RecordBatch.from_arrays([*(c[i:j] for c in batch.columns[:3]), pa.array(rows, kind)], ["id", "repository", "owner", "found"])


def ownership(candidates: DataFrame) -> DataFrame:
    """(hash, n, repositories, owners) of (hash, repository, owner) rows: a null counts as one value."""
    parts = []
    for name in ("repository", "owner"):
        pairs = candidates.groupBy("hash", name).agg(F.count("*").alias("n"))
        parts.append(pairs.groupBy("hash").agg(F.sum("n").alias("n"), F.count("*").alias("m")).select("hash", F.when(F.lit(name == "repository"), F.col("n")).alias("n"), F.lit(name).alias("what"), "m"))
    both = parts[0].unionByName(parts[1])
    count = lambda name: F.sum(F.when(F.col("what") == name, F.col("m")))
    return both.groupBy("hash").agg(F.sum("n").alias("n"), count("repository").alias("repositories"), count("owner").alias("owners"))


def find_secrets(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", repository: Column | None = None, owner: Column | None = None, max_repositories: int = 10, max_owners: int = 2) -> DataFrame:
    """(id, findings) of every row: each finding with kind, start, stop (code points, end exclusive), the sha256 of
    its value, the distinct repositories and owners that hold the value, and the verdict ``live`` (at most
    ``max_repositories`` and ``max_owners`` hold it and it looks random), ``example`` (more hold it) or ``plain``."""
    repository = F.col(id_col) if repository is None else repository
    owner = F.col("source") if owner is None else owner
    read = docs.select(F.col(id_col).alias("id"), repository.cast("string").alias("repository"), owner.cast("string").alias("owner"), F.col(text_col).cast("string").alias("t"))
    kind = read.schema["id"].dataType.simpleString()
    item = "array<struct<kind:string,start:bigint,stop:bigint,hash:binary,random:boolean>>"
    searched = read.mapInArrow(tidy(_search), f"id {kind}, repository string, owner string, found {item}")
    rows = scratch.write(searched.withColumn("row", F.monotonically_increasing_id()), "rows")
    single = rows.where(F.size("found") > 0).select("row", "id", "repository", "owner", F.explode("found").alias("c")).select("row", "id", "repository", "owner", "c.*")
    facts = scratch.write(ownership(single.select("hash", "repository", "owner")), "ownership")
    total = facts.agg(F.sum("n")).first()[0] or 0
    hot = facts.where(F.col("n") * HOT_SHARE > total)  # fewer than HOT_SHARE rows
    columns = ["row", "id", "kind", "start", "stop", "hash", "random", "repositories", "owners"]
    rare = single.join(F.broadcast(hot.select("hash")), "hash", "left_anti").join(facts, "hash")
    often = single.join(F.broadcast(hot), "hash")
    judged = rare.select(columns).unionByName(often.select(columns))
    few = (F.col("repositories") <= max_repositories) & (F.col("owners") <= max_owners)
    judged = judged.withColumn("verdict", F.when(~few, "example").when(F.col("random"), "live").otherwise("plain"))
    shown = judged.where(F.col("kind").isin(*BASE_KINDS) | (F.col("verdict") == "live"))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    entry = F.struct("start", rank.alias("rank"), "stop", "kind", F.lower(F.hex("hash")).alias("value_sha256"), "repositories", "owners", "verdict")
    with_some = shown.groupBy("row").agg(F.first("id").alias("id"), F.sort_array(F.collect_list(entry)).alias("findings"))
    empty = F.filter(F.array(F.struct(*(F.lit(None).cast(t).alias(n) for n, t in _FINDING))), lambda _: F.lit(False))
    none = rows.where(F.size("found") == 0).select("id", empty.alias("findings"))
    # a row whose candidates are all dropped still gives a row
    dropped = rows.where((F.size("found") > 0) & ~F.exists("found", lambda c: c["kind"].isin(*BASE_KINDS))).join(with_some.select("row"), "row", "left_anti").select("id", empty.alias("findings"))
    return with_some.select("id", "findings").unionByName(none).unionByName(dropped).withColumnRenamed("id", id_col)


_FINDING = (("start", "bigint"), ("rank", "int"), ("stop", "bigint"), ("kind", "string"), ("value_sha256", "string"), ("repositories", "bigint"), ("owners", "bigint"), ("verdict", "string"))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and spans of find_secrets' rows."""

    def spans(findings: Column) -> Column:
        return F.array_join(F.transform(findings, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")

    def number(field: str, value: str) -> Column:
        return F.size(F.filter("findings", lambda x: x[field] == value)).cast("long")

    return found.select(
        id_col,
        *(number("kind", k).alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(spans(F.filter("findings", lambda x: x["kind"].isin(*BASE_KINDS))), 256).alias("base_sha256"),
        spans(F.col("findings")).alias("spans"),
        *(number("verdict", v).alias(f"n_{v}") for v in ("live", "example")),
    )
