"""Evidence on raw text: corroborated figures, bound excerpts, people in prose."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signal_engine.operators.ordered import fold_in_order

def corroborate(figures: DataFrame, band: float = 0.02) -> DataFrame:
    """Clusters of figures (topic, ordinal, unit, value, domain): in order, a figure joins the first cluster of its
    unit whose first value lies within the band; sources are distinct domains. A topic's figures stream through one
    task that holds its clusters' first values only."""

    def place(found: list, row: dict) -> tuple[list, int]:
        for at, (unit, value) in enumerate(found):
            if unit == row["unit"] and abs(row["value"] - value) <= band * abs(value):
                return found, at
        found.append((row["unit"], row["value"]))
        return found, len(found) - 1

    rows = figures.where("value IS NOT NULL").select("topic", "ordinal", "unit", "value", "domain")
    placed = fold_in_order(rows, "topic", ["ordinal", "unit", "value"], list, place, "cluster", "bigint", rows.columns)
    named = F.when(F.col("domain") != "", F.col("domain"))
    return placed.groupBy("topic", "cluster", "unit").agg(F.min_by("value", F.struct("ordinal", "value")).alias("value"), F.count("*").alias("figures"), F.count_distinct(named).alias("sources")).drop("cluster")


def independent_sources(facts: DataFrame, key: str, domain: str) -> DataFrame:
    return facts.groupBy(key).agg(F.count_distinct(domain).alias("sources"))


def excerpt_bound(excerpt: Column, source: Column, most: int = 800) -> Column:
    """exact, whitespace or format where the excerpt stands in the source at word bounds, else null."""

    @F.pandas_udf("string")
    def bind(e: pd.Series, s: pd.Series) -> pd.Series:
        def one(x: str | None, body: str | None) -> str | None:
            if not x or not body or not x.strip() or len(x) > most:
                return None
            if re.search(rf"(?<!\w){re.escape(x)}(?!\w)", body):
                return "exact"
            if re.search(r"(?<!\w)" + r"\s+".join(map(re.escape, x.split())) + r"(?!\w)", body):
                return "whitespace"
            plain = lambda t: " ".join(re.findall(r"\w+", t.lower()))
            return "format" if plain(x) and f" {plain(x)} " in f" {plain(body)} " else None

        return pd.Series([one(x, b) for x, b in zip(e, s, strict=True)], dtype="object")

    return bind(excerpt, source)


def colocated(source: Column, atoms: Column, most: int = 1200) -> Column:
    """Whether all atoms of an array occur within ``most`` characters of the source."""

    @F.pandas_udf("boolean")
    def near(s: pd.Series, a: pd.Series) -> pd.Series:
        def one(body, parts) -> bool:
            if body is None or parts is None or not len(parts):
                return False
            low = body.lower()
            hits = sorted((m.start(), m.end(), k) for k, p in enumerate(parts) for m in re.finditer(re.escape(p.lower()), low) if p)
            have: dict[int, int] = {}
            for start, end, k in hits:
                have[k] = start
                if len(have) == len(parts) and end - min(have.values()) <= most:
                    return True
            return False

        return pd.Series([one(b, p) for b, p in zip(s, a, strict=True)], dtype="bool")

    return near(source, atoms)


def people_in_prose(body: Column) -> Column:
    """array(struct(name, role)) of "Name, Role" and "Name is the Role" mentions."""
    person = r"([\p{Lu}][\p{L}'-]+(?: [\p{Lu}][\p{L}'-]+){1,2})"
    role = r"((?:chief|vice president|vp|head|director|founder|co-founder|ceo|cto|cfo)[\p{L} ]{0,40})"
    pattern = rf"{person}(?:,| is the| is) (?i:{role})"
    names, roles = F.regexp_extract_all(body, F.lit(pattern), 1), F.regexp_extract_all(body, F.lit(pattern), 2)
    return F.zip_with(names, roles, lambda n, r: F.struct(n.alias("name"), F.lower(F.trim(r)).alias("role")))


def collect_keys(c: Column, pattern: str) -> Column:
    """Values of all keys that match, at any depth of a JSON text, in document order."""

    @F.pandas_udf("array<string>")
    def walk(col: pd.Series) -> pd.Series:
        import json

        def one(raw) -> list[str]:
            try:
                todo, out = [json.loads(raw)], []
            except (TypeError, ValueError):
                return []
            while todo:
                x = todo.pop(0)
                if isinstance(x, dict):
                    out += [str(v) for k, v in x.items() if re.search(pattern, k) and not isinstance(v, (dict, list)) and v is not None]
                    todo[:0] = [v for v in x.values() if isinstance(v, (dict, list))]
                elif isinstance(x, list):
                    todo[:0] = [v for v in x if isinstance(v, (dict, list))]
            return out

        return col.map(one)

    return walk(c)


def evidence_id(c: Column) -> Column:
    """ev_ and the 32-bit FNV-1a hash of a text's UTF-16 code units, as hex."""

    @F.pandas_udf("string")
    def fnv(col: pd.Series) -> pd.Series:
        def one(s) -> str | None:
            if s is None:
                return None
            h, raw = 0x811C9DC5, s.encode("utf-16-le")
            for i in range(0, len(raw), 2):
                h = ((h ^ int.from_bytes(raw[i : i + 2], "little")) * 0x01000193) & 0xFFFFFFFF
            return f"ev_{h:08x}"

        return col.map(one)

    return fnv(c)


def ascii_fold(c: Column) -> Column:
    """NFKD without marks, ASCII only."""

    @F.pandas_udf("string")
    def fold(col: pd.Series) -> pd.Series:
        return col.str.normalize("NFKD").str.encode("ascii", "ignore").str.decode("ascii")

    return fold(c)


def stable_id(prefix: str, *parts: Column, length: int = 16) -> Column:
    """prefix and the head of the SHA-256 of the compact JSON list of the parts."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.to_json(F.array(*[p.cast("string") for p in parts])), 256), 1, length))
