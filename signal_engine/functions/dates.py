"""Dates: multi-format parsing, ages, freshness and recency, always against a given as_of."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FORMATS = ("yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "d MMM yyyy", "MMMM d, yyyy")
BUCKETS = ("0-30", "31-90", "91-365", ">365", "future", "unknown")


def parse_date(c: Column) -> Column:
    """The first format that fits; an ISO timestamp counts by its date."""
    s = F.trim(c.cast("string"))
    iso = F.regexp_extract(s, r"^(\d{4}-\d{2}-\d{2})", 1)
    return F.coalesce(F.when(iso != "", F.try_to_date(iso, "yyyy-MM-dd")), *[F.try_to_date(s, f) for f in FORMATS[1:]])


def start_key(c: Column) -> Column:
    """Sortable yyyymm of yyyy, yyyy-mm, mm-yyyy or a date; 0 if none."""
    s = F.coalesce(c.cast("string"), F.lit(""))
    year_first = F.regexp_extract(s, r"^(\d{4})(?:-(\d{1,2}))?", 1)
    month = F.regexp_extract(s, r"^\d{4}-(\d{1,2})", 1)
    last = F.regexp_extract(s, r"^(\d{1,2})-(\d{4})$", 2)
    first = F.regexp_extract(s, r"^(\d{1,2})-(\d{4})$", 1)
    number = lambda x: F.coalesce(F.expr("1") * 0 + F.when(x != "", x).cast("int"), F.lit(0))
    return F.when(last != "", number(last) * 100 + number(first)).when(year_first != "", number(year_first) * 100 + number(month)).otherwise(0)


def has_offset(c: Column) -> Column:
    """Whether an ISO timestamp names its zone; naive ones must be rejected, not assumed."""
    return F.coalesce(c.cast("string"), F.lit("")).rlike(r"(?:Z|[+-]\d{2}:?\d{2})$")


def days_old(c: Column, as_of: Column) -> Column:
    return F.datediff(as_of, c)


def freshness_bucket(c: Column, as_of: Column) -> Column:
    age = days_old(c, as_of)
    return F.when(age.isNull(), "unknown").when(age < 0, "future").when(age <= 30, "0-30").when(age <= 90, "31-90").when(age <= 365, "91-365").otherwise(">365")


def freshness(published: Column, as_of: Column, mode: str = "balanced_recent", window_days: int = 30) -> Column:
    """0..1 by age in days (fractions count); a missing date has the mode's floor."""
    floor = {"strict_recent": 0.0, "balanced_recent": 0.1, "evergreen_ok": 0.4}[mode]
    age = F.greatest(F.lit(0.0), (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(published.cast("timestamp"))) / 86_400_000_000)
    strict = F.greatest(F.lit(0.0), 1 - age / max(1, window_days))
    scaled = {"strict_recent": strict, "balanced_recent": strict * 0.8 + 0.1, "evergreen_ok": strict * 0.6 + 0.4}[mode]
    return F.when(published.isNull(), F.lit(floor)).otherwise(scaled)


def recency_boost(c: Column, as_of: Column) -> Column:
    """1 up to 30 days, then linear down to 0.5 at three years; 0.5 if unknown."""
    age = days_old(c, as_of)
    return F.when(age.isNull() | (age >= 1095), 0.5).when(age <= 30, 1.0).otherwise(1.0 - 0.5 * (age - 30) / (1095 - 30))


def source_date(c: Column) -> Column:
    """The one distinct ISO date in a text; null for none or several."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\b(\d{4}-\d{2}-\d{2})\b"), 1), lambda s: F.try_to_date(s, "yyyy-MM-dd")))
    valid = F.array_compact(found)
    return F.when(F.size(valid) == 1, F.element_at(valid, 1))
