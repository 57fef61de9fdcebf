"""Job titles: role families, committee roles, role words, and titles of search results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from signal_engine.functions import text as tx

# Fixed values.
FAMILIES = {
    "gtm_engineering": ("gtm engineer", "gtm engineering"),
    "revenue_systems": ("revenue system", "revenue systems"),
    "revenue_operations": ("revenue operations", "revops"),
    "business_operations": ("business operations", "bizops"),
    "growth_engineering": ("growth engineer", "growth engineering"),
    "gtm_analytics": ("gtm analytics",),
    "marketing_operations": ("marketing operations", "marketing ops"),
}
COMMITTEE = {
    "technical_champion": ("gtm_engineering", "revenue_systems", "growth_engineering", "technical_champion", "technical_champions", "technical_gtm"),
    "operational_buyer": ("revenue_operations", "business_operations", "gtm_analytics", "marketing_operations", "operational_buyer", "operational_buyers"),
    "economic_buyer": ("economic_buyer", "economic_buyers"),
    "adjacent_validator": ("adjacent_validator", "adjacent_validators"),
}
GENERIC_ROLE_WORDS = ("engineer", "designer", "principal", "director", "head", "vp", "cto", "chief", "manager", "lead", "scientist", "researcher")


def _spaced(c: Column) -> Column:
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(tx.text(c)), r"[^a-z0-9]+", " ")), F.lit(" "))


def role_family(title: Column, catalogue: Mapping[str, Sequence[str]] | None = None) -> Column:
    """The first family of which the title holds a phrase as whole words: the fixed families, then the catalogue's in
    its order. Null for recruiters and for titles of no family."""
    said = _spaced(title)
    rules = [*FAMILIES.items(), *(catalogue or {}).items()]
    fits = [F.when(F.lit(False) if not phrases else F.exists(F.array(*[_spaced(F.lit(p)) for p in phrases]), lambda p: (F.trim(p) != "") & F.contains(said, p)), F.lit(name)) for name, phrases in rules]
    return F.when(~F.contains(said, F.lit(" recruiter ")) & ~F.contains(said, F.lit(" recruiting ")), F.coalesce(*fits))


def committee_role(family: Column, configured: Mapping[str, str] | None = None) -> Column:
    """What a role family does in a buying committee; configured roles first, technical_champion for other families."""
    roles = {f: role for role, families in COMMITTEE.items() for f in families} | dict(configured or {})
    known = F.create_map(*[F.lit(x) for kv in roles.items() for x in kv])
    return F.when(family.isNotNull(), F.coalesce(F.try_element_at(known, family), F.lit("technical_champion")))


def role_words(roles: Sequence[str]) -> list[str]:
    """The words of three letters or more of the roles asked for, with the generic ones, sorted."""
    return sorted({w for r in roles for w in r.lower().split() if len(w) >= 3} | set(GENERIC_ROLE_WORDS))


def relevant_profile(url: Column, title: Column, body: Column, company: Column, words: Sequence[str]) -> Column:
    """Whether a search result is a person's profile whose title holds a role word, and whose title or first 300
    characters hold the first eight characters of the company's name (up to a comma or bracket)."""
    low, start = F.lower(tx.text(title)), F.lower(F.substring(tx.text(body), 1, 300))
    name = F.substring(F.trim(F.regexp_extract(F.lower(tx.text(company)), r"^[^,(]*", 0)), 1, 8)
    of_role = F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w))
    return tx.text(url).contains("/in/") & of_role & (name != "") & (F.contains(low, name) | F.contains(start, name))


def title_parts(title: Column) -> Column:
    """(name, role) of a result title such as "Ada Byron | Analyst": two to five capitalised words before a bar or a
    dash; null where the title has no such form."""
    form = r"^\s*((?:\p{Lu}[\p{L}'’.-]+\s+){1,4}\p{Lu}[\p{L}'’.-]+)\s*[|–-]\s*(.*\S)\s*$"
    return F.when(tx.text(title).rlike(form), F.struct(F.regexp_extract(title, form, 1).alias("name"), F.regexp_extract(title, form, 2).alias("role")))
