"""URL filtering by rules, and beyond them by a path-template tree for each host.

Every url becomes a host and a path. Rules (host, path prefix, verdict) come first; the urls that a rule judged are
the labelled rows of the method. Per host, paths form a tree of segments; segments that look variable (numbers,
identifiers, dates, long slugs) are wildcards from the start. From the root down, a node's branches are grouped by
what follows them most (a variable segment, the end, or a certain name), and those of a group are merged into one
wildcard if they are statistically like the others of it: what follows them is distributed alike (a chi-square test
over the shapes of the next segment, the end being one) and, where both sides have labelled urls, their block rates do
not differ significantly. A merged branch has the urls and the labels of all its parts, so labels reach branches
that no rule judges. A template is rejected when it has labels and their purity, smoothed by the rate of its parent
node, (blocked + 2 a r) / (labelled + 2 a) with r = (parent's blocked + a) / (parent's labelled + 2 a), reaches a
threshold. Hosts without a judged url keep the verdict allow: no label speaks for them.

Only counts per shape are shuffled. The tree takes a round of joins for each level at which a host has two different
segments; levels of plain chains cost nothing.

Defined results: a null url or one without ``://`` has empty host and path, no rule and the verdict allow; equal urls
get equal rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signal_engine.llm.common import Scratch

Z_SIMILAR = 1.96
END = "/"  # what follows a path's last segment; no segment holds a slash
PRIOR = 1.0
REJECT_AT = 0.8


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or the end, A-Z lower-cased; path: from there up to ?, # or the end."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    known = at > 0
    host = F.when(known, lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0))).otherwise("")
    path = F.when(known, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")
    return host, path


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null. Meant for up to some hundred rules."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r), reverse=False):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def segment_shape(s: Column) -> Column:
    """A path segment with what looks variable in it as a wildcard."""
    name, suffix = F.regexp_extract(s, r"^(.*?)(\.[A-Za-z]{2,5})?$", 1), F.regexp_extract(s, r"^(.*?)(\.[A-Za-z]{2,5})?$", 2)
    variable = name.rlike(r"^[0-9]") | name.rlike(r"[0-9].*[0-9]") | name.rlike(r"^[0-9a-fA-F-]{8,}$") | (F.length(name) > 24) | name.rlike(r"[-_+%].*[-_+%]")
    return F.when(variable, F.concat(F.lit("*"), suffix)).otherwise(s)


def shape_of(path: Column) -> Column:
    """The path's segments with wildcards."""
    return F.transform(F.split(F.regexp_replace(path, r"^/", ""), "/"), segment_shape)


def _merged(rows: DataFrame) -> DataFrame:
    """(host, parent, child, wild) of the branches of a level that become the wildcard ``wild``. rows: (host, parent,
    child, next, n, k, b)."""
    kind = F.when(F.col("next").startswith("*"), "*").otherwise(F.col("next"))
    mostly = rows.groupBy("host", "parent", "child", kind.alias("kind")).agg(F.sum("n").alias("n")).groupBy("host", "parent", "child").agg(F.min(F.struct((-F.col("n")).alias("n"), "kind")).alias("m")).select("host", "parent", "child", F.col("m.kind").alias("kind"))
    rows = rows.join(mostly, ["host", "parent", "child"])
    group = ["host", "parent", "kind"]
    node = rows.groupBy(group).agg(F.sum("n").alias("pn"), F.sum("k").alias("pk"), F.sum("b").alias("pb"), F.count_distinct("next").alias("kinds"), F.count_distinct("child").alias("children")).where("children > 1")
    after = rows.groupBy(*group, "next").agg(F.sum("n").alias("nn"))
    cells = rows.groupBy(*group, "child", "next").agg(F.sum("n").alias("o"), F.sum("k").alias("k"), F.sum("b").alias("b"))
    cells = cells.withColumn("cn", F.sum("o").over(Window.partitionBy(*group, "child"))).join(after, [*group, "next"]).join(node, group)
    # chi-square of a branch against its siblings: all shapes as if absent, corrected for those it has
    rest = F.col("pn") - F.col("cn")
    expected = F.col("cn") * F.col("nn") / F.col("pn")
    seen = (F.col("o") * F.col("o") - 2 * F.col("o") * expected) * F.col("pn") * F.col("pn") / (F.col("nn") * F.col("cn") * rest)
    branch = cells.groupBy(*group, "child", "cn", "pn", "pk", "pb", "kinds").agg(F.sum("k").alias("ck"), F.sum("b").alias("cb"), F.sum(seen).alias("seen"))
    free = F.col("kinds") - 1
    alike = F.col("cn") * F.col("pn") / rest + F.col("seen") <= free + Z_SIMILAR * F.sqrt(2.0 * free) + 1e-9
    rest_k, rest_b, rate = F.col("pk") - F.col("ck"), F.col("pb") - F.col("cb"), F.try_divide("pb", "pk")
    spread = F.sqrt(rate * (1 - rate) * (F.try_divide(F.lit(1), F.col("ck")) + F.try_divide(F.lit(1), rest_k)))
    apart = F.abs(F.try_divide("cb", "ck") - F.try_divide(rest_b, rest_k))
    agree = F.when((F.col("ck") > 0) & (rest_k > 0), apart <= Z_SIMILAR * spread + 1e-9).otherwise(True)
    similar = branch.where(alike & agree).select(*group, "child").withColumn("m", F.count("*").over(Window.partitionBy(*group)))
    return similar.where("m > 1").select("host", "parent", "child", F.when(F.col("kind") == "*", "*").otherwise(F.concat(F.lit("*>"), "kind")).alias("wild"))


def templates(labelled: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, shape, template, labelled, blocked, purity) from rows (host, shape, verdict or null)."""
    tree = scratch.write(
        labelled.groupBy("host", "shape").agg(F.count("*").alias("n"), F.count("verdict").alias("k"), F.count_if(F.col("verdict") == "block").alias("b")).withColumn("template", F.col("shape")),
        "shapes",
    )
    here = F.col("template")
    # levels at which a host has two segments; a path's end is no segment, and no branch
    by_level = tree.select("host", F.posexplode("shape").alias("level", "s")).groupBy("host", "level").agg((F.min("s") != F.max("s")).alias("open")).where("open")
    for r in by_level.select("level").distinct().orderBy("level").toLocalIterator():  # one row a level
        level = r["level"] + 1
        keyed = tree.withColumn("parent", F.array_join(F.slice(here, 1, level - 1), "/")).withColumn("child", F.get(here, F.lit(level - 1))).withColumn("next", F.coalesce(F.get(here, F.lit(level)), F.lit(END)))
        wild = _merged(keyed.where("child IS NOT NULL"))
        new = F.when(F.col("wild").isNotNull(), F.transform(here, lambda s, i: F.when(i == level - 1, F.col("wild")).otherwise(s))).otherwise(here)
        tree = scratch.write(keyed.join(wild, ["host", "parent", "child"], "left").select("host", "shape", "n", "k", "b", new.alias("template")), f"level-{level}")
    stats = tree.groupBy("host", "template").agg(F.sum("k").alias("labelled"), F.sum("b").alias("blocked"))
    above = F.slice(here, 1, F.greatest(F.size(here) - 1, F.lit(0)))
    prefixes = F.transform(F.sequence(F.lit(0), F.size(here)), lambda i: F.xxhash64(F.slice(here, 1, i)))
    parents = tree.where("k > 0").select("host", "k", "b", F.explode(prefixes).alias("above")).groupBy("host", "above").agg(F.sum("k").alias("pk"), F.sum("b").alias("pb"))
    rows = tree.select("host", "shape", "template", F.xxhash64(above).alias("above")).join(stats, ["host", "template"]).join(parents, ["host", "above"], "left")
    r = (F.coalesce("pb", F.lit(0)) + PRIOR) / (F.coalesce("pk", F.lit(0)) + 2 * PRIOR)
    return rows.select("host", "shape", "template", "labelled", "blocked", ((F.col("blocked") + 2 * PRIOR * r) / (F.col("labelled") + 2 * PRIOR)).alias("purity"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]], scratch: Scratch, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, template, purity) for every url."""
    host, path = host_and_path(F.col(url_col).cast("string"))
    rows = pages.select(F.col(id_col).alias("k"), host.alias("host"), path.alias("path")).withColumn("found", rule_for(F.col("host"), F.col("path"), rules)).withColumn("shape", shape_of(F.col("path")))
    known = templates(rows.select("host", "shape", F.col("found.verdict").alias("verdict")), scratch)
    verdict = F.coalesce(F.col("found.verdict"), F.when((F.col("labelled") > 0) & (F.col("purity") >= REJECT_AT - 1e-9) & (F.col("host") != ""), F.lit("block")).otherwise("allow"))
    return rows.join(known, ["host", "shape"], "left").select(
        F.col("k").alias(id_col), "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), F.array_join("template", "/").alias("template"), "purity"
    )
