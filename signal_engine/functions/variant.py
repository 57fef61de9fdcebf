"""Nested JSON cells: path access, envelopes, and tolerant score lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse(c: Column) -> Column:
    return F.try_parse_json(c)


def path(v: Column, *paths: str, kind: str = "string") -> Column:
    """The first path that is present and not null."""
    return F.coalesce(*[F.try_variant_get(v, p, kind) for p in paths])


def present(v: Column, p: str) -> Column:
    """Whether a path exists, also with a JSON null."""
    return F.try_variant_get(v, p, "variant").isNotNull()


def first_nonempty_list(c: Column, paths: Sequence[str]) -> Column:
    """The first non-empty JSON array of strings among the paths of a JSON text."""
    lists = [F.from_json(F.get_json_object(c, p), "array<string>") for p in paths]
    return F.coalesce(*[F.when(F.size(x) > 0, x) for x in lists])


def explode_persons(df: DataFrame, column: str, paths: Sequence[str] = ("$.persons", "$.data.persons", "$.results")) -> DataFrame:
    """One row per nested person, whatever the envelope; rows without persons go."""
    return df.withColumn("person", F.explode(first_nonempty_list(F.col(column), paths))).withColumn("person", F.try_parse_json("person"))


def model_scores(c: Column) -> Column:
    """id -> score from {"scores": {...}}, {"id": score} or [{"id":, "score":}]."""
    as_list = F.coalesce(F.from_json(c, "array<struct<id:string,score:double>>"), F.from_json(F.get_json_object(c, "$.scores"), "array<struct<id:string,score:double>>"))
    from_list = F.map_from_arrays(F.array_distinct(F.transform(as_list, lambda x: x["id"])), F.transform(F.array_distinct(F.transform(as_list, lambda x: x["id"])), lambda i: F.array_max(F.transform(F.filter(as_list, lambda y: y["id"] == i), lambda y: y["score"]))))
    nested, flat = F.from_json(F.get_json_object(c, "$.scores"), "map<string,double>"), F.from_json(c, "map<string,double>")
    return F.when(F.trim(c).startswith("["), from_list).when(F.get_json_object(c, "$.scores").isNotNull(), nested).otherwise(flat)
