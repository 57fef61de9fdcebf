"""Sources: typed and untyped CSV, preambles, JSON, logs and bounded SQL."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All-string CSV with multi-line cells and unbounded fields."""
    return spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False, maxCharsPerColumn=-1, emptyValue="", nullValue="\u0000")


def typed(kind: str, c: Column) -> Column:
    """Parse a cell: str verbatim; int, date, timestamp, decimal(p,s); bool by word; list from JSON or a|b."""
    blank = F.trim(c) == ""
    if kind == "str":
        return c
    if kind == "bool":
        low = F.lower(F.trim(c))
        return F.when(blank, None).when(low.isin("true", "1", "yes"), True).when(low.isin("false", "0", "no"), False).otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), c)).cast("boolean"))
    if kind == "list":
        return F.when(F.trim(c).startswith("["), F.from_json(c, "array<string>")).when(blank, F.array().cast("array<string>")).otherwise(F.split(c, r"\|"))
    sql = {"int": "bigint", "date": "date", "timestamp": "timestamp"}.get(kind, kind)
    return F.when(~blank, F.trim(c).cast(sql))


def read_records(spark: SparkSession, path: str, schema: Mapping[str, str], optional: Sequence[str] = ()) -> DataFrame:
    """Typed CSV with required columns; unknown columns go to source_metadata_json, sorted by name."""
    raw = read_csv(spark, path)
    if missing := [c for c in schema if c not in raw.columns and c not in optional]:
        raise ValueError(f"missing columns: {missing}")
    unknown = sorted(c for c in raw.columns if c not in schema)
    extra = F.to_json(F.struct(*[F.col(f"`{c}`") for c in unknown])) if unknown else F.lit("{}")
    return raw.select(*[(typed(k, F.col(f"`{c}`")) if c in raw.columns else F.lit(None).cast("string")).alias(c) for c, k in schema.items()], extra.alias("source_metadata_json"))


def read_after_preamble(spark: SparkSession, path: str, header: str, columns: Sequence[str]) -> DataFrame:
    """CSV whose header line starts with ``header`` after free lines: Spark reads it with the header's lines as
    records and drops what stands at or before it."""
    lines = spark.read.text(path).withColumn("at", F.monotonically_increasing_id())
    first = lines.where(F.col("value").startswith(header)).agg(F.min("at").alias("start"))
    body = lines.join(first, F.col("at") > F.col("start")).where(F.trim("value") != "")
    return body.select(F.from_csv("value", ", ".join(f"`{c}` string" for c in columns), {"escape": '"'}).alias("r")).select("r.*")


def connections(df: DataFrame, required: Sequence[str], date: str) -> DataFrame:
    """Rows with all required cells, and the date column parsed from "05 Mar 2024"."""
    for c in required:
        df = df.where(F.trim(F.coalesce(F.col(c), F.lit(""))) != "")
    return df.withColumn(date, F.try_to_date(F.trim(date), "d MMM yyyy"))


def read_config(text: str) -> dict:
    """JSON with exact decimals."""
    return json.loads(text, parse_float=Decimal)


def marked_columns(columns: Sequence[str], marker: str) -> list[int]:
    """Places of the columns whose header holds the marker."""
    return [i for i, c in enumerate(columns) if marker in c]


def read_aliased(spark: SparkSession, path: str, rename: Mapping[str, str], required: Sequence[str]) -> DataFrame:
    """CSV with headers renamed to fields; required fields must be there."""
    df = read_csv(spark, path).withColumnsRenamed(dict(rename))
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"missing fields: {missing}")
    return df


def read_har(spark: SparkSession, path: str) -> DataFrame:
    """One row per logged request: method, path, status, mime type."""
    raw = spark.read.json(path, multiLine=True)
    e = raw.select(F.explode("log.entries").alias("e"))
    return e.select(F.col("e.request.method").alias("method"), F.regexp_extract("e.request.url", r"^[a-z]+://[^/]+([^?#]*)", 1).alias("path"), F.col("e.response.status").alias("status"))


def route_inventory(requests: DataFrame) -> DataFrame:
    """Methods, statuses and count per path template."""
    from signal_engine.functions.text import path_template

    return requests.groupBy(path_template(F.col("path")).alias("template")).agg(F.array_sort(F.collect_set("method")).alias("methods"), F.array_sort(F.collect_set("status")).alias("statuses"), F.count("*").alias("calls"))


def bounded_sql(spark: SparkSession, query: str, max_rows: int) -> tuple[DataFrame, bool]:
    """(rows, truncated): at most max_rows rows of a query."""
    some = spark.sql(query).limit(max_rows + 1)
    return some.limit(max_rows), some.count() > max_rows


def certificate_names(rows: DataFrame, column: str, suffix: str, excluded: str = r"(?:sandbox|staging|dev|test|demo)") -> DataFrame:
    """Tenant slugs of certificate names under a suffix, once each, without test tenants."""
    name = F.explode(F.split(F.lower(column), r"\n")).alias("name")
    slug = F.regexp_extract(F.col("name"), r"^(?:\*\.)?([a-z0-9-]+)\." + suffix.replace(".", r"\.") + "$", 1)
    return rows.select(name).select(slug.alias("slug")).where((F.col("slug") != "") & ~F.col("slug").rlike(excluded)).dropDuplicates(["slug"])


def work_queue(df: DataFrame, done: str, order: str, n: int) -> DataFrame:
    return df.where(F.col(done).isNull()).orderBy(F.col(order).desc_nulls_last()).limit(n)
