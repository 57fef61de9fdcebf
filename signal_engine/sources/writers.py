"""Sinks: byte-stable review files, digests, upserts into Parquet tables and exports."""

from __future__ import annotations

import csv
import hashlib
import io
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signal_engine.operators import sets


def cell(v) -> str:
    """One CSV cell: true/false, ISO dates, JSON lists, '' for null."""
    if v is None:
        return ""
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (list, tuple)):
        return json.dumps(list(v), ensure_ascii=False, separators=(",", ":"))
    return v.isoformat() if hasattr(v, "isoformat") else str(v)


def stable_csv(df: DataFrame, columns: Sequence[str], order: Sequence[str]) -> str:
    """Review artefact: rows in a total order, declared columns only, \\n line ends. Rows stream to the driver one
    partition at a time; for data, write Parquet."""
    if extra := [c for c in df.columns if c not in columns]:
        raise ValueError(f"undeclared columns: {extra}")
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    w.writerow(columns)
    for r in df.select(*columns).orderBy(*order).toLocalIterator():
        w.writerow([cell(x) for x in r])
    return out.getvalue()


def stable_json(value) -> str:
    return json.dumps(value, sort_keys=True, indent=2, ensure_ascii=False) + "\n"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def table_digest(df: DataFrame) -> DataFrame:
    """An order-free digest of a table's rows: their count and the sum of row hashes."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256)
    return df.select(F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(38,0)").alias("h")).agg(F.count("*").alias("rows"), F.sum("h").alias("digest"))


def write_upsert(df: DataFrame, path: str, staged: str, key: str) -> None:
    """Upsert into a Parquet table: the merged rows are written beside the old ones, then the caller swaps."""
    spark = df.sparkSession
    sets.upsert(spark.read.parquet(path), df, key).write.mode("overwrite").parquet(staged)


def write_net_new(df: DataFrame, path: str, key: Sequence[str], order: Sequence[str]) -> None:
    """Append only rows whose key the table lacks."""
    seen = df.sparkSession.read.schema(df.schema).parquet(path)
    sets.net_new(df, seen, list(key), *order).write.mode("append").parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
