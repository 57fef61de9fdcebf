"""Every registered query with SQL against DuckDB on the smallest tables."""

import datetime
import decimal
from collections import Counter

import duckdb
import numpy as np
import pytest

from signal_engine import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, (float, np.floating, decimal.Decimal)):
        return round(float(v), 6)
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(v)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    columns = sorted(df.columns)
    result = duck.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    expected = Counter(tuple(map(repr, (plain(r[i]) for i in at))) for r in result.fetchall())
    got = Counter(tuple(map(repr, (plain(r[c]) for c in columns))) for r in df.collect())
    assert got == expected


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_rows_only_query_runs(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0
