"""Every query against its SQL twin on the smallest tables."""

from __future__ import annotations

import os
from collections import Counter

import duckdb
import pytest

from bidweave import domain_queries as queries
from bidweave import job_queries  # noqa: F401  adds its queries

SF = "/root/testdata/sf0.001"


def _plain(x):
    if x is None or x != x:
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, (int, float)):
        return round(float(x), 6)
    return str(x)


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_sql(spark, sql, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = Counter(tuple(_plain(r[c]) for c in columns) for r in df.collect())
    twin = sql.sql(queries.SQL[name])
    assert sorted(twin.columns) == columns
    at = [twin.columns.index(c) for c in columns]
    assert got == Counter(tuple(_plain(r[i]) for i in at) for r in twin.fetchall())


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
