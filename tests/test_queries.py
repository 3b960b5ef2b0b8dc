"""Each registered query against DuckDB on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from skein.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    if isinstance(value, bool):
        return str(value)
    if hasattr(value, "quantize") or isinstance(value, (int, float)):
        return f"{float(value) + 0.0:.9g}"
    return str(value)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_matches_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    want = duck.sql(registry.ORACLE[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    expected = sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall()) if hasattr(want, "fetchall") else []
    assert sorted(tuple(plain(r[c]) for c in columns) for r in got.collect()) == expected


@pytest.mark.parametrize("name", sorted(registry.QUERIES.keys() - registry.ORACLE.keys()))
def test_other_queries_give_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0
