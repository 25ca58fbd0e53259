"""Driver queries against their SQL on the smallest tables."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")

from labelframe.plans import bindings  # noqa: E402

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, float)):
        return None if math.isnan(value) else round(float(value), 6) + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


def compared(spark, query, sql):
    con = duckdb.connect()
    con.sql("SET timezone='UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, want = query(spark, SF), con.sql(sql)
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    key = lambda row: tuple((v is None, str(v)) for v in row)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=key)
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=key)


@pytest.mark.parametrize("name", sorted(bindings.ORACLES))
def test_query_equals_sql(spark, name):
    compared(spark, bindings.QUERIES[name], bindings.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(bindings.QUERIES) - set(bindings.ORACLES) - {"character_boxes"}))
def test_query_gives_rows(spark, name):
    assert bindings.QUERIES[name](spark, SF).limit(1).count() == 1


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries) and set(bindings.QUERIES) <= set(queries)
