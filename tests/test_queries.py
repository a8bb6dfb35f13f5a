"""Every registered query with SQL against DuckDB on the smallest tables, and the entry points."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb
import pytest

import __spark_entry__ as entry
from assurance.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, int) or (isinstance(v, decimal.Decimal) and v == v.to_integral_value()):
        return str(int(v))
    if isinstance(v, (float, decimal.Decimal)):
        return str(int(v)) if float(v).is_integer() and abs(v) < 1e9 else f"{float(v):.9g}"
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    mine = [tuple(map(plain, r)) for r in df.select(*columns).collect()]
    result = duck.execute(registry.oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    theirs = [tuple(plain(r[i]) for i in order) for r in result.fetchall()]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(mine, key=key) == sorted(theirs, key=key)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    registry.queries()[name](spark, SF).write.format("noop").mode("overwrite").save()


def test_entry_points(spark):
    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())
