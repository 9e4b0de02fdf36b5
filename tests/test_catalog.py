"""Every query with SQL against that SQL, on the smallest tables; the rest has to run."""

import datetime
import decimal
import glob
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as driver

NAMES = sorted(driver.oracle_sql())
PLAIN = sorted(set(driver.queries()) - set(NAMES))


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return round(v, 5) + 0.0
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    c.execute("set TimeZone = 'UTC'")
    for p in glob.glob(f"{data}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, data, duck, name):
    df = driver.queries()[name](spark, data)
    cols = sorted(df.columns)
    got = Counter(tuple(plain(v) for v in r) for r in df.select(*cols).collect())
    r = duck.execute(driver.oracle_sql()[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    want = Counter(tuple(plain(row[names.index(c)]) for c in cols) for row in r.fetchall())
    assert got == want


@pytest.mark.parametrize("name", PLAIN)
def test_runs(spark, data, name):
    df = driver.queries()[name](spark, data)
    assert len(set(df.columns)) == len(df.columns) and df.count() >= 0


def test_entry(spark):
    assert driver.entry(spark).count() > 0
