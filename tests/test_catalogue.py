"""Every query with SQL, held against DuckDB on the smallest tables."""

import datetime
import decimal
import glob
import os

import duckdb
import pytest

from riskloom.plans import catalogue

AT = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(AT), reason="no test tables here")


def plain(v):
    if isinstance(v, decimal.Decimal):
        return int(v) if v == int(v) else float(v)
    if isinstance(v, datetime.datetime):
        return v.date()
    return v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(AT + "/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query(spark, duck, name):
    df, sql = catalogue.queries()[name](spark, AT), duck.sql(catalogue.oracle_sql()[name])
    cols = sorted(df.columns)
    assert sorted(sql.columns) == cols
    key = lambda r: tuple((x is None, str(x)) for x in r)
    got = sorted((tuple(map(plain, r)) for r in df.select(*cols).collect()), key=key)
    want = sorted((tuple(plain(r[sql.columns.index(c)]) for c in cols) for r in sql.fetchall()), key=key)
    assert got == want
