"""Queries that have SQL, held against DuckDB on whole test tables."""

import os

import duckdb
import pytest

from riskloom.llm import registry

AT = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(AT), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, name):
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{AT}/documents.parquet'")
    df, sql = registry.queries()[name](spark, AT), c.sql(registry.oracle_sql()[name])
    cols = sorted(df.columns)
    assert sorted(sql.columns) == cols
    want = sorted(tuple(r) for r in sql.select(*[duckdb.ColumnExpression(x) for x in cols]).fetchall())
    assert sorted(tuple(r) for r in df.select(*cols).collect()) == want
