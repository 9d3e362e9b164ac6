"""Queries with SQL against it, on the smallest tables; the others must run."""

import os

import duckdb
import pytest

from strataform.llm import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    mine = sorted(tuple(r) for r in df.select(*columns).collect())
    if name in registry.oracle_sql():
        c = duckdb.connect()
        for f in os.listdir(SF):
            c.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{SF}/{f}')")
        c.execute(registry.oracle_sql()[name])
        order = [[d[0] for d in c.description].index(x) for x in columns]
        assert mine == sorted(tuple(r[i] for i in order) for r in c.fetchall())
