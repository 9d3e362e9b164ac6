"""Every core query against its SQL on the smallest tables; queries without SQL must run."""

import math
import os

import duckdb
import pytest

from strataform.plans import registry

SF = "/root/testdata/sf0.001"
SQL, QUERIES = registry.oracle_sql(), registry.queries()


def plain(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v if v is None or isinstance(v, (int, bool)) else str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set TimeZone='UTC'")
    for f in os.listdir(SF):
        c.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{SF}/{f}')")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    mine = sorted((tuple(plain(x) for x in r) for r in df.select(*[f"`{c}`" for c in columns]).collect()), key=repr)
    if name in SQL:
        cur = con.cursor()
        cur.execute(SQL[name])
        names = [d[0] for d in cur.description]
        order = [names.index(c) for c in columns]
        assert sorted(names) == columns
        assert mine == sorted((tuple(plain(r[i]) for i in order) for r in cur.fetchall()), key=repr)


def test_no_python_in_native_queries(spark):
    """Queries of operators that Spark expresses itself have no Python in their plans."""
    for name in ["label_closure", "parent_raise", "auroc_by_group", "section_split", "claim_compare", "unit_hash_split", "token_jaccard", "bootstrap_ci"]:
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "InPandas" not in plan, name
        assert "CartesianProduct" not in plan, name


def test_filter_and_columns_reach_the_scan(spark):
    plan = QUERIES["pushed_in_filter"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(o_custkey" in plan and "o_comment" not in plan and "o_totalprice" not in plan
