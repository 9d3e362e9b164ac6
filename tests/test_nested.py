"""Shredding of nested records against a plain version, on the table and on hand-made cases."""

import datetime as dt
import json
import os

import pytest

from strataform.operators.nested import Child, Element, inline_plan
from strataform.plans import queries_nested as q
from tests.brute_nested import found

SF = "/root/testdata/sf0.001"


def compare(spark, folder):
    mine = sorted(tuple(r) for r in q.p3_found(spark, folder).collect())
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/belief_graphs.parquet").select("graph_id", "written_at", "payload").collect()]
    assert mine == sorted(found(rows))
    return mine


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_table(spark):
    assert compare(spark, SF)


def test_cases(spark, tmp_path):
    t = lambda n: dt.datetime(2024, 1, n)
    node = {"finding": "edema", "anatomy": [{"zone": "a"}, None, {"zone": "b"}], "contributions": {"img": 1, "lat": None}}
    payloads = [
        (1, t(1), json.dumps({"nodes": {"edema": node}, "audit": [{"rule": "D1"}, None, {"rule": "D2"}], "extra": [[[]]]})),
        (1, t(2), json.dumps({"nodes": [node], "audit": {"rule": "D9"}})),  # written later; a single object is a list of one
        (2, t(1), json.dumps(json.dumps({"nodes": node, "fused": {"support": {"contributing_concepts": {"concept_id": "7"}}}}))),  # in a string; a single node
        (3, t(1), '  {"fused": [null, {"support": [null, {"contributing_concepts": [{"concept_id": 5}, null, {"concept_id": "6"}]}]}, {"support": null}]}\n'),
        (4, t(1), '{"nodes": {"a'), (5, t(1), None), (6, t(1), ""), (7, t(1), "null"), (8, t(1), "[]"), (9, t(1), "5"), (None, t(1), json.dumps({"audit": [{"rule": "x"}]})),
        (10, t(1), json.dumps({"nodes": {"f": {"finding": "f", "contributions": [{"group": "img", "value": None}, None, {"value": 1}]}}, "audit": [], "fused": []})),
        (11, None, json.dumps({"audit": [{"rule": "old"}]})), (11, t(1), json.dumps({"audit": [{"rule": "new"}]})),
        (12, t(1), json.dumps({"audit": [{"rule": "D1"}]})), (12, t(2), "broken"),
    ]
    spark.createDataFrame(payloads * 2, "graph_id bigint, written_at timestamp, payload string").write.parquet(f"{tmp_path}/belief_graphs.parquet")
    mine = compare(spark, str(tmp_path))
    assert (1, "audit", "D9", "0") in mine and (2, "concept", "0.0", "7") in mine and (3, "concept", "1.1", "6") in mine
    assert (1, "contribution", "edema", "lat") in mine and not [r for r in mine if r[0] == 12]


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "graph_id bigint, written_at timestamp, payload string").write.parquet(f"{tmp_path}/belief_graphs.parquet")
    for f in q.QUERIES.values():
        assert f(spark, str(tmp_path)).count() == 0


def test_recursive_rows_keep_their_parent(spark, tmp_path):
    deep = {"node": "x"}
    for i in range(6):
        deep = {"node": f"n{i}", "part_of": [deep]}
    spark.createDataFrame([(1, None, json.dumps({"nodes": [{"finding": "f", "anatomy": [{"part_of": deep}]}]}))], "graph_id bigint, written_at timestamp, payload string").write.parquet(f"{tmp_path}/belief_graphs.parquet")
    rows = {r.row_id: r for r in q.p3_part_of(spark, str(tmp_path)).collect()}
    assert len(rows) == 7
    longest = max(rows.values(), key=lambda r: len(r.row_id))
    assert longest.node == "x" and longest.parent in rows


def test_plan():
    graph = {e.name: e for e in [
        Element("a", {"x": "int"}, None, [Child("b", "b", "one"), Child("c", "c"), Child("s1", "s", "one")]), Element("b", {"y": "int"}, None, [Child("s2", "s", "one")]), Element("c"), Element("s", {"z": "int"}),
    ]}
    plan = inline_plan(graph, "a")
    assert {n: p.why for n, p in plan.items()} == {"a": "root", "c": "repeated", "s": "shared"}
    assert plan["a"].columns == {"x": ("$.x", "int"), "b_y": ("$.b.y", "int")} and plan["s"].parents == ["a"]
