"""Configuration, run records and picks."""

import json

import pytest
from pyspark.sql import functions as F

from strataform.functions.config import coerced, merged, with_settings
from strataform.operators.ordered import pick_without_reuse
from strataform.sources.runlog import RunLog, sections


def test_config():
    base = {"a": {"x": 1, "y": [1.0]}, "b": True}
    assert merged(base, {"a": {"x": 2}}, {"c": None}) == {"a": {"x": 2, "y": [1.0]}, "b": True, "c": None}
    got = with_settings(base, ["a.x=7", "a.y=1,2.5", "b=no"])
    assert got == {"a": {"x": 7, "y": [1.0, 2.5]}, "b": False} and base["a"]["x"] == 1
    for bad in (["a.z=1"], ["b=maybe"], ["a.x=q"]):
        with pytest.raises((KeyError, ValueError)):
            with_settings(base, bad)
    assert coerced("s", None) == "s"


def test_runlog(tmp_path):
    with RunLog(str(tmp_path / "r"), {"k": 1}) as log:
        log.metric(auroc=0.5)
        assert (tmp_path / "r" / "STATUS").read_text() == "running"
    assert (tmp_path / "r" / "STATUS").read_text() == "done"
    assert json.loads((tmp_path / "r" / "metrics.jsonl").read_text())["auroc"] == 0.5
    with pytest.raises(RuntimeError), RunLog(str(tmp_path / "q"), {}):
        raise RuntimeError
    assert (tmp_path / "q" / "STATUS").read_text() == "failed: RuntimeError"
    text = sections({"a": lambda: "fine", "b": lambda: {}["x"]})
    assert "fine" in text and "missing: KeyError" in text


def test_picks(spark):
    df = spark.range(10).withColumnRenamed("id", "k")
    got = pick_without_reuse(df, "k", [("even", F.col("k") % 2 == 0), ("any", F.lit(True)), ("small", F.col("k") < 2), ("again", F.col("k") < 2)])
    assert [tuple(r) for r in got.collect()] == [("even", 0), ("any", 1)]
