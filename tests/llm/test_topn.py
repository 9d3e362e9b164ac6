"""Top items per group against a plain sort."""

import random

import pytest

from strataform.llm import topn
from strataform.llm.topn import top_n_per_group

SCHEMA = "g string, h bigint, score double, item bigint, g0 string, bound int, rank string"


def brute(rows, n):
    best = {}
    for g, h, s, i, *_ in rows:
        if None not in (g, h, s, i) and s == s:
            k = (g, h, i)
            best[k] = max(best.get(k, s), s)
    out = {}
    for (g, h, i), s in best.items():
        out.setdefault((g, h), []).append((-s, i))
    return {(g, h, i, k + 1) for (g, h), v in out.items() for k, (_, i) in enumerate(sorted(v)[:n])}


@pytest.mark.parametrize("chunk", [7, 1_000_000])
def test_random(spark, monkeypatch, chunk):
    monkeypatch.setattr(topn, "CHUNK_ROWS", chunk)
    r = random.Random(5)
    rows = [(r.choice(["a", "b", "c", "d", None]), r.choice([1, 1, 1, 2, None]), r.choice([0.0, 1.0, 2.0, 2.0, 3.5, None, float("nan"), -1.0]), r.choice([None, *range(60)]), "x", 1, "y") for _ in range(900)]
    df = spark.createDataFrame(rows + rows[:50], SCHEMA).repartition(6)
    got = {(x.g, x.h, x.item, x["rank"]) for x in top_n_per_group(df, ["g", "h"], "score", "item", 5).collect()}
    assert got == brute(rows, 5)


def test_empty_and_strings(spark):
    assert top_n_per_group(spark.createDataFrame([], SCHEMA), ["g", "h"], "score", "item", 5).count() == 0
    df = spark.createDataFrame([("g", 1.0, f"i{k:02d}") for k in range(30)], "g string, score double, item string")
    assert [r.item for r in top_n_per_group(df, ["g"], "score", "item", 3).orderBy("rank").collect()] == ["i00", "i01", "i02"]


def test_hot_group_is_cut_before_the_shuffle(spark):
    """Of a group of many items only about n a chunk survive the bounds."""
    df = spark.range(0, 200_000, 1, 8).selectExpr("'hot' as g", "cast(hash(id) as double) as score", "id as item")
    out = top_n_per_group(df, ["g"], "score", "item", 5)
    want = df.orderBy("score", ascending=False).limit(5)
    assert {r.item for r in out.collect()} == {r.item for r in want.collect()}
