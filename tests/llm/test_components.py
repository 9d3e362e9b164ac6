"""Groups and splits against union-find."""

import random

import pytest

from strataform.llm import components
from strataform.llm.components import broken_members, connected_components, grouped_splits

SCHEMA = "subject bigint, study bigint, given string, row string, label string, src string"


def roots(pairs):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        up[find(a)] = find(b)
    return {x: find(x) for x in list(up)}


def groups(labels):
    out = {}
    for n, l in labels.items():
        out.setdefault(l, set()).add(n)
    return sorted(map(sorted, out.values()))


@pytest.mark.parametrize("hot", [2, 100_000])
def test_components(spark, monkeypatch, hot):
    monkeypatch.setattr(components, "HOT_EDGES", hot)
    r = random.Random(2)
    edges = [(f"n{r.randrange(150)}", f"n{r.randrange(150)}") for _ in range(110)] + [("hub", f"leaf{i}") for i in range(40)] + [(f"p{i}", f"p{i + 1}") for i in range(25)] + [("self", "self"), ("u", "v"), ("u", "v"), ("v", "u")]
    got = {x.node: x.label for x in connected_components(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert groups(got) == groups(roots(edges))
    assert connected_components(spark.createDataFrame([], "src string, dst string")).count() == 0


def rows(seed=4, n=400):
    r = random.Random(seed)
    out = [(r.choice([None, *range(80)]), r.choice([None, *range(100, 260)]), r.choice(["train", "train", "train", "test", None]), f"r{i}", "l", "s") for i in range(n)]
    return out + [(7, None, "train", f"big{i}", "l", "s") for i in range(200)] + out[:30]


def linked(data):
    pairs = [(("s", a), ("t", b)) for a, b, *_ in data if a is not None and b is not None] + [(("s", a), ("s", a)) for a, *_ in data if a is not None] + [(("t", b), ("t", b)) for _, b, *_ in data if b is not None]
    return roots(pairs)


def test_broken_members(spark):
    data = rows()
    root, seen = linked(data), {}
    for a, b, g, *_ in data:
        node = ("s", a) if a is not None else ("t", b) if b is not None else None
        if node and g:
            seen.setdefault(root[node], set()).add(g)
    want = {a for a, *_ in data if a is not None and len(seen.get(root["s", a], ())) > 1}
    got = [x.subject for x in broken_members(spark.createDataFrame(data, SCHEMA), ["subject", "study"], "given").collect()]
    assert sorted(got) == sorted(want)
    clash = spark.createDataFrame([(a, b, g, k, l, s) for a, b, g, k, l, s in data], SCHEMA.replace("label", "x").replace("given", "label"))
    assert sorted(x.subject for x in broken_members(clash, ["subject", "study"], "label").collect()) == sorted(want)
    assert broken_members(spark.createDataFrame([], SCHEMA), ["subject", "study"], "given").count() == 0


def test_grouped_splits(spark):
    data = rows(9, 3000)
    df = spark.createDataFrame([(a * 50 + i % 50 if a is not None else None, b * 50 + i % 50 if b is not None else None, g, k, l, s) for i, (a, b, g, k, l, s) in enumerate(data)], SCHEMA)
    out = grouped_splits(df, ["subject", "study"], "row", {"train": 0.8, "validate": 0.1, "test": 0.1}).collect()
    assert len(out) == df.count()
    for key in ("subject", "study"):
        by = {}
        for x in out:
            if x[key] is not None:
                by.setdefault(x[key], set()).add(x.new_split)
        assert all(len(v) == 1 for v in by.values())
    share = {s: sum(x.new_split == s for x in out) / len(out) for s in ("train", "validate", "test")}
    assert abs(share["train"] - 0.8) < 0.03 and abs(share["validate"] - 0.1) < 0.03
    again = grouped_splits(df.repartition(3), ["subject", "study"], "row", {"train": 0.8, "validate": 0.1, "test": 0.1}).collect()
    assert {(x.row, x.new_split) for x in out} == {(x.row, x.new_split) for x in again}
    assert grouped_splits(df.filter("false"), ["subject", "study"], "row", {"train": 0.8, "test": 0.2}).count() == 0
