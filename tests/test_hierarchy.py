"""Paths, descendants and cycles against plain searches."""

import random

import pytest

from strataform.operators.hierarchy import ancestor_pairs, cycle_cases, root_paths

SCHEMA = "child string, parent string, note string"


def frame(spark, edges):
    return spark.createDataFrame([(c, p, "x") for c, p in edges], SCHEMA)


def brute(edges):
    up, down = {}, {}
    for c, p in edges:
        if c is not None and p is not None:
            up.setdefault(c, set()).add(p)
            down.setdefault(p, set()).add(c)
    nodes = set(up) | set(down)
    pairs = {}
    for n in nodes:
        level, d = set(up.get(n, ())), 1
        while level:
            new = {a for a in level if (a, n) not in pairs}
            for a in new:
                pairs[a, n] = d
            level, d = {b for a in new for b in up.get(a, ())}, d + 1
    on = {n for n in nodes if (n, n) in pairs}
    below = {n for n in nodes - on if any((a, n) in pairs for a in on)}
    paths = {}
    for r in nodes - set(up):
        todo = [(r,)]
        while todo:
            p = todo.pop()
            key = (p[-1], r)
            if key not in paths or (len(p), p) < (len(paths[key]), paths[key]):
                paths[key] = p
            todo += [(*p, c) for c in down.get(p[-1], ()) if c not in p]
    return pairs, {n: "on_cycle" for n in on} | {n: "below_cycle" for n in below}, paths


CASES = [
    [],
    [("a", "a")],
    [("a", "b"), ("b", "a"), ("c", "a"), ("d", "c"), ("d", "r"), (None, "r"), ("x", None)],
    [("b", "a"), ("b", "a"), ("c", "b"), ("c", "a"), ("d", "c")],
    [(f"n{i + 1:03d}", f"n{i:03d}") for i in range(70)] + [("m", "n069"), ("m", "n003")],
    [("a1", "a2"), ("a2", "a3"), ("a3", "a1"), ("a1", "b1"), ("b1", "b2"), ("b2", "b1"), ("t", "a2"), ("b1", "r")],
]


@pytest.mark.parametrize("edges", CASES + [[(f"v{random.Random(s).randrange(12)}{0}", f"v{random.Random(s + 99).randrange(12)}{0}")] for s in range(2)])
def test_small(spark, edges):
    check(spark, edges)


@pytest.mark.parametrize("seed", range(3))
def test_random(spark, seed):
    r = random.Random(seed)
    check(spark, [(f"v{r.randrange(18)}", f"v{r.randrange(18)}") for _ in range(20)])


def check(spark, edges):
    pairs, cases, paths = brute(edges)
    df = frame(spark, edges)
    assert {(r[0], r[1]): r[2] for r in ancestor_pairs(df).collect()} == pairs
    assert {r[0]: r[1] for r in cycle_cases(df).collect()} == cases
    assert {(r[0], r[1]): tuple(r[3]) for r in root_paths(df).collect()} == paths
