"""Neighbours and near-equal pairs against brute force."""

import numpy as np
import pytest

from strataform.llm import neighbours as nb
from strataform.llm import overlap
from strataform.llm.symbolindex import SymbolIndex, merged
from strataform.llm.vectortree import Tree, unit

SCHEMA = "dicom_id string, vector array<float>, id string, leaf int, cell string"


def table(spark, seed=0, n=400, copies=30):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, 16))
    v = (centres[r.integers(6, size=n)] + 0.4 * r.normal(size=(n, 16))).astype(np.float32)
    v[50 : 50 + copies] = v[50]  # equal vectors
    v[5] = 3 * v[6]  # the same direction, another length
    v[10:20] = v[20:30] + 0.01 * r.normal(size=(10, 16)).astype(np.float32)
    rows = [(f"d{i:04d}", v[i].tolist(), "x", 1, "y") for i in range(n)]
    bad = [("n1", None), ("n2", []), ("n3", [1.0] * 15), ("n4", [0.0] * 16), ("n5", [float("nan")] + [1.0] * 15), ("n6", [float("inf")] + [1.0] * 15), ("n7", [None] + [1.0] * 15), (None, [1.0] * 16)]
    return spark.createDataFrame(rows + [(a, b, "x", 1, "y") for a, b in bad] + rows[:25], SCHEMA), unit(v)


def brute(v, k):
    s = np.round(v @ v.T, 6)
    np.fill_diagonal(s, -9)
    return {(f"d{i:04d}", rank + 1): (f"d{j:04d}", s[i, j]) for i in range(len(v)) for rank, j in enumerate(np.argsort(-s[i], kind="stable")[:k])}


@pytest.mark.parametrize("members, queries", [(8192, 32_768), (20, 25)])
def test_all_leaves_give_the_exact_result(spark, monkeypatch, members, queries):
    monkeypatch.setattr(nb, "CELL_MEMBERS", members)
    monkeypatch.setattr(nb, "CELL_QUERIES", queries)
    monkeypatch.setattr(nb, "COPIES", 7)
    monkeypatch.setattr(nb, "_calibrated_visits", lambda *a: 1 << 20)
    df, v = table(spark)
    got = {(r.id, r["rank"]): (r.neighbour, r.similarity) for r in nb.most_similar(df, "dicom_id", "vector", 16, 5, leaf=40).collect()}
    want = brute(v, 5)
    assert set(got) == set(want)
    assert sum(got[k] != want[k] for k in want) <= 2  # float32 input: a last digit may round otherwise


def test_calibrated_recall(spark):
    df, v = table(spark, seed=3, n=1500, copies=3)
    got = {(r.id, r.neighbour) for r in nb.most_similar(df, "dicom_id", "vector", 16, 5, leaf=50).collect()}
    want = {(i, j) for (i, _), (j, _) in brute(v, 5).items()}
    assert len(got & want) / len(want) >= 0.95


def test_small_and_empty(spark):
    df, _ = table(spark)
    assert nb.most_similar(df.filter("false"), "dicom_id", "vector", 16, 5).count() == 0
    few = df.filter("dicom_id in ('d0001', 'd0002', 'd0003')")
    assert nb.most_similar(few, "dicom_id", "vector", 16, 5).count() == 6
    assert nb.most_similar(df.filter("dicom_id = 'd0001'"), "dicom_id", "vector", 16, 5).count() == 0


@pytest.mark.parametrize("shard", [65_536, 40])
def test_near_equal(spark, monkeypatch, shard):
    monkeypatch.setattr(overlap, "SHARD", shard)
    df, v = table(spark, seed=1)
    sides = [(f"d{i:04d}", "a" if i % 3 else "b") for i in range(395)] + [("d0052", "a"), ("gone", "a")]
    got = sorted(tuple(r) for r in overlap.near_equal_across(df, spark.createDataFrame(sides, "id string, side string"), "dicom_id", "vector", 16, 0.98).collect())
    s = v @ v.T
    side = {}
    for i, x in sides:
        side.setdefault(i, set()).add(x)
    name = [f"d{i:04d}" for i in range(len(v))]
    want = sorted((name[i], name[j]) for i in range(len(v)) for j in range(len(v)) if i != j and s[i, j] >= 0.98 and "a" in side.get(name[i], ()) and "b" in side.get(name[j], ()))
    assert got == want and len(want) > 50
    none = spark.createDataFrame([], "id string, side string")
    assert overlap.near_equal_across(df, none, "dicom_id", "vector", 16, 0.98).count() == 0


def test_backward_search_finds_every_stretch():
    r = np.random.default_rng(4)
    a, b = r.integers(3, size=(40, 12)).astype(np.int32), r.integers(3, size=(30, 12)).astype(np.int32)
    b[3] = a[5]
    q, v, start, end = SymbolIndex.build(a).matches(b, 4)
    got = set(zip(q.tolist(), v.tolist(), start.tolist(), end.tolist()))
    want = {(i, k, j, j + 3) for i in range(30) for k in range(40) for j in range(9) if (b[i, j : j + 4] == a[k, j : j + 4]).all()}
    assert got == want and len(q) == len(want)
    pq, pv, n = merged(q, v, start, end, 40)
    covered = {(i, k): len({x for (a_, b_, s, e) in want if (a_, b_) == (i, k) for x in range(s, e + 1)}) for i, k, *_ in want}
    assert dict(zip(zip(pq.tolist(), pv.tolist()), n.tolist())) == covered


def test_maximal_stretches():
    r = np.random.default_rng(5)
    a, b = r.integers(2, size=(30, 14)).astype(np.int32), r.integers(2, size=(20, 14)).astype(np.int32)
    b[3] = a[5]
    got = set(zip(*(x.tolist() for x in SymbolIndex.build(a).maximal(b, 3))))
    want = set()
    for i in range(20):
        for k in range(30):
            same = [False, *(b[i] == a[k]).tolist(), False]
            starts = [j for j in range(1, 15) if same[j] and not same[j - 1]]
            ends = [j for j in range(1, 15) if same[j] and not same[j + 1]]
            want |= {(i, k, s - 1, e - 1) for s, e in zip(starts, ends) if e - s >= 2}
    assert got == want and (3, 5, 0, 13) in got


def test_best_bins_are_the_nearest_leaves():
    """With room for few nodes the queue gives the same leaves as with room for all."""
    from strataform.llm.vectortree import Tree

    x = unit(np.random.default_rng(2).normal(size=(3000, 12))).astype(np.float32)
    tree = Tree.fit(x, 200)
    every = tree.best_bins(x[:50], tree.leaves)
    assert (np.sort(every, axis=1) == np.arange(tree.leaves)).all()
    assert (tree.best_bins(x[:50], 9) == every[:, :9]).all()


def test_match_recall_near_the_limit():
    """Pairs at a cosine of 0.985 share a long enough match under nearly every choice of rotations."""
    from strataform.llm.symbolindex import VectorIndex

    r = np.random.default_rng(6)
    x = unit(r.normal(size=(2000, 64)))
    noise = r.normal(size=x.shape)
    noise -= (noise * x).sum(1, keepdims=True) * x
    y = 0.985 * x + np.sqrt(1 - 0.985**2) * unit(noise)
    q, v, _ = VectorIndex(x).near(y, 0.98)
    assert (q == v).sum() >= 1998


def test_tree_orders_all_leaves():
    r = np.random.default_rng(4)
    x = unit(r.normal(size=(3000, 8))).astype(np.float32)
    tree = Tree.fit(x[:1000], 60)
    leaf = tree.assign(x)
    order = tree.best_bins(x[:50], tree.leaves)
    assert all(sorted(o) == list(range(tree.leaves)) for o in order.tolist()) and (order[:, 0] == leaf[:50]).mean() > 0.8


def test_no_vector_is_shuffled_by_visit(spark, tmp_path):
    """However many leaves are visited, a vector is written a few times only: once kept, once in its leaf."""
    import subprocess

    df, _ = table(spark, seed=2, n=3000, copies=3)
    rows = nb.valid_vectors(df, "dicom_id", "vector", 16).count()
    folder = nb.shared_folder(spark, "x").rpartition("/")[0].removeprefix("file:")
    used = lambda: int(subprocess.run(["du", "-sb", folder], capture_output=True, text=True).stdout.split()[0])
    before = used()
    found = nb.most_similar(df, "dicom_id", "vector", 16, 5, recall=1.0, leaf=50)
    assert found.count() == 5 * rows
    assert used() - before < 12 * 4 * 16 * rows
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" not in plan


def test_leaves_are_whole(spark, monkeypatch):
    """Leaves cut into batches and over files come back with every member once."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(nb, "CELL_MEMBERS", 7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    try:
        members = spark.range(500).select(F.concat(F.lit("m"), "id").alias("id"), F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("vector"), (F.col("id") % 3 == 0).alias("asked"), F.floor(F.sqrt("id")).cast("int").alias("leaf"))
        leaves = nb.write_leaves(members)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = [(leaf, name, x[0], asked) for leaf, parts in leaves.parts.items() for part in parts for name, x, asked in zip(leaves.batch(part)[0].to_pylist(), leaves.batch(part)[1].tolist(), leaves.batch(part)[3].tolist())]
    assert sorted(got) == sorted((int(i**0.5), f"m{i}", float(i), i % 3 == 0) for i in range(500))
    assert all(part[2] <= 7 for parts in leaves.parts.values() for part in parts)


def test_words_and_common_symbols():
    from strataform.llm.symbolindex import MATCH, VectorIndex, WordIndex, common_symbols, strings, words_of

    r = np.random.default_rng(7)
    a, b = r.integers(3, size=(60, 12)), r.integers(3, size=(40, 12))
    for j, (x, y) in enumerate(zip(words_of(a, 4), words_of(b, 4))):
        for most in (1, 7, 10_000):
            got = [p for q, v in WordIndex.build(x).hits(y, most) for p in zip(q.tolist(), v.tolist())]
            assert sorted(got) == sorted((i, k) for i in range(40) for k in range(60) if (b[i, j : j + 4] == a[k, j : j + 4]).all())
    x = unit(r.normal(size=(300, 64)))
    y = unit(x + 0.02 * r.normal(size=x.shape))
    q, v, n = VectorIndex(x).near(y, 0.98)
    assert len(q) >= 290 and common_symbols(y[q], x[v]).tolist() == n.tolist()


def test_symbols_of_pairs_and_parts(spark, monkeypatch):
    """Bands, shards and parts of the queries are searched whole, and the symbols are those of the whole index."""
    from strataform.llm.symbolindex import VectorIndex

    r = np.random.default_rng(8)
    x = r.normal(size=(200, 64)).astype(np.float32)
    y = (x + 0.03 * r.normal(size=x.shape)).astype(np.float32)
    rows = [(f"{side}{i:03d}", v.tolist()) for side, t in (("a", x), ("b", y)) for i, v in enumerate(t)]
    sides = spark.createDataFrame([(i, i[0]) for i, _ in rows], "id string, side string")
    q, v, n = VectorIndex(unit(y)).near(unit(x), 0.98)
    want = sorted(zip([f"a{i:03d}" for i in q], [f"b{i:03d}" for i in v], n.tolist()))
    for shard, band, step in ((1 << 18, 8, 1 << 16), (70, 20, 30)):
        monkeypatch.setattr(overlap, "SHARD", shard)
        monkeypatch.setattr(overlap, "BAND", band)
        monkeypatch.setattr(overlap, "STEP", step)
        df = spark.createDataFrame(rows, "id string, vector array<float>")
        got = sorted(tuple(t) for t in overlap.near_equal_across(df, sides, "id", "vector", 64, 0.98, shared=True).collect())
        assert got == want and len(want) >= 195
