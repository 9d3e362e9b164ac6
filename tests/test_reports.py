"""Plain terms, vocabularies, tags, facts, sides, prompts, choosers, windows, rebuilt rows, grouped fits and decisions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataform.operators import extraction, hierarchy, metrics, model, nested, vectors
from strataform.operators.contracts import ContractError
from strataform.sources import sinks


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_plain_terms(spark):
    terms = spark.createDataFrame([("edema", "pulmonary edema", 0), ("edema", "edema", 1), ("mass", "mass", 0)], "node string, term string, priority int")
    df = spark.createDataFrame([(3, "Edema. "), (2, "edema"), (9, "no mass"), (4, None), (5, "")], "k bigint, text string")
    assert rows(extraction.plain_terms(df, "k", "text", terms), "node", "k", "term") == [("edema", 2, "edema")]
    more = df.unionByName(spark.createDataFrame([(8, "PULMONARY EDEMA.")], "k bigint, text string"))
    assert rows(extraction.plain_terms(more, "k", "text", terms), "node", "k") == [("edema", 8)]


def test_vocabulary_conflicts(spark):
    v = extraction.vocabulary(spark.createDataFrame([("a", ["X  y", " x y", None, ""]), ("b", ["z"]), (None, ["q"]), ("c", None)], "node string, s array<string>"), "node", "s")
    assert rows(v, "term", "nodes") == [("x y", ["a"]), ("z", ["b"])]
    assert rows(extraction.unambiguous(v), "term", "node") == [("x y", "a"), ("z", "b")]
    with pytest.raises(ContractError):
        extraction.unambiguous(extraction.vocabulary(spark.createDataFrame([("a", ["x"]), ("b", ["X "])], "node string, s array<string>"), "node", "s"))


def test_core_observation_and_tags(spark):
    e = spark.createDataFrame([(1, 0, "small", False), (1, 1, "effusion", True), (1, 2, "other", True), (2, 0, "tiny", False), (2, 1, "opacity", False), (2, 2, "nodules", False)], "k bigint, place int, entity string, located boolean")
    core = extraction.core_observation(e, ["k"])
    assert rows(core, "k", "entity") == [(1, "effusion"), (2, "opacity")]  # as long as nodules, and before it
    terms = spark.createDataFrame([("effusion", "pleural_effusion"), ("cardiomegaly", "cardiomegaly")], "term string, node string")
    texts = spark.createDataFrame([(1, "small pericardial effusion"), (2, "Cardiomegaly"), (3, None)], "k bigint, text string")
    core = core.join(spark.createDataFrame([(1, "definitely present", "R1"), (2, None, None)], "k bigint, certainty string, anatomy string"), "k")
    got = extraction.concept_tags(texts, "k", "text", core, terms, [("pleural_effusion", "pericardial", "pericardial_effusion")])
    assert sorted((r.k, r.node, r.group_key) for r in got.collect()) == [(1, "pericardial_effusion", "pericardial_effusion|R1|unspecified"), (2, "cardiomegaly", "cardiomegaly|-|unspecified"), (3, None, None)]


def test_report_facts(spark):
    s = spark.createDataFrame([(1, "no edema in the left upper lobe"), (2, "resolved mass")], "k bigint, sentence string")
    seen = spark.createDataFrame([(1, "Edema", "definitely present"), (1, "thing", "definitely present"), (2, "mass", "definitely present")], "k bigint, entity string, certainty string")
    where = spark.createDataFrame([(1, 0, "lobe", "R9"), (1, 1, "upper lobe", "R1"), (1, 2, "somewhere else", None)], "k bigint, place int, entity string, rid string")
    terms = spark.createDataFrame([("edema", "edema"), ("mass", "lung_lesion")], "term string, node string")
    got = extraction.report_facts(s, ["k"], seen, where, terms)
    assert sorted((r.k, r.node, r.anatomy, r.laterality, r.polarity) for r in got.collect()) == [(1, "edema", "R1", "left", "absent"), (2, "lung_lesion", None, "unspecified", "absent")]


def test_explicit_sides(spark):
    p = spark.createDataFrame([(1, "left lung", "opacity at the right base"), (1, "left lung", "LT apical change"), (2, "spine", "fracture"), (2, "spine", None), (3, "right lung", "both bases")], "k bigint, region string, phrase string")
    assert rows(extraction.explicit_sides(p, ["k"], "phrase"), "k", "side") == [(1, "bilateral"), (2, "default"), (3, "bilateral")]
    assert rows(extraction.explicit_regions(p, ["k"], "region", "phrase"), "k", "explicit") == [(1, True), (2, False), (3, True)]


def test_prompts_and_feedback(spark):
    s = spark.createDataFrame([(1, "b", "Edema", "present", "left", None, True), (1, "a", "Mass", "absent", None, "upper", False), (2, None, None, None, None, None, False)], "k bigint, node string, label string, certainty string, side string, zone string, normal boolean")
    assert rows(extraction.prompts(s, ["k"], "normal"), "k", "prompt") == [(1, "Study marked normal: yes\nStatements:\n- mass: absent; zone: upper\n- edema: present; side: left"), (2, "Study marked normal: no\nStatements:\n- none")]
    m = spark.createDataFrame([(1, "b", "Edema", "side", None, "Edema is there."), (1, None, None, "lobe", None, None)], "k bigint, node string, label string, kind string, expected string, sentence string")
    said = extraction.feedback(m, ["k"]).first().feedback
    assert "do not mention any lung lobe do not give any side for 'edema'" in said and 'Write it as: "Edema is there."' in said


def test_choosers(spark):
    r = spark.createDataFrame([(1, "a", 0.5, 3, 1), (1, "b", 0.5, 9, 0), (1, "c", None, 9, None), (2, "x", None, None, None)], "k bigint, region string, score double, size int, hit int")
    got = {(x.k, x.chooser): x.hit for x in vectors.chooser_baselines(r, ["k"], "region", "score", "size", ["hit"]).collect()}
    assert got == {(1, "model"): 1.0, (1, "largest_region"): 0.0, (1, "random_region"): 0.5, (2, "model"): None, (2, "largest_region"): None, (2, "random_region"): None}


@pytest.mark.parametrize("invert", [False, True])
def test_windows(spark, invert):
    r = np.random.default_rng(1)
    arrays = [r.normal(size=300).tolist(), [2.0, 2.0, 2.0], [], None, [1.0]]
    got = [x.w for x in spark.createDataFrame([(i, a) for i, a in enumerate(arrays)], "i int, v array<double>").orderBy("i").select(vectors.window_bytes(F.col("v"), invert=invert).alias("w")).collect()]
    for a, w in zip(arrays, got):
        if not a:
            assert w == a
            continue
        x = np.array(a)
        lo, hi = np.percentile(x, [0.5, 99.5])
        y = np.clip((x - lo) / ((hi - lo) if hi > lo else 1.0), 0, 1)
        assert w == np.floor((1 - y if invert else y) * 255 + 0.5).astype(int).tolist()


def test_rebuild(spark):
    ids = spark.createDataFrame([(0, "a"), (1, "b")], "row int, key string")
    shards = spark.createDataFrame([(1, 5.0), (0, 4.0), (1, 5.0)], "row int, v double")
    assert rows(vectors.rebuild_in_order(shards, ids, "row", "key"), "row", "key", "v") == [(0, "a", 4.0), (1, "b", 5.0)]
    for bad in (shards.filter("row = 1"), shards.unionByName(spark.createDataFrame([(7, 1.0)], "row int, v double"))):
        with pytest.raises(ContractError):
            vectors.rebuild_in_order(bad, ids, "row", "key")


def test_grouped_fits_reach_the_optimum(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(400, 2))
    y = (x @ [1.0, -2.0] + 0.3 + r.logistic(size=400) > 0).astype(int)
    data = [("g" if i % 2 else "h", float(a), float(b), int(c) if i % 11 else None) for i, ((a, b), c) in enumerate(zip(x, y))]
    fit = model.fit_groups(spark.createDataFrame(data + [("all one", 1.0, 2.0, 1)], "node string, a double, b double, y int"), "node", ["a", "b"], "y", (0.1, 10.0))
    got = {(m.node, m.c): m for m in fit.collect()}
    assert len(got) == 6
    for (node, c), m in got.items():
        some = [d for d in data if d[0] == node and d[3] is not None] or [("", 1.0, 2.0, 1)]
        z = np.array([[1.0, d[1], d[2]] for d in some])
        w = np.array([m.intercept, *m.weights])
        gradient = z.T @ (1 / (1 + np.exp(-z @ w)) - [d[3] for d in some]) + np.array([0, w[1], w[2]]) / c
        if node != "all one":
            assert m.n == len(some) and np.abs(gradient).max() < 1e-4 * len(some)


def test_conditional_rows(spark):
    s = spark.createDataFrame([(1, "p", 1), (1, "c", 0), (2, "p", 0), (2, "c", 1), (3, "c", 1), (4, "p", None)], "e bigint, n string, y int")
    got = model.conditional_rows(s, spark.createDataFrame([("c", "p")], "child string, parent string"), "e", "n", "y")
    assert rows(got, "e", "n") == [(1, "c"), (1, "p"), (2, "p")]


def test_keep_or_drop(spark):
    kind = "part string, metric string, node string, first string, second string, diff double, low double, high double"
    df = spark.createDataFrame([("r", "AUROC", "MACRO", "without", "with", -0.1, -0.2, -0.05), ("r", "ECE", "x", "with", "without", 0.1, 0.05, 0.2), ("q", "ECE", "MACRO", "with", "without", 0.3, 0.1, 0.4)], kind)
    wanted = df.select("part", "metric", "node", F.lit("with").alias("first"), F.lit("without").alias("second"))
    signed = metrics.signed_difference(df, wanted, "first", "second")
    assert {(r.part, r.metric): (r.low, r.high) for r in signed.collect()}["r", "AUROC"] == (0.05, 0.2)
    got = metrics.keep_or_drop(signed, "part", "metric", "node", ["ECE"])
    assert sorted((r.part, r.keep, r.better, r.worse) for r in got.collect()) == [("q", False, [], ["ECE MACRO"]), ("r", True, ["AUROC MACRO"], [])]


def test_path_counts(spark):
    links = [("b", "a"), ("c", "a"), ("d", "b"), ("d", "c"), ("e", "d"), ("x", "x"), ("y", "x"), ("z", "y"), ("z", "e"), (None, "a")]
    got = hierarchy.path_counts(spark.createDataFrame(links, "child string, parent string"))
    assert {r.node: int(r.paths) for r in got.collect()} == {"a": 1, "b": 1, "c": 1, "d": 2, "e": 2}


def test_schema_paths_beyond_64_levels(spark):
    deep = '{"a":' * 70 + "1" + "}" * 70
    df = spark.createDataFrame([(deep,)], "t string").select(F.parse_json("t").alias("v"))
    assert nested.schema_paths(df, "v", set()).count() == 71


def test_a_table_replaces_the_one_it_is_read_from(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.write_table(spark.range(5), path)
    out = sinks.write_table(spark.read.parquet(path).selectExpr("id + 1 AS id"), path)
    assert rows(out, "id") == [(i,) for i in range(1, 6)] and len(list(tmp_path.iterdir())) == 1
    with pytest.raises(Exception):  # noqa: B017
        sinks.write_table(spark.range(3).select(F.raise_error(F.lit("no")).alias("id")), path)
    assert rows(spark.read.parquet(path), "id") == [(i,) for i in range(1, 6)]
