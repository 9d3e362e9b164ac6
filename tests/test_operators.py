"""Rules and edge cases of the operators on small literals."""

import pytest
from pyspark.sql import functions as F

from strataform.functions import names, numeric
from strataform.operators import contracts, decide, fusion, metrics, ontology, ordered, relational, text, vectors
from strataform.plans.base import IS_A


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_contracts(spark):
    df = spark.createDataFrame([(1, 2.0), (1, None), (None, float("nan"))], "k int, x double")
    with pytest.raises(contracts.ContractError):
        contracts.expect_unique(df, ["k"])
    with pytest.raises(contracts.ContractError):
        contracts.expect_not_null(df, ["x"])
    with pytest.raises(contracts.ContractError):
        contracts.expect_finite(df, ["x"])
    with pytest.raises(contracts.ContractError):
        contracts.expect_count(df, 2)
    with pytest.raises(contracts.ContractError):
        contracts.require_columns(df, ["y"])
    with pytest.raises(contracts.ContractError):
        contracts.failed_share(df, F.col("k").isNull(), 0.1)
    with pytest.raises(PermissionError):
        contracts.guard_split(df.withColumn("split", F.lit("test")), "test", False)
    empty = spark.createDataFrame([], "check string, passed boolean")
    assert rows(contracts.gate(empty)) == [("ALL", True)]
    assert rows(numeric.nan_to_null(df).select("x").distinct()) == [(2.0,), (None,)]


def test_joins(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z")], "k int, v string")
    b = spark.createDataFrame([(1, "r"), (1, "s"), (None, "t")], "k int, v string")
    with pytest.raises(contracts.ContractError):
        relational.checked_join(a, b, ["k"], validate="many_to_one")
    assert relational.checked_join(a, b.filter("v = 'r'"), ["k"]).count() == 2
    assert relational.suffixed_join(a, b, ["k"], "inner", ("_a", "_b")).columns == ["k", "v_a", "v_b"]
    assert relational.frames_equal(a, a.select("v", "k")) and not relational.frames_equal(a, a.unionByName(a))
    assert rows(relational.membership_flag(a, b, ["k"], "f").select("v", "f")) == [("x", True), ("y", True), ("z", False)]
    with pytest.raises(contracts.ContractError):
        relational.lookup_all(a, b.filter("k is null").withColumnRenamed("v", "w"), ["k"], "w")
    with pytest.raises(ValueError):
        names.snake_columns(spark.createDataFrame([(1, 2)], "`A b` int, `a B` int"))


def test_ranks_and_quantiles(spark):
    df = spark.createDataFrame([("g", 1.0), ("g", 2.0), ("g", 2.0), ("g", None), ("h", 5.0)], "g string, s double")
    assert rows(ordered.average_rank(df, ["g"], "s").select("g", "s", "rank")) == [("g", 1.0, 1.0), ("g", 2.0, 2.5), ("g", 2.0, 2.5), ("g", None, None), ("h", 5.0, 1.0)]
    assert rows(ordered.nearest_index_quantile(df, "s", 0.5)) == [(0.5, 2.0)]
    assert ordered.nearest_index_quantile(df.filter("false"), "s", 0.5).count() == 0
    assert ordered.average_rank(df.filter("false"), ["g"], "s").count() == 0


def brute_auroc(y, p):
    pos, neg = [a for a, b in zip(p, y) if b == 1], [a for a, b in zip(p, y) if b == 0]
    return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))


def test_metrics(spark):
    import random

    r = random.Random(3)
    data = [("n", i, r.randrange(40) / 40, r.choice([0, 1, 1, None])) for i in range(400)]
    df = spark.createDataFrame(data, "node string, id int, p double, y int")
    known = [(p, y) for _, _, p, y in data if y is not None]
    assert metrics.auroc(df, ["node"]).first()["auroc"] == pytest.approx(brute_auroc([y for _, y in known], [p for p, _ in known]))
    seen, tp, ap = 0, 0, 0.0
    for v in sorted({p for p, _ in known}, reverse=True):
        ys = [y for p, y in known if p == v]
        seen, tp = seen + len(ys), tp + sum(ys)
        ap += sum(ys) * tp / seen
    assert metrics.average_precision(df, ["node"]).first()["auprc"] == pytest.approx(ap / sum(y for _, y in known))
    c = metrics.curves(df, ["node"])
    t = metrics.absent_threshold(c, ["node"], missed=0.05).first()["thr"]
    assert sum(y for p, y in known if p <= t) / sum(y for _, y in known) <= 0.05
    assert metrics.auroc(df.filter("y = 1"), ["node"]).first()["auroc"] is None
    assert metrics.auroc(df.filter("false"), ["node"]).count() == 0
    edge = spark.createDataFrame([(k / 15,) for k in range(16)], "p double").select(numeric.width_bin(F.col("p"), 15).alias("b"))
    assert [x[0] for x in edge.collect()] == [min(14, int(k / 15 * 15 + 1e-12)) for k in range(16)]


def brute_labels(codes):
    up = {}
    for c, p in IS_A:
        up.setdefault(c, []).append(p)
    nodes = sorted({x for e in IS_A for x in e})
    depth = lambda n: 1 + depth(up[n][0]) if n in up else 0
    order = sorted(nodes, key=lambda n: -depth(n))
    value = {n: {1: 1, 0: 0, 9: 0}.get(codes[n]) for n in nodes}
    for n in order:
        for p in up.get(n, []):
            if value[n] == 1:
                value[p] = 1
    unsure = {n: codes[n] == -1 for n in nodes}
    for n in order:
        for p in up.get(n, []):
            if unsure[n] and codes[p] == 9 and value[p] == 0:
                value[p], unsure[p] = None, True
    return value


def test_label_rules(spark):
    import random

    r = random.Random(1)
    nodes = sorted({x for e in IS_A for x in e})
    all_codes = {e: {n: r.choice([1, 0, -1, 9, 9, 9, -9]) for n in nodes} for e in range(60)}
    df = spark.createDataFrame([(e, n, c) for e, m in all_codes.items() for n, c in m.items()], "entity int, node string, code int")
    got = {(x.entity, x.node): x.label for x in ontology.close_labels(df, IS_A).collect()}
    assert got == {(e, n): v for e, m in all_codes.items() for n, v in brute_labels(m).items()}


def test_ontology_validator():
    nodes = [{"id": "a", "label": "A"}, {"id": "b", "label": "B"}]
    ontology.validate(nodes, [{"id": 1, "child": "a", "parent": "b"}])
    for bad_nodes, bad_links in [
        (nodes, [{"id": 1, "child": "a", "parent": "c"}]), (nodes, [{"id": 1, "child": "a", "parent": "b"}, {"id": 2, "child": "b", "parent": "a"}]),
        ([*nodes, {"id": "a", "label": "X"}], []), ([{"id": "a"}], []),
    ]:
        with pytest.raises(ontology.OntologyError):
            ontology.validate(bad_nodes, bad_links)
    with pytest.raises(ontology.OntologyError):
        ontology.validate([{"id": "a", "label": "A", "side": "up"}], [], enums={"side": {"left", "right"}})


def test_bands_and_raise(spark):
    df = spark.createDataFrame([(0.7,), (0.69,), (0.4,), (0.2,), (0.3,), (None,), (float("nan"),)], "p double")
    b = df.select(decide.band(F.col("p"), F.lit(0.7), F.lit(0.4), F.lit(0.2)).alias("b"))
    assert [r[0] for r in b.collect()] == ["present", "possible", "possible", "absent", "silent", "silent", "silent"]
    none = F.lit(None).cast("double")
    assert df.select(decide.band(F.col("p"), none, none, none).alias("b")).distinct().collect()[0][0] == "silent"
    bands = spark.createDataFrame([(1, "pneumonia", "present"), (1, "consolidation", "absent"), (1, "lung_opacity", "silent"), (1, "any_abnormality", "absent"), (2, "any_abnormality", "absent"), (2, "edema", "silent")], "entity int, node string, band string")
    up = decide.raise_parents(bands, ontology.closure(ontology.links_frame(spark, IS_A)))
    assert {(r.entity, r.node): r.raised for r in up.collect()} == {(1, "pneumonia"): "present", (1, "consolidation"): "present", (1, "lung_opacity"): "present", (1, "any_abnormality"): "present", (2, "any_abnormality"): "absent", (2, "edema"): "silent"}
    assert {r.entity: r.normal for r in decide.normal_call(up, "any_abnormality", ["edema"], column="raised").collect()} == {1: False, 2: False}
    assert {r.entity: r.normal for r in decide.normal_call(up, "any_abnormality", [], column="raised").collect()} == {1: False, 2: True}


def test_audit_and_sides(spark):
    df = spark.createDataFrame([(1, None, "a", "b"), (2, None, "a", "a")], "k int, x string, y string, z string")
    assert rows(decide.audit(df, ["k"], [("D1", "band", "x", "y"), ("D2", "band", "y", "z")])) == [(1, 0, "D1", "band", None, "a"), (1, 1, "D2", "band", "a", "b"), (2, 0, "D1", "band", None, "a")]
    s = spark.createDataFrame([(0.6, 0.7), (0.6, 0.1), (None, 0.9), (0.1, None)], "l double, r double").select(decide.side_of(F.col("l"), F.col("r"), F.lit(0.5)))
    assert [r[0] for r in s.collect()] == ["bilateral", "left", None, None]
    x = spark.createDataFrame([(0.1, "PA", False), (0.1, "AP", True), (0.5, "PA", False), (0.1, "LATERAL", False), (None, "PA", False), (0.55, "PA", False), (0.9, None, False)], "x double, v string, f boolean").select(decide.image_side(F.col("x"), F.col("v"), F.col("f")))
    assert [r[0] for r in x.collect()] == ["right", "left", "midline", "unknown", "unknown", "left", "unknown"]


def test_nearest_is_exact_and_excludes_groups(spark):
    import numpy as np

    r = np.random.default_rng(0)
    v = np.round(r.normal(size=(60, 8)), 2)
    v[7] = v[3]
    g = [str(i % 4) for i in range(60)]
    df = spark.createDataFrame([(i, g[i], [float(x) for x in v[i]]) for i in range(60)], "i bigint, g string, v array<double>")
    got = {(x.query, x["rank"]): x.neighbour for x in vectors.nearest(df, df, "i", "g", "v", 3).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    for i in range(60):
        best = sorted((-s[i, j], j) for j in range(60) if g[j] != g[i])[:3]
        assert [got[i, k + 1] for k in range(3)] == [j for _, j in best]
    assert vectors.nearest(df.filter("false"), df, "i", "g", "v", 3).count() == 0
    assert vectors.nearest(df.filter("i < 2"), df.filter("i < 3"), "i", "g", "v", 3).count() == 4


def test_text(spark):
    df = spark.createDataFrame([(1, "EXAM: chest\r\nFINDINGS: No  edema.\nIMPRESSION:\nStable."), (2, "just text"), (3, ""), (4, None)], "k int, t string")
    s = {(r.k, r.pos): (r.header, r.body) for r in text.sections(df, ["k"], "t").collect()}
    assert s[1, 2] == ("FINDINGS", "No edema.") and s[1, 3] == ("IMPRESSION", "Stable.") and s[2, 0] == (None, "just text") and (3, 0) not in s
    more = df.unionByName(spark.createDataFrame([(5, "FINAL REPORT\nEXAM: chest\nHISTORY: cough\n Lungs clear."), (6, "IMPRESSION: ok"), (7, "FINDINGS:\nfine"), (8, "FINAL REPORT  body")], "k int, t string"))
    src = {r.k: (r.source, r.findings, r.impression) for r in text.section_source(more, ["k"], "t").collect()}
    assert src == {
        1: ("sections", "No edema.", "Stable."), 2: ("fallback", "just text", ""), 3: ("empty", "", ""), 5: ("fallback", "cough Lungs clear.", ""),
        6: ("impression_only", "", "ok"), 7: ("findings_only", "fine", ""), 8: ("fallback", "body", ""),
    }
    lat = spark.createDataFrame([("left base",), ("Left and right",), ("bilateral left",), ("midline",), ("base",), (None,)], "t string").select(text.laterality(F.col("t")))
    assert [r[0] for r in lat.collect()] == ["left", "bilateral", "bilateral", "midline", "unspecified", None]
    f = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], [])], "a array<string>, b array<string>").select(text.set_f1(F.col("a"), F.col("b")))
    assert [r[0] for r in f.collect()] == [0.5, 1.0]


def claims(spark, data):
    return spark.createDataFrame(data, "doc int, node string, certainty string, side string, zone string")


def test_corruption_is_always_caught(spark):
    s = claims(spark, [(i, n, "present", None, None) for i in range(5) for n in ("edema", "pneumonia")])
    none = spark.createDataFrame([], "node string, ancestor string")
    for how, kind in (("drop", "omitted"), ("negate", "polarity"), ("add_side", "side")):
        found = text.compare_claims(s, text.corrupt(s, how), none, ["doc"]).collect()
        assert len(found) == 10 and {r.kind for r in found} == {kind}
    assert text.compare_claims(s, s, none, ["doc"]).count() == 0


def test_claim_kinds(spark):
    e = claims(spark, [(1, "pneumonia", "present", "left", "lower"), (1, "edema", "absent", None, None), (2, "edema", "possible", None, None)])
    c = claims(spark, [(1, "pneumonia", "present", "right", None), (1, "lung_opacity", "present", None, None), (1, "edema", "present", "left", None), (2, "edema", "present", None, "upper"), (2, "fracture", "absent", None, None), (2, "mass", "possible", None, None)])
    tolerated = spark.createDataFrame([("pneumonia", "lung_opacity")], "node string, ancestor string")
    got = rows(text.compare_claims(e, c, tolerated, ["doc"], ["pneumonia"]))
    assert got == [(1, "edema", "polarity"), (1, "pneumonia", "side"), (1, "pneumonia", "zone"), (2, "edema", "certainty"), (2, "fracture", "added_negative"), (2, "mass", "added")]
    lobes = spark.createDataFrame([(1, "left lower lobe"), (2, "global")], "doc int, t string")
    assert rows(text.lobe_mentions(lobes, ["doc"], "t")) == [(1, None, "lobe")]


def test_regenerate(spark):
    def generate(left, attempt):
        return left.select("k", F.concat(F.lit("try "), F.lit(attempt), F.lit(" of "), F.col("k").cast("string")).alias("text"))

    def check(texts):  # the k-th row passes at the k-th attempt
        return texts.filter(~F.col("text").startswith(F.concat(F.lit("try "), F.col("k").cast("string")))).select("k", F.lit("wrong").alias("kind"))

    pending = spark.range(1, 6).withColumnRenamed("id", "k")
    out = text.regenerate(pending, ["k"], generate, check, pending.withColumn("text", F.lit("template")))
    assert rows(out) == [(1, "try 1 of 1", 1, "generated"), (2, "try 2 of 2", 2, "generated"), (3, "try 3 of 3", 3, "generated"), (4, "template", 3, "template"), (5, "template", 3, "template")]


def test_grounding(spark):
    z = spark.createDataFrame([("left_hemidiaphragm",), ("right_upper_abdomen",), ("left_mid_zone",), ("right_upper_lobe",), ("spine",), (None,)], "n string")
    assert [r[0] for r in z.select(decide.zone_of(F.col("n"))).collect()] == ["middle", "upper", "middle", None, None, None]
    assert [r[0] for r in z.select(decide.zone_of(F.col("n"), strict=True)).collect()] == [None, "upper", "middle", None, None, None]
    loc = spark.createDataFrame([(1, "pneumonia", "Left Lung", 0.9), (1, "pneumonia", "right lung", 0.4), (1, "pneumonia", "heart", 0.9), (1, "pneumonia", "moon", 0.9), (2, "pneumonia", "left lung", 0.6), (2, "pneumonia", "right lung", 0.6), (3, "other", "heart", 0.9)], "entity int, node string, region string, score double")
    places = spark.createDataFrame([("left lung", "left_lung"), ("right lung", "right_lung"), ("heart", "heart")], "region string, place string")
    pairs = ontology.closure(ontology.links_frame(spark, [("left_lung", "lungs"), ("right_lung", "lungs"), ("heart", "thorax"), ("lungs", "thorax")]), reflexive=True)
    sides = spark.createDataFrame([("left_lung", "left"), ("right_lung", "right")], "place string, side string")
    g = decide.ground(loc, places, pairs, sides, spark.createDataFrame([("pneumonia", "lungs")], "node string, place string"))
    assert g.count() == 7 and {(r.region, r.valid) for r in g.filter("node = 'pneumonia'").collect()} == {("left lung", True), ("right lung", True), ("heart", False), ("moon", False)}
    assert rows(decide.grounded_side(g)) == [(1, "pneumonia", "left"), (2, "pneumonia", "bilateral"), (3, "other", None)]


def test_statements(spark):
    n = [
        (1, "any_abnormality", "absent", None, None, None), (1, "lung_opacity", "present", "left", 0.9, "lower"), (1, "pneumonia", "present", "left", 0.9, "lower"), (1, "consolidation", "possible", None, None, None),
        (1, "edema", "absent", None, None, None), (1, "pneumothorax", "absent", None, None, None), (1, "fracture", "silent", None, None, None),
        (2, "lung_opacity", "present", "left", 0.7, "upper"), (2, "edema", "absent", None, None, None), (2, "cardiomegaly", "present", "right", 0.9, "upper"),
    ]
    nodes = spark.createDataFrame(n, "entity int, node string, band string, side string, side_conf double, zone string")
    got = {(r.entity, r.node): (r.rule, r.side, r.zone) for r in decide.statements(nodes, ontology.closure(ontology.links_frame(spark, IS_A)), ["any_abnormality"], ["pneumothorax"], {"edema": ["cardiomegaly"]}, ["lung_opacity", "pneumonia"]).collect()}
    assert got[1, "any_abnormality"][0] == "P3" and got[1, "fracture"][0] == "P3" and got[1, "edema"][0] == "P2" and got[1, "lung_opacity"] == ("P1", None, None)
    assert got[1, "pneumonia"] == (None, "left", "lower") and got[1, "pneumothorax"] == (None, None, None) and got[1, "consolidation"][0] == "P1"
    assert got[2, "edema"] == (None, None, None) and got[2, "lung_opacity"] == (None, None, None) and got[2, "cardiomegaly"] == (None, "right", None)
    best = spark.createDataFrame([(1, "a", "left", "lower", 0.5), (1, "a", "left", "upper", 0.5), (1, "a", "right", "middle", None)], "entity int, node string, side string, zone string, score double")
    assert rows(decide.best_zone(best)) == [(1, "a", "left", "upper", 0.5)]


def test_masks_and_boxes(spark):
    runs = vectors.run_lengths(spark.createDataFrame([(1, 10, "9 4 21 2"), (2, 10, ""), (3, 10, None)], "k int, w int, rle string"), "rle")
    m = vectors.mask_shape(runs, ["k"], "w").collect()
    assert len(m) == 1 and (m[0].area, m[0].x_min, m[0].x_max, m[0].y_min, m[0].y_max) == (6, 0, 9, 0, 2)
    b = spark.createDataFrame([(5.0, 0.0, 15.0, 10.0), (3.0, 3.0, 3.0, 9.0)], "x1 double, y1 double, x2 double, y2 double")
    assert rows(vectors.box_cells(b, 4, F.lit(40.0), F.lit(40.0)).select("cell_x", "cell_y", "share")) == [(0, 0, 0.5), (1, 0, 0.5)]


def test_fixpoint(spark):
    s = spark.createDataFrame([(1, "a", "left", 0.9), (1, "b", "unspecified", 0.5), (1, "a", "unspecified", 0.3), (2, "b", "left", 0.5)], "e int, node string, side string, score double")
    got = rows(fusion.fixpoint(s, "e", [fusion.valid_sides({"a"}), fusion.exclusive("a", "b"), fusion.subsume_unspecified]).select("e", "node", "side", "settled"))
    assert got == [(1, "a", "left", True), (2, "b", "unspecified", True)]
