"""Queries cover the whole of their input: counts and brute force that a cut would change."""

import hashlib
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from strataform.plans import registry

SF = "/root/testdata/sf0.001"
QUERIES = registry.queries()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def test_masks_have_all_events(spark):
    e = spark.read.parquet(f"{SF}/events.parquet").select("user_id", "event_id").collect()
    pixels = {}
    for user, event in e:
        first = event % 40 * 97
        pixels.setdefault(user, []).extend(divmod(i, 100 + user % 50) for i in range(first, first + 1 + event % 60))
    assert QUERIES["rle_area"](spark, SF).agg(F.sum("runs")).first()[0] == len(e)
    areas = {r.id: r.area for r in QUERIES["rle_area"](spark, SF).collect()}
    assert areas == {u: len(p) for u, p in pixels.items()}
    shapes = {r.id: (r.area, r.x_min, r.x_max, r.y_min, r.y_max) for r in QUERIES["mask_shapes"](spark, SF).collect()}
    assert shapes == {u: (len(p), min(x for _, x in p), max(x for _, x in p), min(y for y, _ in p), max(y for y, _ in p)) for u, p in pixels.items()}
    thirds = {}
    for r in QUERIES["mask_thirds"](spark, SF).collect():
        thirds[r.id] = thirds.get(r.id, 0) + r.area
    assert thirds == areas


def test_bootstrap_has_all_replicates_and_pairs(spark):
    from strataform.operators import metrics
    from strataform.plans.base import scores, subjects
    from strataform.plans.queries_metrics import REPLICATES

    s = scores(spark, SF).join(subjects(spark, SF), "entity").filter("y is not null")
    got = {(r.node, r.replicate): r.auroc for r in metrics.bootstrap_auroc(s, ["node"], "subject", REPLICATES).collect()}
    assert {r for _, r in got} == set(range(2000))

    def weight(replicate, subject):
        u = int(hashlib.sha256(f"boot:{replicate}:{subject}".encode()).hexdigest()[:15], 16) / 16.0**15
        return next((k for k, edge in enumerate(metrics.POISSON_1) if u < edge), 6)

    rows = s.collect()
    for node in {r.node for r in rows}:
        mine = [r for r in rows if r.node == node]
        for replicate in (0, 19, 1999):
            w = {r.subject: weight(replicate, r.subject) for r in mine}
            pairs = [(w[a.subject] * w[b.subject], (a.p > b.p) + (a.p == b.p) / 2) for a in mine if a.y == 1 for b in mine if b.y == 0]
            total = sum(k for k, _ in pairs)
            assert got[node, replicate] == (pytest.approx(sum(k * v for k, v in pairs) / total) if total else None)
    names = sorted({r.node for r in rows})
    found = sorted((r.left, r.right) for r in QUERIES["paired_difference"](spark, SF).collect())
    assert found == [(a, b) for k, a in enumerate(names) for b in names[k + 1 :]]


def brute_isotonic(data):
    """Level and weight of each pool of (p, y) by pooling adjacent violators, as [lowest p, highest p, mean y]."""
    pools = []
    for p in sorted({p for p, _ in data}):
        ys = [y for q, y in data if q == p]
        pools.append([p, p, sum(ys), len(ys)])
        while len(pools) > 1 and pools[-2][2] / pools[-2][3] >= pools[-1][2] / pools[-1][3]:
            _, hi, y, n = pools.pop()
            pools[-1] = [pools[-1][0], hi, pools[-1][2] + y, pools[-1][3] + n]
    return [(lo, hi, y / n) for lo, hi, y, n in pools]


def test_every_node_is_calibrated(spark):
    from strataform.plans.base import scores

    known = {}
    for r in scores(spark, "/root/testdata/sf0.01").collect():
        known.setdefault(r.node, []).append((r.entity, r.p, r.y))
    got = {(r.entity, r.node): r.calibrated for r in QUERIES["isotonic_calibrated"](spark, "/root/testdata/sf0.01").collect()}
    assert got.keys() == {(e, n) for n, rows in known.items() for e, _, _ in rows} and len(known) > 1
    for node, rows in known.items():
        pools = brute_isotonic([(p, y) for _, p, y in rows if y is not None])
        for e, p, y in rows:
            if y is not None:
                assert got[e, node] == pytest.approx(next(v for lo, hi, v in pools if lo <= p <= hi), abs=1e-9), (node, p)


def test_logistic_fit_tries_the_whole_grid(spark, monkeypatch):
    from strataform.operators import model

    seen, fit = [], model.fit_logistic
    monkeypatch.setattr(model, "fit_logistic", lambda df, features, label, c, *a: seen.append(c) or fit(df, features, label, c, *a))
    QUERIES["logistic_fit"](spark, SF)
    assert set(model.GRID) <= set(seen) and model.GRID == (0.01, 0.1, 1.0, 10.0)


def test_manifest_has_every_file(spark):
    from pathlib import Path

    want = {p.name: (p.stat().st_size, hashlib.sha256(p.read_bytes()).hexdigest()) for p in Path(SF).iterdir()}
    assert {r.name: (r.length, r.sha256) for r in QUERIES["file_manifest"](spark, SF).collect()} == want and len(want) > 2


def test_cosine_scores_have_the_stated_set_in_blocks(spark, monkeypatch):
    from strataform.operators import vectors

    monkeypatch.setattr(vectors, "BLOCK", 3)
    e = {r.vec_id: np.array(r.embedding, dtype=float) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    got = {(r.left_id, r.right_id): r.similarity for r in QUERIES["cosine_scores"](spark, SF).collect()}
    right = [k for k in e if k % 50 == 0]
    assert len(right) > 8 and got.keys() == {(a, b) for a in e for b in right}
    assert all(v == pytest.approx(e[a] @ e[b] / np.linalg.norm(e[a]) / np.linalg.norm(e[b]), abs=2e-6) for (a, b), v in got.items())


def test_fractions_of_25_neighbours(spark):
    n = {(r["query"], r.k): r.n for r in QUERIES["knn_label_fraction"](spark, SF).select("query", "k", (F.col("n_known") <= F.col("k")).alias("n")).collect()}
    assert {k for _, k in n} == {5, 10, 25} and len(n) == 3 * len({q for q, _ in n}) and all(n.values())


def test_texts_have_the_whole_bank(spark):
    bank = spark.read.parquet(f"{SF}/concept_bank.parquet")
    pairs = bank.select(F.col("concept_id") % 300, "canonical_finding").distinct().count()
    assert QUERIES["render_template"](spark, SF).select(F.sum(F.size(F.split("text", r"\.")) - 1)).first()[0] == pairs
    faults = {r.fault: (r.flagged, r.statements) for r in QUERIES["corruption_detected"](spark, SF).collect()}
    assert faults["drop"] == faults["negate"] == (pairs, pairs) and faults["add_side"][0] == faults["add_side"][1]
    assert {"omitted", "polarity", "side", "added"} <= {r.kind for r in QUERIES["claim_compare"](spark, SF).collect()}


def test_descendants_sql_goes_deeper_than_120():
    from strataform.plans.queries_hierarchy import ORACLE_SQL

    c = duckdb.connect()
    c.execute("create table radlex_classes as select 'RID' || i as rid, ['RID' || (i - 1)] as is_a_parents, []::varchar[] as part_of from range(1, 200) t(i)")
    c.execute("insert into radlex_classes values ('RID150', ['RID151'], [])")
    c.execute("create table raw_classes as select rid, is_a_parents from radlex_classes where false")
    below = {(r[1], r[2]): r[3] for r in c.execute(ORACLE_SQL["p2_descendants"]).fetchall()}
    up = {(a, b) for b in range(200) for a in range(b)} | {(151, b) for b in (150, 151)} | {(150, 150)}
    assert below.keys() == {(f"RID{a}", f"RID{b}") for a, b in up} and below["RID0", "RID199"] == 199 and below["RID150", "RID150"] == 2


def test_bootstrap_in_small_parts(spark, monkeypatch):
    """Values, groups and clusters that cross the borders of parts and blocks change nothing, nor do null groups and clusters."""
    from strataform.operators import metrics

    r = np.random.default_rng(8)
    rows = [(["a", "b", None][i % 3], f"c{r.integers(9)}" if i % 10 else None, float(r.integers(4)) / 4, int(r.integers(2))) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, c string, p double, y int")
    monkeypatch.setattr(metrics, "FOLD_ROWS", 5)
    monkeypatch.setattr(metrics, "WEIGHT_BYTES", 20)
    got = {(x.g, x.replicate): x.auroc for x in metrics.bootstrap_auroc(df, ["g"], "c", 7).collect()}
    assert len(got) == 21
    weights = {c: metrics.poisson_weights([c], range(7))[0] for c in {x[1] for x in rows if x[1]}}
    for (g, k), auroc in got.items():
        mine = [(weights[c][k], p, y) for h, c, p, y in rows if h == g and c]
        won = sum(float(w) * v * ((p > q) + (p == q) / 2) for w, p, y in mine if y for v, q, z in mine if not z)
        total = sum(float(w) * v for w, _, y in mine if y for v, _, z in mine if not z)
        assert auroc == pytest.approx(won / total)
    assert metrics.bootstrap_auroc(df.filter("false"), ["g"], "c", 7).count() == 0
    assert metrics.bootstrap_auroc(df, [], "c", 3).count() == 3


def test_weights_are_those_of_the_hash():
    from strataform.operators import metrics

    def weight(replicate, cluster):
        u = int(hashlib.sha256(f"boot:{replicate}:{cluster}".encode()).hexdigest()[:15], 16) / 16.0**15
        return next((k for k, edge in enumerate(metrics.POISSON_1) if u < edge), 6)

    names = [str(i) for i in range(500)]
    assert metrics.poisson_weights(names, range(1990, 2000)).tolist() == [[weight(r, c) for r in range(1990, 2000)] for c in names]
    for edge, n in zip(metrics.POISSON_1, metrics._thresholds().tolist()):
        assert n / 16.0**15 >= edge > (n - 1) / 16.0**15


def test_interval_has_the_quantiles_of_the_sql(spark):
    """Bit by bit, so that ties of the last decimal round alike."""
    from strataform.operators import metrics

    r = np.random.default_rng(9)
    rows = [(g, float(v)) for g in range(40) for v in np.round(r.normal(size=200) * 20) / r.integers(3, 50) - np.round(r.normal(size=200) * 20) / r.integers(3, 50)]
    got = {x.g: (x.low, x.high) for x in metrics.interval(spark.createDataFrame(rows, "g int, v double"), ["g"], "v").collect()}
    con = duckdb.connect()
    for g, (low, high) in got.items():
        want = con.execute("select quantile_cont(v, 0.025), quantile_cont(v, 0.975) from (select unnest(?::double[]) v)", [[v for h, v in rows if h == g]]).fetchone()
        assert (low, high) == want
