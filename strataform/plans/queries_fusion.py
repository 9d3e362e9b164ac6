"""Grouped concept scores, fused statements, fixpoints, diverse choices, models and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataform.functions.hashing import hash_bucket
from strataform.operators import fusion, model
from strataform.plans.base import HITS_SQL, SCORES_SQL, collector, hits, scores
from strataform.runtime import cut, table

QUERIES, ORACLE_SQL, query = collector()


def tagged(spark: SparkSession, d: str) -> DataFrame:
    """Hits with the tags of their concept (3,000 concepts at every scale)."""
    b = F.broadcast(table(spark, d, "concept_bank").select("concept_id", "laterality", "resolved_polarity", "group_key", "canonical_finding"))
    return hits(spark, d).join(b, "concept_id")


@query(f"""WITH {HITS_SQL}, g AS (SELECT entity, group_key, max(CASE WHEN resolved_polarity = 'present' THEN contribution END) AS present, max(CASE WHEN resolved_polarity = 'absent' THEN contribution END) AS absent FROM hits JOIN concept_bank USING (concept_id) GROUP BY ALL),
r AS (SELECT *, greatest(present, absent) AS best, row_number() OVER (PARTITION BY entity ORDER BY greatest(present, absent) DESC, group_key) AS rank FROM g WHERE greatest(present, absent) IS NOT NULL) SELECT entity, group_key, present, absent, best, rank FROM r WHERE rank <= 5""")
def concept_groups(spark: SparkSession, d: str) -> DataFrame:
    t = tagged(spark, d).select("entity", "group_key", F.col("resolved_polarity").alias("polarity"), F.col("contribution").alias("score"))
    return fusion.group_scores(t, "entity", "group_key", 5).select("entity", "group_key", "present", "absent", "best", "rank")


@query(f"""WITH {HITS_SQL}, v AS (SELECT entity, canonical_finding AS node, resolved_polarity AS polarity, CASE resolved_polarity WHEN 'present' THEN 3 WHEN 'absent' THEN 2 WHEN 'uncertain' THEN 1 END AS r FROM hits JOIN concept_bank USING (concept_id))
SELECT entity, node, arg_max(polarity, r) AS polarity FROM v WHERE r IS NOT NULL GROUP BY ALL""")
def priority_polarity(spark: SparkSession, d: str) -> DataFrame:
    v = tagged(spark, d).filter("resolved_polarity in ('present', 'absent', 'uncertain')").select("entity", F.col("canonical_finding").alias("node"), F.col("resolved_polarity").alias("polarity"))
    return fusion.priority_polarity(v, ["entity", "node"])


_L = "ln(greatest(least({0}, 1 - 1e-6), 1e-6) / (1 - greatest(least({0}, 1 - 1e-6), 1e-6)))"


@query(f"""WITH {SCORES_SQL}, e AS (SELECT entity, node, CASE WHEN ('0x' || substr(sha256('c:' || entity || node), 1, 8))::BIGINT % 2 = 0 THEN p END AS c, round((p + 0.5) / 2, 6) AS b, CASE WHEN ('0x' || substr(sha256('d:' || entity || node), 1, 8))::BIGINT % 3 = 0 THEN round(p * 0.8, 6) END AS d FROM scores)
SELECT entity, node, CASE WHEN c IS NOT NULL THEN 'C' ELSE 'B' END AS prior_source, floor(1 / (1 + exp(-({_L.format('coalesce(c, b)')} + CASE WHEN c IS NOT NULL THEN 0.5 * ({_L.format('b')} - {_L.format('0.1')}) ELSE 0 END + CASE WHEN d IS NOT NULL THEN 0.25 * ({_L.format('d')} - {_L.format('0.1')}) ELSE 0 END))) * 1000 + 0.137) AS confidence FROM e""")
def log_odds_fusion(spark: SparkSession, d: str) -> DataFrame:
    s = scores(spark, d)
    key = F.concat(F.col("entity").cast("string"), "node")
    parts = F.array_compact(F.array(
        F.when(hash_bucket("c", key, 2) == 0, F.struct(F.lit("C").alias("source"), F.col("p").alias("score"))),
        F.struct(F.lit("B").alias("source"), F.round((F.col("p") + 0.5) / 2, 6).alias("score")),
        F.when(hash_bucket("d", key, 3) == 0, F.struct(F.lit("D").alias("source"), F.round(F.col("p") * 0.8, 6).alias("score"))),
    ))
    e = s.select("entity", "node", F.explode(parts).alias("x")).select("entity", "node", "x.*")
    return fusion.fuse(e, ["entity", "node"], F.lit(0.1), {"B": 0.5, "D": 0.25}, ["C", "B"]).withColumn("confidence", F.floor(F.col("confidence") * 1000 + 0.137).cast("double"))


def sided(spark: SparkSession, d: str) -> DataFrame:
    return tagged(spark, d).select("entity", F.col("canonical_finding").alias("node"), F.col("laterality").alias("side"), F.round(F.abs("contribution"), 6).alias("score"))


@query(f"""WITH {HITS_SQL}, m AS (SELECT entity, canonical_finding AS node, max(CASE WHEN laterality = 'left' THEN abs(contribution) END) AS l, max(CASE WHEN laterality = 'right' THEN abs(contribution) END) AS r, max(CASE WHEN laterality = 'bilateral' THEN abs(contribution) END) AS b, max(CASE WHEN laterality = 'unspecified' THEN abs(contribution) END) AS u FROM hits JOIN concept_bank USING (concept_id) GROUP BY ALL)
SELECT entity, node, CASE WHEN b IS NOT NULL OR abs(l - r) <= 0.1 THEN 'bilateral' WHEN l >= coalesce(r, '-inf'::DOUBLE) THEN 'left' WHEN r IS NOT NULL THEN 'right' ELSE 'unspecified' END AS side, round(greatest(l, r, b, u), 6) AS score FROM m""")
def merged_sides(spark: SparkSession, d: str) -> DataFrame:
    return fusion.merge_sides(sided(spark, d), ["entity", "node"])


@query()
def rule_fixpoint(spark: SparkSession, d: str) -> DataFrame:
    """Statements of every study after exclusion and subsumption rules have settled."""
    rules = [fusion.valid_sides({"pneumonia", "consolidation", "atelectasis", "pleural_effusion", "pneumothorax"}), fusion.exclusive("pneumonia", "edema"), fusion.subsume_unspecified]
    return fusion.fixpoint(sided(spark, d), "entity", rules)


@query()
def diverse_choice(spark: SparkSession, d: str) -> DataFrame:
    """At most ten vectors of each label that are no more than 0.3 alike, greedily by score."""
    e = table(spark, d, "embeddings").withColumn("score", hash_bucket("s", F.col("vec_id"), 1000))
    return fusion.diverse(e, "label", "vec_id", "score", "embedding", 0.3, 10)


def features(spark: SparkSession, d: str) -> DataFrame:
    """One row a study: four features, a label and a cluster."""
    s = scores(spark, d)
    wide = s.groupBy("entity").agg(F.max("p").alias("top"), F.avg("p").alias("mean"), F.count("*").cast("double").alias("n"), F.max("y").alias("y"))
    miss = hash_bucket("missing", F.col("entity"), 9) == 0
    return wide.withColumn("mean", F.when(~miss, F.col("mean"))).withColumn("fit", hash_bucket("fit", F.col("entity"), 5) > 0)


_BUCKET = "('0x' || substr(sha256('{0}:' || entity), 1, 8))::BIGINT % {1}"
_FEATURES_SQL = f"""{SCORES_SQL}, wide AS (SELECT entity, max(p) AS top, avg(p) AS mean, count(*)::DOUBLE AS n, max(y) AS y FROM scores GROUP BY entity),
f AS (SELECT entity, top, CASE WHEN {_BUCKET.format("missing", 9)} <> 0 THEN mean END AS mean, n, y, {_BUCKET.format("fit", 5)} > 0 AS fit FROM wide)"""
_Z = ", ".join(f"round(coalesce(({c} - m_{c}) / (s_{c} + 1e-6), 0), 5) AS {c}" for c in ("top", "mean", "n"))
_S = ", ".join(f"avg({c}) FILTER (WHERE fit) AS m_{c}, stddev_pop({c}) FILTER (WHERE fit) AS s_{c}" for c in ("top", "mean", "n"))


@query(f"WITH {_FEATURES_SQL}, s AS (SELECT {_S} FROM f) SELECT entity, y, fit, {_Z}, 0 AS top_missing, (mean IS NULL)::INT AS mean_missing, 0 AS n_missing FROM f, s")
def standardised_features(spark: SparkSession, d: str) -> DataFrame:
    z = model.standardise(features(spark, d), ["top", "mean", "n"], F.col("fit"))
    return z.select("entity", "y", "fit", *[F.round(c, 5).alias(c) for c in ("top", "mean", "n")], "top_missing", "mean_missing", "n_missing")


@query()
def logistic_fit(spark: SparkSession, d: str) -> DataFrame:
    """Coefficients of the model of the best penalty and its score of every study, calibrated on the rest."""
    f = cut(model.standardise(features(spark, d), ["top", "mean", "n"], F.col("fit")))  # read by every fit
    m, c = model.fit_grid(f.filter("fit"), ["top", "mean", "n"], "y", "entity")
    scored = f.withColumn("z", m.score())
    platt = model.fit_platt(scored.filter("not fit"), "z", "y")
    return scored.select("entity", "y", F.round("z", 4).alias("z"), F.round(1 / (1 + F.exp(-platt.score())), 4).alias("p"), F.lit(c).alias("c"))


@query()
def cross_fitted(spark: SparkSession, d: str) -> DataFrame:
    f = model.standardise(features(spark, d), ["top", "n"], F.col("fit"))
    return model.cross_fit(f, ["top", "n"], "y", "entity", F.col("fit"), 5).select("entity", "fit", F.round("oof", 4).alias("oof"))


@query()
def isotonic_calibrated(spark: SparkSession, d: str) -> DataFrame:
    return model.isotonic(scores(spark, d), "node", "p", "y").select("entity", "node", "p", "calibrated")


@query()
def multinomial_sides(spark: SparkSession, d: str) -> DataFrame:
    b = tagged(spark, d).filter("laterality in ('left', 'right', 'bilateral')").select("hit_id", "laterality", "contribution", (F.col("concept_id") % 17).cast("double").alias("x"))
    out = model.fit_multinomial(b, ["contribution", "x"], "laterality")
    return b.select("hit_id", F.lit(None).cast("array<double>").alias("probabilities")) if out is None else out.select("hit_id", F.transform("probabilities", lambda p: F.round(p, 4)).alias("probabilities"))


@query(f"""WITH {SCORES_SQL}, w AS (SELECT entity, max(p) AS top, count(*) AS n FROM scores GROUP BY entity) SELECT entity, 'strength' AS "group", round(2 * top, 6) AS contribution FROM w UNION ALL SELECT entity, 'size', round(-0.1 * n, 6) FROM w UNION ALL SELECT entity, 'intercept', 0.5::DOUBLE FROM w""")
def score_contributions(spark: SparkSession, d: str) -> DataFrame:
    w = scores(spark, d).groupBy("entity").agg(F.max("p").alias("top"), F.count("*").alias("n"))
    c = model.Linear(["top", "n"], [2.0, -0.1], 0.5).contributions(w, "entity", {"strength": ["top"], "size": ["n"]})
    return c.select("entity", "group", F.round("contribution", 6).alias("contribution"))


@query(f"""WITH {SCORES_SQL}, s AS (SELECT node, sum((y = 1)::INT) AS pos, sum((y = 0)::INT) AS neg FROM scores GROUP BY node) SELECT entity, node, coalesce(y, 0) AS value, (y IS NOT NULL)::INT AS mask, round(neg / greatest(pos, 1), 6) AS pos_weight FROM scores JOIN s USING (node)""")
def masked_labels(spark: SparkSession, d: str) -> DataFrame:
    m = model.masked_weights(scores(spark, d), ["node"], "y")
    return m.select("entity", "node", "value", "mask", F.round("pos_weight", 6).alias("pos_weight"))


@query()
def file_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Name, length and SHA-256 of every file of the directory."""
    from strataform.sources.files import file_hashes

    return file_hashes(spark, d)
