"""Agreement, equivalence, self-retrieval, attempts and out-of-fold checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataform.functions.hashing import hash_bucket
from strataform.operators import metrics, model, vectors
from strataform.plans.base import SCORES_SQL, collector, scores
from strataform.plans.queries_decide import BANDS_SQL, banded
from strataform.plans.queries_fusion import features
from strataform.plans.queries_vectors import _E, _L, _NN, _RLE, embeddings, masks, neighbour_labels, neighbours
from strataform.runtime import table

QUERIES, ORACLE_SQL, query = collector()


@query(f"""WITH {_NN.format(k=5)}, {_L}, c AS (SELECT query, count(*) FILTER (WHERE label = 1) AS pos, count(label) AS known FROM nn LEFT JOIN l USING (neighbour) GROUP BY query), j AS (SELECT pos, known, o.label FROM c JOIN l o ON o.neighbour = query WHERE o.label IS NOT NULL AND known > 0)
SELECT pos, count(*) AS n, round(avg(((pos / known >= 0.5)::INT = label)::INT), 6) AS agreement, round(avg(label), 6) AS rate FROM j GROUP BY pos""")
def case_agreement(spark: SparkSession, d: str) -> DataFrame:
    labels = neighbour_labels(spark, d)
    c = vectors.case_evidence(neighbours(spark, d, 5), labels, 5)
    own = labels.filter("label is not null").select(F.col("neighbour").alias("query"), F.col("label"))
    j = c.join(own, "query").filter("known > 0")
    agree = ((F.col("pos") / F.col("known") >= 0.5).cast("int") == F.col("label")).cast("int")
    return j.groupBy("pos").agg(F.count("*").alias("n"), F.round(F.avg(agree), 6).alias("agreement"), F.round(F.avg("label"), 6).alias("rate"))


@query(f"""WITH {BANDS_SQL}, b AS (SELECT entity, node, CASE WHEN entity % 50 = 0 THEN p + 0.01 ELSE p END AS p, CASE WHEN entity % 70 = 0 THEN 'silent' ELSE band END AS band FROM bands WHERE entity % 90 <> 0)
SELECT count(*) FILTER (WHERE b.node IS NULL) AS only_a, count(*) FILTER (WHERE a.node IS NULL) AS only_b, count(*) FILTER (WHERE abs(a.p - b.p) > 1e-6) AS differ_p, count(*) FILTER (WHERE a.band <> b.band) AS differ_band FROM bands a FULL JOIN b ON a.entity = b.entity AND a.node = b.node""")
def equivalence_check(spark: SparkSession, d: str) -> DataFrame:
    a = banded(spark, d).select("entity", "node", "p", "band")
    e = F.col("entity")
    b = a.filter(e % 90 != 0).select("entity", "node", F.when(e % 50 == 0, F.col("p") + 0.01).otherwise(F.col("p")).alias("p"), F.when(e % 70 == 0, "silent").otherwise(F.col("band")).alias("band"))
    return metrics.equivalence(a, b, ["entity", "node"], ["p"], ["band"], 1e-6)


@query(f"WITH {_E} SELECT q.vec_id AS query, (SELECT c.vec_id FROM e c ORDER BY round(list_cosine_similarity(q.v, c.v), 6) DESC, c.vec_id LIMIT 1) = q.vec_id AS itself, true AS close FROM e q WHERE q.vec_id % 50 = 0")
def self_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """Whether every probe finds itself first, with a similarity of at least 0.999."""
    e = embeddings(spark, d).withColumn("label", F.lit(None).cast("string"))
    n = vectors.nearest(e.filter("vec_id % 50 = 0"), e, "vec_id", "label", "embedding", 1)
    return n.select("query", (F.col("query") == F.col("neighbour")).alias("itself"), (F.col("similarity") >= 0.999).alias("close"))


@query("""WITH i AS (SELECT user_id % 5 AS g, avg(value) - 60 - 10 AS low, avg(value) - 60 + 10 AS high FROM events GROUP BY user_id) SELECT g, count(*) FILTER (WHERE low > 0) AS better, count(*) FILTER (WHERE high < 0) AS worse, count(*) FILTER (WHERE low <= 0 AND high >= 0) AS unclear FROM i GROUP BY g""")
def variant_summary(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "events").groupBy("user_id").agg(F.avg("value").alias("m"))
    i = m.select((F.col("user_id") % 5).alias("g"), (F.col("m") - 60 - 10).alias("low"), (F.col("m") - 60 + 10).alias("high"))
    return metrics.variant_summary(i, ["g"])


@query("""WITH log AS (SELECT l_orderkey AS item, l_linenumber AS attempt, l_returnflag = 'N' AS passed, CASE WHEN l_linenumber >= 6 THEN 'template' ELSE 'generated' END AS source FROM lineitem),
p AS (SELECT item, bool_or(attempt = 1 AND passed) AS first, bool_or(source = 'template') AS fell, max(attempt) AS attempts FROM log GROUP BY item)
SELECT count(*) AS items, round(count(*) FILTER (WHERE first) / count(*), 6) AS first_pass, round(count(*) FILTER (WHERE NOT first AND NOT fell) / count(*), 6) AS regenerated, round(count(*) FILTER (WHERE fell) / count(*), 6) AS fallback, max(attempts) AS most_attempts FROM p""")
def attempt_log_summary(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber")
    log = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("item"), n.alias("attempt"), (F.col("l_returnflag") == "N").alias("passed"), F.when(n >= 6, "template").otherwise("generated").alias("source"))
    return metrics.attempt_summary(log).select("items", *[F.round(c, 6).alias(c) for c in ("first_pass", "regenerated", "fallback")], "most_attempts")


@query(f"""WITH {_RLE}, p AS (SELECT id, width, unnest(range(s0 - 1, s0 - 1 + l0)) AS i FROM (SELECT id, width, unnest(s) AS s0, unnest(l) AS l0 FROM r)), c AS (SELECT id, i // width AS y FROM p), x AS (SELECT id, min(y) AS top, max(y) + 1 AS bottom FROM c GROUP BY id)
SELECT id, CASE WHEN y < round_even(top + (bottom - top) * 1 / 3, 0) THEN 'upper' WHEN y < round_even(top + (bottom - top) * 2 / 3, 0) THEN 'middle' ELSE 'lower' END AS third, count(*) AS area FROM c JOIN x USING (id) GROUP BY ALL""")
def mask_thirds(spark: SparkSession, d: str) -> DataFrame:
    return vectors.mask_thirds(vectors.run_lengths(masks(spark, d), "rle"), ["id"], "width")


@query()
def oof_check(spark: SparkSession, d: str) -> DataFrame:
    """AUROC of out-of-fold scores on the fit rows against the rest: a large gap would show leakage."""
    f = model.standardise(features(spark, d), ["top", "n"], F.col("fit"))
    o = model.cross_fit(f, ["top", "n"], "y", "entity", F.col("fit"), 2).select("fit", "y", F.col("oof").alias("p"))
    return metrics.auroc(o, ["fit"]).select("fit", "n_pos", "n_neg", F.round("auroc", 4).alias("auroc"))


@query(f"""WITH {SCORES_SQL} SELECT node, count(*) AS n, count(*) FILTER (WHERE ('0x' || substr(sha256('inner:' || entity), 1, 8))::BIGINT % 20 = 0) AS inner_rows FROM scores GROUP BY node""")
def inner_holdout(spark: SparkSession, d: str) -> DataFrame:
    return scores(spark, d).groupBy("node").agg(F.count("*").alias("n"), F.count_if(hash_bucket("inner", F.col("entity"), 20) == 0).alias("inner_rows"))
