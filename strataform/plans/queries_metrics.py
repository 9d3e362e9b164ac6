"""Ranking metrics, calibration, thresholds and intervals of the scores against the labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataform.operators import metrics
from strataform.plans.base import SCORES_SQL, SUBJECTS_SQL, collector, scores, subjects
from strataform.runtime import table

QUERIES, ORACLE_SQL, query = collector()


_AUROC_SQL = """SELECT {g}, round((sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2) / nullif(sum(y) * sum(1 - y), 0), 6) AS auroc FROM (
  SELECT *, rank() OVER (PARTITION BY {g} ORDER BY p) + (count(*) OVER (PARTITION BY {g}, p) - 1) / 2 AS r FROM {t} WHERE y IS NOT NULL) GROUP BY {g}"""


@query(f"WITH {SCORES_SQL} " + _AUROC_SQL.format(g="node", t="scores"))
def auroc_by_group(spark: SparkSession, d: str) -> DataFrame:
    return metrics.auroc(scores(spark, d), ["node"]).select("node", F.round("auroc", 6).alias("auroc"))


@query(f"""WITH {SCORES_SQL}, v AS (SELECT node, p, sum(y) AS pos, count(*) AS n FROM scores WHERE y IS NOT NULL GROUP BY node, p),
c AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS k FROM v WINDOW w AS (PARTITION BY node ORDER BY p DESC)) SELECT node, round(sum(pos * tp / k) / sum(pos), 6) AS auprc FROM c GROUP BY node""")
def average_precision(spark: SparkSession, d: str) -> DataFrame:
    return metrics.average_precision(scores(spark, d), ["node"]).select("node", F.round("auprc", 6).alias("auprc"))


_ECE_SQL = "least(greatest(floor(p * 15), 0), 14)"


@query(f"""WITH {SCORES_SQL}, b AS (SELECT node, {_ECE_SQL} AS bin, count(*) AS n, avg(y) AS my, avg(p) AS mp FROM scores WHERE y IS NOT NULL GROUP BY ALL) SELECT node, round(sum(n * abs(my - mp)) / sum(n), 6) AS ece FROM b GROUP BY node""")
def ece15(spark: SparkSession, d: str) -> DataFrame:
    return metrics.calibration_error(scores(spark, d), ["node"]).select("node", F.round("ece", 6).alias("ece"))


@query(f"WITH {SCORES_SQL} SELECT node, count(*) AS n, sum(y)::BIGINT AS pos, round(avg(y), 6) AS prevalence, round(avg((p - y) ** 2), 6) AS brier FROM scores WHERE y IS NOT NULL GROUP BY node")
def brier(spark: SparkSession, d: str) -> DataFrame:
    return metrics.brier(scores(spark, d), ["node"]).select("node", "n", "pos", F.round("prevalence", 6).alias("prevalence"), F.round("brier", 6).alias("brier"))


@query(f"""WITH {SCORES_SQL}, t(side, thr) AS (VALUES ('present', 0.7::DOUBLE), ('present', 0.4), ('absent', 0.2), ('absent', 0.05)),
c AS (SELECT node, side, thr, count(*) AS n, sum(y) AS pos, sum(1 - y) AS neg, count(*) FILTER (WHERE h) AS hits, coalesce(sum(y) FILTER (WHERE h), 0) AS hp, coalesce(sum(1 - y) FILTER (WHERE h), 0) AS hn FROM (
  SELECT *, CASE WHEN side = 'present' THEN p >= thr ELSE p <= thr END AS h FROM scores, t WHERE y IS NOT NULL) GROUP BY ALL)
SELECT node, side, thr, round(hits / n, 6) AS flagged, CASE WHEN side = 'present' THEN round(hp / greatest(pos, 1), 6) END AS sens, CASE WHEN side = 'present' THEN round((neg - hn) / greatest(neg, 1), 6) END AS spec,
CASE WHEN side = 'present' THEN round(hp / greatest(hits, 1), 6) END AS ppv, CASE WHEN side = 'absent' THEN round(hn / greatest(hits, 1), 6) END AS npv, CASE WHEN side = 'absent' THEN round(hn / greatest(neg, 1), 6) END AS spec_absent,
CASE WHEN side = 'absent' THEN round(hp / greatest(pos, 1), 6) END AS missed FROM c""")
def operating_point(spark: SparkSession, d: str) -> DataFrame:
    s = scores(spark, d)
    nodes = s.select("node").distinct()
    t = nodes.crossJoin(F.broadcast(spark.createDataFrame([("present", 0.7), ("present", 0.4), ("absent", 0.2), ("absent", 0.05)], "side string, thr double")))  # four rows a node
    o = metrics.operating_points(s, ["node"], t)
    return o.select("node", "side", "thr", *[F.round(c, 6).alias(c) for c in ("flagged", "sens", "spec", "ppv", "npv", "spec_absent", "missed")])


_CURVE_SQL = f"""{SCORES_SQL}, v AS (SELECT node, p, sum(y) AS pos, sum(1 - y) AS neg FROM scores WHERE y IS NOT NULL GROUP BY node, p),
curve AS (SELECT node, p, sum(pos) OVER d AS tp, sum(neg) OVER d AS fp, sum(pos) OVER a AS fn, sum(neg) OVER a AS tn, sum(pos) OVER (PARTITION BY node) AS all_pos FROM v WINDOW d AS (PARTITION BY node ORDER BY p DESC), a AS (PARTITION BY node ORDER BY p))"""


@query(f"WITH {_CURVE_SQL} SELECT node, t AS target, min(p) AS thr FROM curve, (VALUES (0.5::DOUBLE), (0.7), (0.9)) x(t) WHERE tp / (tp + fp) >= t AND tp >= 10 GROUP BY node, t")
def threshold_at_ppv(spark: SparkSession, d: str) -> DataFrame:
    c = metrics.curves(scores(spark, d), ["node"])
    out = None
    for t in (0.5, 0.7, 0.9):
        one = metrics.present_threshold(c, ["node"], t).withColumn("target", F.lit(t))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH {_CURVE_SQL} SELECT node, 'sens' AS kind, max(p) AS thr FROM curve WHERE tp / greatest(all_pos, 1) >= 0.9 GROUP BY node
UNION ALL SELECT node, 'npv', max(p) FROM curve WHERE tn / (tn + fn) >= 0.8 AND tn >= 10 GROUP BY node UNION ALL SELECT node, 'missed', max(p) FROM curve WHERE fn / greatest(all_pos, 1) <= 0.05 GROUP BY node""")
def threshold_at_miss(spark: SparkSession, d: str) -> DataFrame:
    c = metrics.curves(scores(spark, d), ["node"])
    parts = [metrics.sensitivity_threshold(c, ["node"], 0.9).withColumn("kind", F.lit("sens")), metrics.absent_threshold(c, ["node"], npv=0.8).withColumn("kind", F.lit("npv")), metrics.absent_threshold(c, ["node"], missed=0.05).withColumn("kind", F.lit("missed"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_VIEWS_SQL = "views AS (SELECT study_id AS entity, min(view_position) AS view FROM study_records WHERE study_id IS NOT NULL GROUP BY 1)"


@query(f"""WITH {SCORES_SQL}, {_VIEWS_SQL}, s AS (SELECT unnest(['all', view]) AS view, node, p, y FROM scores JOIN views USING (entity) WHERE view IN ('PA', 'AP')), r AS (
  SELECT *, rank() OVER (PARTITION BY view, node ORDER BY p) + (count(*) OVER (PARTITION BY view, node, p) - 1) / 2 AS r FROM s WHERE y IS NOT NULL)
SELECT view, node, count(*) AS n, round(avg((p - y) ** 2), 6) AS brier, round((sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2) / nullif(sum(y) * sum(1 - y), 0), 6) AS auroc FROM r GROUP BY view, node""")
def metrics_by_view(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "study_records").filter("study_id is not null").groupBy(F.col("study_id").alias("entity")).agg(F.min("view_position").alias("view")).filter("view in ('PA', 'AP')")
    s = scores(spark, d).join(v, "entity").withColumn("view", F.explode(F.array(F.lit("all"), "view")))
    return metrics.brier(s, ["view", "node"]).join(metrics.auroc(s, ["view", "node"]), ["view", "node"]).select("view", "node", "n", F.round("brier", 6).alias("brier"), F.round("auroc", 6).alias("auroc"))


#: The reference's number of resamples.
REPLICATES = 2000
_W_SQL = " ".join(f"WHEN u < {x!r} THEN {i}" for i, x in enumerate(metrics.POISSON_1))
_BOOT_SQL = f"""{SCORES_SQL}, {SUBJECTS_SQL}, reps AS (SELECT unnest(range({REPLICATES}))::INT AS replicate),
w AS (SELECT subject, replicate, CASE {_W_SQL} ELSE 6 END AS w FROM (SELECT subject, replicate, ('0x' || substr(sha256('boot:' || replicate || ':' || subject), 1, 15))::BIGINT / pow(16, 15) AS u FROM (SELECT DISTINCT subject FROM subjects), reps)),
v AS (SELECT node, replicate, p, sum(y * w) AS pos, sum((1 - y) * w) AS neg FROM scores JOIN subjects USING (entity) JOIN w USING (subject) WHERE y IS NOT NULL AND w > 0 GROUP BY ALL),
b AS (SELECT *, sum(neg) OVER (PARTITION BY node, replicate ORDER BY p) - neg AS before FROM v),
boot AS (SELECT node, replicate, sum(pos * (before + neg / 2)) / nullif(sum(pos) * sum(neg), 0) AS auroc FROM b GROUP BY node, replicate)"""


@query(f"WITH {_BOOT_SQL} SELECT node, round(avg(auroc), 6) AS mean, round(quantile_cont(auroc, 0.025), 6) AS low, round(quantile_cont(auroc, 0.975), 6) AS high FROM boot GROUP BY node")
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    s = scores(spark, d).join(subjects(spark, d), "entity")
    i = metrics.interval(metrics.bootstrap_auroc(s, ["node"], "subject", REPLICATES), ["node"], "auroc")
    return i.select("node", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high")])


@query(f"""WITH {_BOOT_SQL}, p AS (SELECT replicate, a.node AS "left", b.node AS "right", a.auroc - b.auroc AS diff FROM boot a JOIN boot b USING (replicate) WHERE a.node < b.node)
SELECT "left", "right", round(avg(diff), 6) AS mean, round(quantile_cont(diff, 0.025), 6) AS low, round(quantile_cont(diff, 0.975), 6) AS high, quantile_cont(diff, 0.025) > 0 OR quantile_cont(diff, 0.975) < 0 AS excludes_zero, quantile_cont(diff, 0.025) > -0.02 AS non_inferior FROM p GROUP BY ALL""")
def paired_difference(spark: SparkSession, d: str) -> DataFrame:
    s = scores(spark, d).join(subjects(spark, d), "entity")
    b = metrics.paired_differences(metrics.bootstrap_auroc(s, ["node"], "subject", REPLICATES), "node", "auroc")
    i = metrics.non_inferior(metrics.interval(b, ["left", "right"], "diff"), 0.02)
    return i.select("left", "right", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high")], "excludes_zero", "non_inferior")


@query(f"""WITH {SCORES_SQL}, t AS (SELECT entity, node FROM scores WHERE y = 1), c AS (SELECT entity, node FROM scores WHERE p >= 0.6),
f AS (SELECT coalesce(t.node, c.node) AS node, count(*) FILTER (WHERE t.node IS NOT NULL AND c.node IS NOT NULL) AS tp, count(*) FILTER (WHERE t.node IS NULL) AS fp, count(*) FILTER (WHERE c.node IS NULL) AS fn FROM t FULL JOIN c ON t.entity = c.entity AND t.node = c.node GROUP BY 1),
r AS (SELECT node, tp, fp, fn FROM f UNION ALL SELECT 'MICRO', sum(tp)::BIGINT, sum(fp)::BIGINT, sum(fn)::BIGINT FROM f),
m AS (SELECT *, tp / greatest(tp + fp, 1) AS p, tp / greatest(tp + fn, 1) AS r FROM r), x AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM m)
SELECT node, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1 FROM x UNION ALL SELECT 'MACRO', sum(tp)::BIGINT, sum(fp)::BIGINT, sum(fn)::BIGINT, round(avg(p), 6), round(avg(r), 6), round(avg(f1), 6) FROM x WHERE node <> 'MICRO'""")
def report_level_f1(spark: SparkSession, d: str) -> DataFrame:
    s = scores(spark, d)
    f = metrics.report_f1(s.filter("p >= 0.6"), s.filter("y = 1"), ["entity"])
    return f.select("node", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(f"""WITH {SCORES_SQL} SELECT node, CASE WHEN count(*) FILTER (WHERE y = 1 AND p >= 0.7) >= 10 THEN round(quantile_cont(p, 0.05) FILTER (WHERE y = 1 AND p >= 0.7), 4) END AS thr FROM scores GROUP BY node""")
def support_threshold_p5(spark: SparkSession, d: str) -> DataFrame:
    ok = (F.col("y") == 1) & (F.col("p") >= 0.7)
    per = scores(spark, d).groupBy("node").agg(F.count_if(ok).alias("n"), F.percentile(F.when(ok, F.col("p")), 0.05).alias("q"))
    return per.select("node", F.when(F.col("n") >= 10, F.round("q", 4)).alias("thr"))


@query(f"""WITH {SCORES_SQL}, {_VIEWS_SQL}, s AS (SELECT view, p, y FROM scores JOIN views USING (entity) WHERE node = 'cardiomegaly' AND view IS NOT NULL)
SELECT view, count(*) FILTER (WHERE y IS NOT NULL) AS n, round(median(p) FILTER (WHERE y = 1), 6) AS median_pos, round(median(p) FILTER (WHERE y = 0), 6) AS median_neg FROM s GROUP BY view""")
def ratio_alone(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "study_records").filter("study_id is not null").groupBy(F.col("study_id").alias("entity")).agg(F.min("view_position").alias("view")).filter("view is not null")
    s = scores(spark, d).filter("node = 'cardiomegaly'").join(v, "entity")
    return s.groupBy("view").agg(F.count("y").alias("n"), F.round(F.median(F.when(F.col("y") == 1, F.col("p"))), 6).alias("median_pos"), F.round(F.median(F.when(F.col("y") == 0, F.col("p"))), 6).alias("median_neg"))


@query(f"""WITH {SCORES_SQL}, q AS (SELECT entity, node, round(p * 1000) / 1000 AS q FROM scores) SELECT count(*) AS n, count(*) FILTER (WHERE abs(p - q) <= 1e-4) AS same, round(max(abs(p - q)), 6) AS worst FROM scores JOIN q USING (entity, node)""")
def reproduction_check(spark: SparkSession, d: str) -> DataFrame:
    s = scores(spark, d)
    stored = s.select("entity", "node", (F.round(F.col("p") * 1000) / 1000).alias("q"))
    diff = F.abs(F.col("p") - F.col("q"))
    return s.join(stored, ["entity", "node"]).agg(F.count("*").alias("n"), F.count_if(diff <= 1e-4).alias("same"), F.round(F.max(diff), 6).alias("worst"))
