"""Bands, parent raises, the normal call, audits and reports on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataform.operators import decide, metrics, ontology
from strataform.plans.base import CLOSURE_SQL, IS_A, LINKS_SQL, ROOT, SCORES_SQL, collector, links, scores
from strataform.plans.queries_metrics import _CURVE_SQL
from strataform.runtime import table

QUERIES, ORACLE_SQL, query = collector()
CRITICAL = ["pneumothorax", "pleural_effusion"]


def banded(spark: SparkSession, d: str) -> DataFrame:
    """entity, node, p, y, band with fixed thresholds; the root has no present or possible tier."""
    root = F.col("node") == ROOT
    b = decide.band(F.col("p"), F.when(~root, 0.7), F.when(~root, 0.4), F.lit(0.3))
    return scores(spark, d).withColumn("band", b)


BANDS_SQL = f"""{SCORES_SQL}, bands AS (SELECT *, CASE WHEN node <> 'any_abnormality' AND p >= 0.7 THEN 'present' WHEN p <= 0.3 THEN 'absent' WHEN node <> 'any_abnormality' AND p >= 0.4 THEN 'possible' ELSE 'silent' END AS band FROM scores)"""
_RANK = "CASE {} WHEN 'present' THEN 3 WHEN 'possible' THEN 2 WHEN 'silent' THEN 1 ELSE 0 END"
_RAISED_SQL = f"""{CLOSURE_SQL}, {BANDS_SQL}, best AS (SELECT entity, ancestor AS node, max({_RANK.format('band')}) AS best FROM bands JOIN (SELECT DISTINCT ancestor, descendant FROM closure) ON descendant = node WHERE band IN ('present', 'possible') GROUP BY ALL),
raised AS (SELECT b.entity, b.node, band, CASE WHEN best > {_RANK.format('band')} THEN CASE WHEN best = 3 THEN 'present' ELSE 'possible' END ELSE band END AS raised FROM bands b LEFT JOIN best USING (entity, node))"""


@query(f"WITH {BANDS_SQL} SELECT entity, node, band FROM bands")
def bands(spark: SparkSession, d: str) -> DataFrame:
    return banded(spark, d).select("entity", "node", "band")


@query(f"WITH {SCORES_SQL} SELECT entity, node, CASE WHEN node = 'fracture' THEN 'abstain' WHEN p >= 0.8 THEN 'accept' WHEN p <= 0.2 THEN 'reject' ELSE 'uncertain' END AS verdict, CASE WHEN p >= 0.8 THEN 'sure' WHEN p >= 0.5 THEN 'likely' ELSE 'unsure' END AS wording FROM scores")
def three_way_verdicts(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("p")
    return scores(spark, d).select("entity", "node", decide.three_way(p, F.lit(0.2), F.when(F.col("node") == "fracture", 1.0).otherwise(0.8)).alias("verdict"), decide.hedge(p).alias("wording"))


@query(f"WITH RECURSIVE {_RAISED_SQL} SELECT * FROM raised")
def parent_raise(spark: SparkSession, d: str) -> DataFrame:
    return decide.raise_parents(banded(spark, d).select("entity", "node", "band"), ontology.closure(links(spark)))


@query(f"""WITH RECURSIVE {_RAISED_SQL} SELECT entity, coalesce(bool_or(node = 'any_abnormality' AND raised = 'absent'), false) AND NOT bool_or(node IN ('pneumothorax', 'pleural_effusion') AND raised <> 'absent') AS normal FROM raised GROUP BY entity""")
def normal_call(spark: SparkSession, d: str) -> DataFrame:
    return decide.normal_call(parent_raise(spark, d), ROOT, CRITICAL, column="raised")


@query(f"""WITH RECURSIVE {_RAISED_SQL} SELECT entity, node, 0 AS seq, 'D1' AS rule, 'band' AS field, NULL AS before, band AS after FROM raised UNION ALL SELECT entity, node, 1, 'D2', 'band', band, raised FROM raised WHERE band <> raised""")
def audit_log(spark: SparkSession, d: str) -> DataFrame:
    r = parent_raise(spark, d).withColumn("none", F.lit(None).cast("string"))
    return decide.audit(r, ["entity", "node"], [("D1", "band", "none", "band"), ("D2", "band", "band", "raised")])


@query(f"""WITH {BANDS_SQL} SELECT node, band, count(*) AS n, count(*) FILTER (WHERE y = 1) AS pos, round(count(*) / sum(count(*)) OVER (PARTITION BY node), 6) AS share, round(count(*) FILTER (WHERE y = 1) / greatest(count(y), 1), 6) AS precision,
round(count(*) FILTER (WHERE y = 1) / greatest(sum(count(*) FILTER (WHERE y = 1)) OVER (PARTITION BY node), 1), 6) AS sensitivity FROM bands GROUP BY node, band""")
def band_report(spark: SparkSession, d: str) -> DataFrame:
    b = banded(spark, d)
    per = b.groupBy("node", "band").agg(F.count("*").alias("n"), F.count_if(F.col("y") == 1).alias("pos"), F.count("y").alias("known"))
    total = b.groupBy("node").agg(F.count("*").alias("tn"), F.count_if(F.col("y") == 1).alias("tp"))
    j = per.join(F.broadcast(total), "node")  # one row a node
    r = lambda a, c: F.round(F.col(a) / F.greatest(F.col(c), F.lit(1)), 6)
    return j.select("node", "band", "n", "pos", r("n", "tn").alias("share"), r("pos", "known").alias("precision"), r("pos", "tp").alias("sensitivity"))


@query(f"""WITH {_CURVE_SQL}, a AS (SELECT node, max(p) AS absent FROM curve WHERE fn / greatest(all_pos, 1) <= CASE WHEN node IN ('pneumothorax', 'any_abnormality') THEN 0.02 ELSE 0.05 END GROUP BY node)
SELECT node, CASE WHEN node <> 'any_abnormality' THEN 0.7::DOUBLE END AS present, CASE WHEN node <> 'any_abnormality' THEN 0.4::DOUBLE END AS possible, CASE WHEN node = 'any_abnormality' OR absent < 0.7 THEN absent END AS absent FROM (SELECT DISTINCT node FROM scores) LEFT JOIN a USING (node)""")
def four_band_fit(spark: SparkSession, d: str) -> DataFrame:
    s = scores(spark, d)
    root = F.col("node") == ROOT
    miss = F.when(F.col("node").isin("pneumothorax", ROOT), 0.02).otherwise(0.05)
    a = metrics.absent_threshold(metrics.curves(s, ["node"]), ["node"], missed=miss)
    j = s.select("node").distinct().join(a, "node", "left")
    return j.select("node", F.when(~root, 0.7).alias("present"), F.when(~root, 0.4).alias("possible"), F.when(root | (F.col("thr") < 0.7), F.col("thr")).alias("absent"))


@query(f"""WITH {BANDS_SQL}, t AS (SELECT DISTINCT node FROM bands) SELECT node FROM t WHERE node NOT IN (SELECT node FROM bands WHERE band = 'absent')""")
def empty_band_check(spark: SparkSession, d: str) -> DataFrame:
    b = banded(spark, d)
    return decide.empty_bands(b, b.select("node").distinct().withColumn("absent", F.lit(0.3)))


_SIDES_SQL = """sides AS (SELECT c.study_id AS entity, max(CASE WHEN laterality = 'left' THEN contribution END) AS l, max(CASE WHEN laterality = 'right' THEN contribution END) AS r
FROM cbm_contributions c JOIN concept_bank USING (concept_id) WHERE c.study_id IS NOT NULL AND NOT isnan(contribution) GROUP BY 1)"""


def supports(spark: SparkSession, d: str) -> DataFrame:
    """entity, l, r: the greatest contribution of a left and of a right concept of each study."""
    c = table(spark, d, "cbm_contributions").filter("study_id is not null and not isnan(contribution)").select("study_id", "concept_id", "contribution")
    b = F.broadcast(table(spark, d, "concept_bank").select("concept_id", "laterality"))  # 3,000 rows at every scale
    on = lambda s: F.max(F.when(F.col("laterality") == s, F.col("contribution")))
    return c.join(b, "concept_id").groupBy(F.col("study_id").alias("entity")).agg(on("left").alias("l"), on("right").alias("r"))


@query(f"WITH {_SIDES_SQL} SELECT entity, CASE WHEN l IS NULL OR r IS NULL THEN NULL WHEN l >= 0.5 AND r >= 0.5 THEN 'bilateral' WHEN l >= 0.5 THEN 'left' WHEN r >= 0.5 THEN 'right' END AS side FROM sides")
def region_side(spark: SparkSession, d: str) -> DataFrame:
    return supports(spark, d).select("entity", decide.side_of(F.col("l"), F.col("r"), F.lit(0.5)).alias("side"))


@query(f"""WITH {_SIDES_SQL}, s AS (SELECT entity, CASE WHEN l IS NULL OR r IS NULL THEN NULL WHEN l >= 0.5 AND r >= 0.5 THEN 'bilateral' WHEN l >= 0.5 THEN 'left' WHEN r >= 0.5 THEN 'right' END AS a, CASE WHEN l > r THEN 'left' WHEN r > l THEN 'right' END AS b FROM sides)
SELECT coalesce(CASE WHEN a = b THEN a END, 'none') AS kept, count(*) AS n FROM s GROUP BY 1""")
def side_agreement(spark: SparkSession, d: str) -> DataFrame:
    l, r = F.col("l"), F.col("r")
    a, b = decide.side_of(l, r, F.lit(0.5)), F.when(l > r, "left").when(r > l, "right")
    return supports(spark, d).select(F.coalesce(decide.withhold(a, b), F.lit("none")).alias("kept")).groupBy("kept").agg(F.count("*").alias("n"))


@query("""WITH x AS (SELECT dicom_id, view_position AS v, ('0x' || substr(sha256('x:' || dicom_id), 1, 15))::BIGINT / pow(16, 15) AS x FROM (SELECT DISTINCT dicom_id, view_position FROM study_records))
SELECT dicom_id, CASE WHEN v IS NULL OR v NOT IN ('PA', 'AP') THEN 'unknown' WHEN abs(x - 0.5) < 0.05 THEN 'midline' WHEN x > 0.5 THEN 'left' ELSE 'right' END AS side,
x > 0.02 AND coalesce(v = 'PA', false) AS reliable FROM x""")
def flip_side(spark: SparkSession, d: str) -> DataFrame:
    from strataform.functions.hashing import unit_hash

    r = table(spark, d, "study_records").select("dicom_id", F.col("view_position").alias("v")).distinct().withColumn("x", unit_hash("x", F.col("dicom_id")))
    rel = decide.ratio_reliability(F.when(F.col("x") > 0.02, F.col("x")), F.col("v"))
    return r.select("dicom_id", decide.image_side(F.col("x"), F.col("v"), F.lit(False)).alias("side"), rel["reliable"].alias("reliable"))


@query(f"""WITH {BANDS_SQL}, d AS (SELECT node, y, band AS before, CASE WHEN band = 'present' AND p < 0.8 THEN 'possible' ELSE band END AS after FROM bands)
SELECT node, count(*) FILTER (WHERE before = 'present') AS before, count(*) FILTER (WHERE after = 'present') AS after, count(*) FILTER (WHERE before <> after AND y = 0) AS good_demotions,
round(count(*) FILTER (WHERE after = 'present' AND y = 1) / greatest(count(*) FILTER (WHERE after = 'present' AND y IS NOT NULL), 1), 6) AS precision_after FROM d GROUP BY node""")
def rule_effect(spark: SparkSession, d: str) -> DataFrame:
    b = banded(spark, d).select("node", "y", F.col("band").alias("b"), decide.demote(F.col("band"), F.col("p"), F.lit(0.8)).alias("a"))
    after, y = F.col("a") == "present", F.col("y")
    return b.groupBy("node").agg(F.count_if(F.col("b") == "present").alias("before"), F.count_if(after).alias("after"), F.count_if((F.col("b") != F.col("a")) & (y == 0)).alias("good_demotions"), F.round(F.count_if(after & (y == 1)) / F.greatest(F.count_if(after & y.isNotNull()), F.lit(1)), 6).alias("precision_after"))


@query(f"""WITH RECURSIVE {_RAISED_SQL}, n AS (SELECT entity, coalesce(bool_or(node = 'any_abnormality' AND raised = 'absent'), false) AS normal FROM raised GROUP BY entity), t AS (SELECT entity, NOT bool_or(y = 1) AS truly FROM scores WHERE y IS NOT NULL GROUP BY entity)
SELECT count(*) AS n, round(count(*) FILTER (WHERE normal) / count(*), 6) AS call_rate, round(count(*) FILTER (WHERE normal AND truly) / greatest(count(*) FILTER (WHERE normal), 1), 6) AS precision, round(count(*) FILTER (WHERE normal AND truly) / greatest(count(*) FILTER (WHERE truly), 1), 6) AS sensitivity FROM n JOIN t USING (entity)""")
def normal_call_report(spark: SparkSession, d: str) -> DataFrame:
    n = decide.normal_call(parent_raise(spark, d), ROOT, [], column="raised")
    t = scores(spark, d).filter("y is not null").groupBy("entity").agg((~F.bool_or(F.col("y") == 1)).alias("truly"))
    r = lambda a, b: F.round(F.count_if(a) / F.greatest(F.count_if(b), F.lit(1)), 6)
    normal, truly = F.col("normal"), F.col("truly")
    return n.join(t, "entity").agg(F.count("*").alias("n"), r(normal, F.lit(True)).alias("call_rate"), r(normal & truly, normal).alias("precision"), r(normal & truly, truly).alias("sensitivity"))


@query(f"""WITH {LINKS_SQL}, {SCORES_SQL} SELECT coalesce(node, '-') AS node, coalesce(min(CASE WHEN y = 1 THEN p END), min(CASE WHEN y = 0 THEN p END)) AS thr, count(*) AS n FROM scores WHERE node IN (SELECT child FROM links) GROUP BY node""")
def threshold_picker(spark: SparkSession, d: str) -> DataFrame:
    known = [c for c, _ in IS_A]
    low = lambda v: F.min(F.when(F.col("y") == v, F.col("p")))
    return scores(spark, d).filter(F.col("node").isin(known)).groupBy("node").agg(F.coalesce(low(1), low(0)).alias("thr"), F.count("*").alias("n"))


# Names of regions with their places, and the places that hold others, for the queries on localisations.
REGIONS = [("right upper lung zone", "right_upper_zone"), ("left mid lung zone", "left_mid_zone"), ("left lower lobe", "left_lower_lobe"), ("cardiac silhouette", "heart"), ("right costophrenic angle", "right_costophrenic_angle"), ("spine", None)]
PARTS = [("right_upper_zone", "right_lung"), ("left_mid_zone", "left_lung"), ("left_lower_lobe", "left_lung"), ("right_costophrenic_angle", "right_lung"), ("right_lung", "lungs"), ("left_lung", "lungs"), ("lungs", "thorax"), ("heart", "thorax")]
ALLOWED = [("pneumonia", "lungs"), ("consolidation", "lungs"), ("cardiomegaly", "heart"), ("any_abnormality", "thorax")]
_REGIONS_SQL = "regions(i, region, place) AS (VALUES " + ", ".join(f"({i}, '{r}', {chr(39) + p + chr(39) if p else 'NULL'})" for i, (r, p) in enumerate(REGIONS)) + ")"
_PARTS_SQL = "parts(child, parent) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in PARTS) + ")"
_ALLOWED_SQL = "allowed(node, place) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in ALLOWED) + ")"


def grounded(spark: SparkSession, d: str) -> DataFrame:
    """Localisations of the scores: a region of each from a hash, with place, zone, side and validity."""
    from strataform.functions.hashing import hash_bucket

    names = F.array(*[F.lit(r) for r, _ in REGIONS])
    loc = scores(spark, d).select("entity", "node", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("k"), F.col("p").alias("score"))
    loc = loc.withColumn("region", F.concat(F.lit(" "), F.upper(names[hash_bucket("reg", F.concat_ws(":", F.col("entity").cast("string"), "node", "k"), len(REGIONS)).cast("int")])))
    places = spark.createDataFrame([x for x in REGIONS if x[1]], "region string, place string")
    pairs = ontology.closure(spark.createDataFrame(PARTS, "child string, parent string"), reflexive=True)
    sides = spark.createDataFrame([("right_lung", "right"), ("left_lung", "left")], "place string, side string")
    return decide.ground(loc.drop("k"), places, pairs, sides, spark.createDataFrame(ALLOWED, "node string, place string"))


_GROUND_SQL = f"""{SCORES_SQL}, {_REGIONS_SQL}, {_PARTS_SQL}, {_ALLOWED_SQL}, up(place, anc) AS (SELECT child, child FROM parts UNION SELECT parent, parent FROM parts UNION SELECT up.place, parent FROM up JOIN parts ON child = anc),
loc AS (SELECT entity, node, p AS score, region, r.place FROM scores, (VALUES ('a'), ('b')) k(k) JOIN regions r ON r.i = ('0x' || substr(sha256('reg:' || entity || ':' || node || ':' || k), 1, 8))::BIGINT % 6),
g AS (SELECT loc.*, CASE WHEN contains(place, 'lobe') OR contains(place, 'lingula') THEN NULL WHEN contains(place, 'upper') THEN 'upper' WHEN contains(place, 'mid') THEN 'middle' WHEN contains(place, 'lower') OR contains(place, 'costophrenic') THEN 'lower' END AS zone,
(SELECT replace(anc, '_lung', '') FROM up WHERE up.place = loc.place AND anc IN ('left_lung', 'right_lung')) AS side,
place IS NOT NULL AND (node NOT IN (SELECT node FROM allowed) OR EXISTS (SELECT 1 FROM up JOIN allowed a ON a.place = anc WHERE up.place = loc.place AND a.node = loc.node)) AS valid FROM loc)"""


@query(f"WITH RECURSIVE {_GROUND_SQL} SELECT node, region, place, zone, side, valid, count(*) AS n FROM g GROUP BY ALL")
def grounded_localisations(spark: SparkSession, d: str) -> DataFrame:
    return grounded(spark, d).groupBy("node", "region", "place", "zone", "side", "valid").agg(F.count("*").alias("n"))


@query(f"""WITH RECURSIVE {_GROUND_SQL}, s AS (SELECT entity, node, coalesce(bool_or(valid AND score >= 0.5 AND side = 'left'), false) AS l, coalesce(bool_or(valid AND score >= 0.5 AND side = 'right'), false) AS r FROM g GROUP BY ALL)
SELECT entity, node, CASE WHEN l AND r THEN 'bilateral' WHEN l THEN 'left' WHEN r THEN 'right' END AS side FROM s""")
def grounded_sides(spark: SparkSession, d: str) -> DataFrame:
    return decide.grounded_side(grounded(spark, d))


@query("""WITH s AS (SELECT c.study_id AS entity, canonical_finding AS node, laterality AS side, anatomy AS zone, max(contribution) AS score FROM cbm_contributions c JOIN concept_bank USING (concept_id)
WHERE c.study_id IS NOT NULL AND NOT isnan(contribution) AND laterality IN ('left', 'right') AND anatomy IN ('upper', 'middle', 'lower') GROUP BY ALL)
SELECT entity, node, side, zone, score FROM (SELECT *, row_number() OVER (PARTITION BY entity, node, side ORDER BY score DESC, CASE zone WHEN 'upper' THEN 0 WHEN 'middle' THEN 1 ELSE 2 END) AS n FROM s) WHERE n = 1""")
def best_zones(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "cbm_contributions").filter("study_id is not null and not isnan(contribution)").select(F.col("study_id").alias("entity"), "concept_id", "contribution")
    b = F.broadcast(table(spark, d, "concept_bank").filter("laterality in ('left', 'right') and anatomy in ('upper', 'middle', 'lower')").select("concept_id", F.col("canonical_finding").alias("node"), F.col("laterality").alias("side"), F.col("anatomy").alias("zone")))
    return decide.best_zone(c.join(b, "concept_id").groupBy("entity", "node", "side", "zone").agg(F.max("contribution").alias("score")))


_ALWAYS = ["pneumothorax", "pleural_effusion", "consolidation", "cardiomegaly"]


@query(f"""WITH RECURSIVE {CLOSURE_SQL}, {BANDS_SQL}, n AS (SELECT *, CASE WHEN band = 'present' THEN 2 WHEN band = 'possible' THEN 1 END AS sure FROM bands),
b AS (SELECT entity, ancestor AS node, max(sure) AS below FROM n JOIN (SELECT DISTINCT ancestor, descendant FROM closure) ON descendant = node WHERE sure IS NOT NULL AND node <> 'any_abnormality' GROUP BY ALL), t AS (SELECT DISTINCT entity FROM n WHERE band = 'present' AND node IN ('cardiomegaly', 'pleural_effusion'))
SELECT n.entity, n.node, CASE WHEN band = 'silent' OR n.node = 'any_abnormality' THEN 'P3' WHEN sure IS NOT NULL AND below >= sure THEN 'P1' WHEN band = 'absent' AND NOT (n.node IN ('pneumothorax', 'pleural_effusion', 'consolidation', 'cardiomegaly') OR n.node = 'edema' AND n.entity IN (SELECT entity FROM t)) THEN 'P2' END AS rule FROM n LEFT JOIN b ON b.entity = n.entity AND b.node = n.node""")
def licensed_statements(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("string")
    nodes = banded(spark, d).select("entity", "node", "band", none.alias("side"), F.lit(None).cast("double").alias("side_conf"), none.alias("zone"))
    s = decide.statements(nodes, ontology.closure(links(spark)), [ROOT], _ALWAYS, {"edema": ["cardiomegaly", "pleural_effusion"]}, ["pneumonia"])
    return s.select("entity", "node", "rule")
