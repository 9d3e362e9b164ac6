"""Views that several queries share, each with the same view in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataform.functions.hashing import hash_bucket, unit_hash
from strataform.runtime import table


def collector() -> tuple[dict, dict[str, str], Callable]:
    """A module's queries and their SQL by name, and the decorator that fills them."""
    queries: dict = {}
    sqls: dict[str, str] = {}

    def query(sql: str | None = None) -> Callable:
        def add(f: Callable) -> Callable:
            queries[f.__name__] = f
            if sql:
                sqls[f.__name__] = sql
            return f

        return add

    return queries, sqls, query


# The is_a links of the findings, in their declared order.
IS_A = [
    ("atelectasis", "lung_opacity"),
    ("consolidation", "lung_opacity"),
    ("edema", "lung_opacity"),
    ("lung_lesion", "lung_opacity"),
    ("pneumonia", "consolidation"),
    ("cardiomegaly", "enlarged_cardiomediastinum"),
    ("lung_opacity", "any_abnormality"),
    ("enlarged_cardiomediastinum", "any_abnormality"),
    ("pleural_effusion", "any_abnormality"),
    ("pleural_other", "any_abnormality"),
    ("pneumothorax", "any_abnormality"),
    ("fracture", "any_abnormality"),
]
ROOT = "any_abnormality"


def links(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(IS_A, "child string, parent string")


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usable contributions, each hit once: hit_id, entity (study), node (finding), concept_id, contribution."""
    name = F.regexp_replace(F.regexp_replace(F.lower("pathology"), r"^\s+|\s+$", ""), r"[\s_-]+", "_")
    rows = table(spark, sf_dir, "cbm_contributions").select("hit_id", F.col("study_id").alias("entity"), name.alias("node"), "concept_id", "contribution")
    return rows.filter("entity is not null and node is not null and contribution is not null and not isnan(contribution)").distinct()


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity, node, p and y: the sigmoid of summed contributions, and a label drawn from a hash (null for a tenth)."""
    z = hits(spark, sf_dir).groupBy("entity", "node").agg(F.round(F.sum("contribution"), 6).alias("z"))
    key = F.concat_ws(":", F.col("entity").cast("string"), "node")
    p = F.round(1 / (1 + F.exp(-F.col("z"))), 6)
    y = F.when(hash_bucket("mask", key, 10) > 0, F.when(unit_hash("label", key) < p, 1).otherwise(0))
    return z.select("entity", "node", p.alias("p"), y.alias("y"))


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity, node, code for every study and finding: a code of 1, 0, -1, 9 or -9 from a hash."""
    nodes = F.array(*[F.lit(n) for n in sorted({x for e in IS_A for x in e})])
    studies = table(spark, sf_dir, "study_records").filter("study_id is not null").select(F.col("study_id").alias("entity")).distinct()
    rows = studies.select("entity", F.explode(nodes).alias("node"))
    b = hash_bucket("code", F.concat_ws(":", F.col("entity").cast("string"), "node"), 20)
    return rows.select("entity", "node", F.when(b < 3, 1).when(b < 7, 0).when(b < 9, -1).when(b < 19, 9).otherwise(-9).alias("code"))


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity, subject: the smallest subject of every study."""
    r = table(spark, sf_dir, "study_records").filter("study_id is not null and subject_id is not null")
    return r.groupBy(F.col("study_id").alias("entity")).agg(F.min("subject_id").alias("subject"))


_VALUES = ", ".join(f"('{c}', '{p}')" for c, p in IS_A)
LINKS_SQL = f"links(child, parent) AS (VALUES {_VALUES})"
CLOSURE_SQL = f"""{LINKS_SQL}, closure(ancestor, descendant, distance) AS (
  SELECT parent, child, 1 FROM links UNION SELECT l.parent, c.descendant, c.distance + 1 FROM closure c JOIN links l ON l.child = c.ancestor
)"""
UNIT_SQL = "('0x' || substr(sha256({0}), 1, 15))::BIGINT / pow(16, 15)"
BUCKET_SQL = "('0x' || substr(sha256({0}), 1, 8))::BIGINT % {1}"
HITS_SQL = r"""hits AS (
  SELECT DISTINCT hit_id, study_id AS entity, regexp_replace(regexp_replace(lower(pathology), '^\s+|\s+$', '', 'g'), '[\s_-]+', '_', 'g') AS node, concept_id, contribution
  FROM cbm_contributions WHERE study_id IS NOT NULL AND pathology IS NOT NULL AND contribution IS NOT NULL AND NOT isnan(contribution)
)"""
SCORES_SQL = f"""{HITS_SQL}, summed AS (SELECT entity, node, round(sum(contribution), 6) AS z FROM hits GROUP BY entity, node),
probs AS (SELECT entity, node, round(1 / (1 + exp(-z)), 6) AS p FROM summed),
scores AS (SELECT entity, node, p, CASE WHEN {BUCKET_SQL.format("'mask:' || entity || ':' || node", 10)} > 0 THEN
  CASE WHEN {UNIT_SQL.format("'label:' || entity || ':' || node")} < p THEN 1 ELSE 0 END END AS y FROM probs)"""
CODES_SQL = f"""{LINKS_SQL}, nodes AS (SELECT child AS node FROM links UNION SELECT parent FROM links),
codes AS (SELECT entity, node, CASE WHEN b < 3 THEN 1 WHEN b < 7 THEN 0 WHEN b < 9 THEN -1 WHEN b < 19 THEN 9 ELSE -9 END AS code FROM (
  SELECT entity, node, {BUCKET_SQL.format("'code:' || entity || ':' || node", 20)} AS b FROM (SELECT DISTINCT study_id AS entity FROM study_records WHERE study_id IS NOT NULL), nodes))"""
SUBJECTS_SQL = "subjects AS (SELECT study_id AS entity, min(subject_id) AS subject FROM study_records WHERE study_id IS NOT NULL AND subject_id IS NOT NULL GROUP BY study_id)"
