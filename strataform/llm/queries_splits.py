"""Queries p1_: splits of study_records that keep subjects and studies whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataform.llm.components import broken_members, grouped_splits
from strataform.runtime import table

SHARES = {"train": 0.8, "validate": 0.1, "test": 0.1}
#: One subject may hold a tenth of the rows or more: groups above this share are placed first.
GIANT = 0.01


def split_name(column: str) -> F.Column:
    """train, validate or test from the first two letters; null for anything else."""
    head = F.substring(F.regexp_replace(F.lower(column), r"^[^a-z]+", ""), 1, 2)
    return F.when(head == "tr", "train").when(head == "va", "validate").when(head == "te", "test")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects whose group of linked subjects and studies has rows in more than one given split."""
    rows = table(spark, sf_dir, "study_records").select("subject_id", "study_id", split_name("split").alias("given"))
    return broken_members(rows, ["subject_id", "study_id"], "given")


def p1_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of study_records with its given and its new split."""
    rows = table(spark, sf_dir, "study_records").select("dicom_id", "subject_id", "study_id", split_name("split").alias("given_split"))
    return grouped_splits(rows, ["subject_id", "study_id"], "dicom_id", SHARES, GIANT)


P1_FOUND_SQL = r"""
WITH RECURSIVE r AS (
  SELECT subject_id, study_id,
         CASE substr(regexp_replace(lower(split), '^[^a-z]+', ''), 1, 2) WHEN 'tr' THEN 'train' WHEN 'va' THEN 'validate' WHEN 'te' THEN 'test' END AS given
  FROM study_records
), link AS (
  SELECT DISTINCT a.subject_id AS a, b.subject_id AS b FROM r a JOIN r b ON a.study_id = b.study_id
  WHERE a.subject_id IS NOT NULL AND b.subject_id IS NOT NULL AND a.subject_id <> b.subject_id
), reach(a, b) AS (
  SELECT DISTINCT subject_id, subject_id FROM r WHERE subject_id IS NOT NULL
  UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
), grp AS (SELECT a AS subject_id, min(b) AS g FROM reach GROUP BY a),
study AS (SELECT DISTINCT r.study_id, grp.g FROM r JOIN grp USING (subject_id) WHERE r.study_id IS NOT NULL),
rows_of AS (
  SELECT grp.g, r.given FROM r JOIN grp USING (subject_id)
  UNION ALL SELECT study.g, r.given FROM r JOIN study USING (study_id) WHERE r.subject_id IS NULL
), bad AS (SELECT g FROM rows_of GROUP BY g HAVING count(DISTINCT given) > 1)
SELECT subject_id FROM grp JOIN bad USING (g)
"""

QUERIES = {"p1_found": p1_found, "p1_splits": p1_splits}
ORACLE_SQL = {"p1_found": P1_FOUND_SQL}
