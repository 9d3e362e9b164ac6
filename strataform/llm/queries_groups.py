"""Queries p6_: the strongest concept contributions of every study and pathology."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataform.llm.topn import top_n_per_group
from strataform.runtime import table


def contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cbm_contributions with pathologies in one spelling and the size of each contribution."""
    name = F.regexp_replace(F.lower("pathology"), r"^\s+|\s+$", "")
    return table(spark, sf_dir, "cbm_contributions").select("study_id", F.regexp_replace(name, r"[\s_-]+", "_").alias("pathology"), "hit_id", F.abs("contribution").alias("size"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five rows with the largest absolute contribution of each study and pathology."""
    return top_n_per_group(contributions(spark, sf_dir), ["study_id", "pathology"], "size", "hit_id", 5).select("study_id", "pathology", "hit_id")


P6_FOUND_SQL = r"""
WITH r AS (
  SELECT DISTINCT study_id, regexp_replace(regexp_replace(lower(pathology), '^\s+|\s+$', '', 'g'), '[\s_-]+', '_', 'g') AS pathology,
         hit_id, abs(contribution) AS size
  FROM cbm_contributions
  WHERE study_id IS NOT NULL AND pathology IS NOT NULL AND contribution IS NOT NULL AND NOT isnan(contribution)
), k AS (SELECT *, row_number() OVER (PARTITION BY study_id, pathology ORDER BY size DESC, hit_id) AS rn FROM r)
SELECT study_id, pathology, hit_id FROM k WHERE rn <= 5
"""

QUERIES = {"p6_found": p6_found}
ORACLE_SQL = {"p6_found": P6_FOUND_SQL}
