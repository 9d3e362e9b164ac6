"""Queries p9_: documents read with the wrong character encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strataform.llm.encoding import damaged_keys, judge_documents
from strataform.runtime import table


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with at least one damaged stretch."""
    return damaged_keys(table(spark, sf_dir, "documents"), "doc_id", "text", "source")


def p9_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged documents with their restored text, and whether nothing was lost."""
    return judge_documents(table(spark, sf_dir, "documents"), "doc_id", "text", "source").filter("damaged").select("doc_id", "restorable", "restored")


QUERIES = {"p9_found": p9_found, "p9_restored": p9_restored}
ORACLE_SQL: dict[str, str] = {}
