"""Queries p7_: token ids of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strataform.llm.bpe import encode_texts
from strataform.runtime import table


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document's text by byte_bpe_50k."""
    return encode_texts(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES = {"p7_ids": p7_ids}
ORACLE_SQL: dict[str, str] = {}
