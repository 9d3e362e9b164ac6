"""Queries p8_: documents that hold passages of evaluation items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataform.llm.leaks import find_leaks
from strataform.runtime import table


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the items of which they hold at least ten words in a row."""
    return find_leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text", 10)


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaking documents and leaked items of each source of documents and suite of items."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    items = table(spark, sf_dir, "eval_items").select("item_id", "suite", "split")
    both = p8_found(spark, sf_dir).join(docs, "doc_id").join(items, "item_id")
    return both.groupBy("source", "suite", "split").agg(F.countDistinct("doc_id").alias("documents"), F.countDistinct("item_id").alias("items"))


FOUND_SQL = r"""
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+') AS w FROM eval_items WHERE text IS NOT NULL),
dg AS (SELECT doc_id, array_to_string(w[k:k + 9], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 8)) AS k FROM d WHERE len(w) >= 10)),
ig AS (SELECT item_id, array_to_string(w[k:k + 9], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 8)) AS k FROM i WHERE len(w) >= 10)),
found AS (SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g))
"""
QUERIES = {"p8_found": p8_found, "p8_report": p8_report}
ORACLE_SQL = {
    "p8_found": f"WITH {FOUND_SQL} SELECT doc_id, item_id FROM found",
    "p8_report": f"""WITH {FOUND_SQL} SELECT source, suite, split, count(DISTINCT doc_id) AS documents, count(DISTINCT item_id) AS items
FROM found JOIN documents USING (doc_id) JOIN eval_items USING (item_id) GROUP BY source, suite, split""",
}
