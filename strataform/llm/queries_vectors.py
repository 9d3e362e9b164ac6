"""Queries p4_ and p5_: near-equal and most similar vectors of image_embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataform.llm.neighbours import most_similar
from strataform.llm.overlap import near_equal_across
from strataform.llm.queries_splits import split_name
from strataform.runtime import table

SIZE = 64


def image_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, split) of every image with a record and a split."""
    return table(spark, sf_dir, "study_records").select(F.col("dicom_id").alias("id"), split_name("split").alias("split")).filter("id is not null and split is not null").distinct()


def overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = image_splits(spark, sf_dir).select("id", F.when(F.col("split") == "train", "a").otherwise("b").alias("side"))
    return near_equal_across(table(spark, sf_dir, "image_embeddings"), sides, "dicom_id", "vector", SIZE, 0.98, "embedded_at")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a train and an evaluation image whose vectors have a cosine of at least 0.98."""
    pairs = overlaps(spark, sf_dir)
    return pairs.select(F.least("left_id", "right_id").alias("dicom_id_a"), F.greatest("left_id", "right_id").alias("dicom_id_b")).distinct()


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaking evaluation images and pairs of each split and origin (the checkpoint that embedded the image)."""
    origin = table(spark, sf_dir, "image_embeddings").filter("dicom_id is not null").groupBy(F.col("dicom_id").alias("right_id")).agg(F.max("checkpoint_name").alias("origin"))
    splits = image_splits(spark, sf_dir).filter("split <> 'train'").withColumnRenamed("id", "right_id")
    both = overlaps(spark, sf_dir).join(splits, "right_id").join(origin, "right_id", "left")
    return both.groupBy("split", "origin").agg(F.countDistinct("right_id").alias("images"), F.count("*").alias("pairs"))


def p5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar images of every image with similarity and rank."""
    found = most_similar(table(spark, sf_dir, "image_embeddings"), "dicom_id", "vector", SIZE, 5, "embedded_at")
    return found.withColumnRenamed("id", "dicom_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of images of which at least one is among the five most similar of the other."""
    found = p5_neighbours(spark, sf_dir)
    return found.select(F.least("dicom_id", "neighbour").alias("dicom_id_a"), F.greatest("dicom_id", "neighbour").alias("dicom_id_b")).distinct()


VALID_SQL = r"""
valid AS (
  SELECT DISTINCT dicom_id AS id, CAST(vector AS DOUBLE[]) AS v FROM image_embeddings
  WHERE dicom_id IS NOT NULL AND len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0
)
"""
_SIDES_SQL = """s AS (
  SELECT DISTINCT dicom_id AS id, CASE substr(regexp_replace(lower(split), '^[^a-z]+', ''), 1, 2) WHEN 'tr' THEN 'train' WHEN 'va' THEN 'validate' WHEN 'te' THEN 'test' END AS split FROM study_records
), r AS (SELECT * FROM valid JOIN s USING (id) WHERE split IS NOT NULL)"""
ORACLE_SQL = {
    "p4_found": f"""
WITH {VALID_SQL}, s AS (
  SELECT DISTINCT dicom_id AS id, CASE substr(regexp_replace(lower(split), '^[^a-z]+', ''), 1, 2) WHEN 'tr' THEN 1 WHEN 'va' THEN 0 WHEN 'te' THEN 0 END AS train FROM study_records
), r AS (SELECT * FROM valid JOIN s USING (id) WHERE train IS NOT NULL)
SELECT DISTINCT least(a.id, b.id) AS dicom_id_a, greatest(a.id, b.id) AS dicom_id_b FROM r a JOIN r b ON a.train = 1 AND b.train = 0
WHERE list_cosine_similarity(a.v, b.v) >= 0.98
""",
    "p5_found": f"""
WITH {VALID_SQL}, p AS (SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.v, b.v), 6) AS s FROM valid a JOIN valid b ON a.id <> b.id),
k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS n FROM p)
SELECT DISTINCT least(a, b) AS dicom_id_a, greatest(a, b) AS dicom_id_b FROM k WHERE n <= 5
""",
}
ORACLE_SQL["p4_report"] = f"""
WITH {VALID_SQL}, {_SIDES_SQL}, p AS (SELECT DISTINCT a.id AS l, b.id AS r, b.split FROM r a JOIN r b ON a.split = 'train' AND b.split <> 'train' AND a.id <> b.id AND list_cosine_similarity(a.v, b.v) >= 0.98),
o AS (SELECT dicom_id AS r, max(checkpoint_name) AS origin FROM image_embeddings WHERE dicom_id IS NOT NULL GROUP BY 1)
SELECT split, origin, count(DISTINCT r) AS images, count(*) AS pairs FROM p LEFT JOIN o USING (r) GROUP BY ALL
"""
ORACLE_SQL["p5_neighbours"] = f"""
WITH {VALID_SQL}, p AS (SELECT a.id AS dicom_id, b.id AS neighbour, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM valid a JOIN valid b ON a.id <> b.id),
k AS (SELECT *, row_number() OVER (PARTITION BY dicom_id ORDER BY similarity DESC, neighbour)::INT AS rank FROM p)
SELECT dicom_id, neighbour, similarity, rank FROM k WHERE rank <= 5
"""
QUERIES = {"p4_found": p4_found, "p4_report": p4_report, "p5_found": p5_found, "p5_neighbours": p5_neighbours}
