"""Readers and writers: tables written in a format within the query and read back, compared with the tables themselves."""

from __future__ import annotations

import gzip
import io
import json
import zipfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataform.plans.base import collector
from strataform.runtime import ensure_checkpoint_dir, table
from strataform.sources import files, sinks

QUERIES, ORACLE_SQL, query = collector()

_CUSTOMER = "c_custkey bigint, c_name string, c_nationkey bigint, c_mktsegment string"


def folder(spark: SparkSession) -> str:
    """A new name in the shared folder of checkpoints."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/files-{uuid4().hex}"


def put(spark: SparkSession, path: str, content: bytes) -> str:
    """Write one small file on whatever file system the path names."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p)
    out.write(bytearray(content))
    out.close()
    return path


def as_csv(spark: SparkSession, d: str, separator: str = ",", packed: bool = False) -> str:
    """The customers as delimited files with headers."""
    path = folder(spark)
    rows = table(spark, d, "customer").selectExpr("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    rows.write.csv(path, header=True, sep=separator, compression="gzip" if packed else "none")
    return path


def nations(spark: SparkSession, d: str) -> list[tuple]:
    """The nations, a table of fixed size."""
    return [tuple(r) for r in table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").orderBy("n_nationkey").collect()]


@query("SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer")
def csv_scan(spark: SparkSession, d: str) -> DataFrame:
    return files.delimited(spark, as_csv(spark, d, packed=True), _CUSTOMER)


@query("SELECT c_custkey, c_mktsegment FROM customer")
def csv_pruned(spark: SparkSession, d: str) -> DataFrame:
    return files.delimited(spark, as_csv(spark, d), _CUSTOMER, ["c_custkey", "c_mktsegment"])


@query("SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def csv_row_skipping(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    return files.delimited_where(spark, as_csv(spark, d), _CUSTOMER, keys, "c_nationkey").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")


@query("SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_nationkey::VARCHAR AS c_nationkey, c_mktsegment FROM customer")
def tsv_checked(spark: SparkSession, d: str) -> DataFrame:
    return files.delimited_checked(spark, as_csv(spark, d, "\t"), ["c_custkey", "c_mktsegment"])


def _archive(spark: SparkSession, d: str) -> str:
    """One archive with a text for each nation and a CSV of all."""
    data = io.BytesIO()
    rows = nations(spark, d)
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for k, name, region in rows:
            z.writestr(f"texts/{k}.txt", f"{name} in {region}\n")
        z.writestr("nations.csv", "key,name,region\n" + "".join(f"{k},{n},{r}\n" for k, n, r in rows))
    return put(spark, f"{folder(spark)}/all.zip", data.getvalue())


@query("SELECT 'texts/' || n_nationkey || '.txt' AS member, length(n_name || ' in ' || n_regionkey) + 1 AS size FROM nation UNION ALL SELECT 'nations.csv', 16 + sum(length(n_nationkey || ',' || n_name || ',' || n_regionkey) + 1)::BIGINT FROM nation")
def zip_listing(spark: SparkSession, d: str) -> DataFrame:
    return files.zip_members(spark, _archive(spark, d)).select("member", F.col("size").cast("bigint").alias("size"))


@query("SELECT 'texts/' || n_nationkey || '.txt' AS member, n_name || ' in ' || n_regionkey || chr(10) AS text FROM nation")
def zip_member_read(spark: SparkSession, d: str) -> DataFrame:
    return files.zip_texts(spark, _archive(spark, d), ".txt").select("member", "text")


@query("SELECT n_nationkey::VARCHAR AS key, n_name AS name FROM nation")
def csv_in_zip(spark: SparkSession, d: str) -> DataFrame:
    return files.zip_csv(spark, _archive(spark, d), "nations.csv", ["key", "name"]).select("key", "name")


@query("SELECT 'nations' AS what, n_nationkey AS key, n_name AS name FROM nation")
def nested_json(spark: SparkSession, d: str) -> DataFrame:
    text = json.dumps({"what": "nations", "rows": [{"key": k, "name": n} for k, n, _ in nations(spark, d)]})
    path = put(spark, f"{folder(spark)}/all.json.gz", gzip.compress(text.encode()))
    rows = files.json_nested(spark, path, "what string, rows array<struct<key:bigint,name:string>>", "rows")
    return rows.select("what", "item.key", "item.name")


@query("SELECT event_id, user_id, value FROM events")
def jsonl_scan(spark: SparkSession, d: str) -> DataFrame:
    path = folder(spark)
    table(spark, d, "events").select("event_id", "user_id", "value").write.json(path)
    return files.json_lines(spark, path, "event_id bigint, user_id bigint, value double")


@query("SELECT 'a' || i || '.txt' AS name, 3 + i AS length FROM range(4) t(i)")
def glob_listing(spark: SparkSession, d: str) -> DataFrame:
    at = folder(spark)
    for i in range(4):
        put(spark, f"{at}/a{i}.txt", b"abc" + b"d" * i)
    put(spark, f"{at}/b.csv", b"no")
    found = files.listing(spark, at, "*.txt")
    return found.select(F.substring_index("path", "/", -1).alias("name"), F.col("length").cast("bigint").alias("length"))


_GRAPHS = """g AS (SELECT graph, unnest(v) AS v FROM (SELECT concept_id AS graph, [coalesce(anatomy, 'lung') || '|yes|' || canonical_finding, coalesce(anatomy, 'lung') || '|' || CASE resolved_polarity WHEN 'absent' THEN 'no' ELSE 'yes' END || '|' || canonical_finding] AS v FROM concept_bank)),
u AS (SELECT DISTINCT graph, v FROM g)"""


def _graphs(spark: SparkSession, d: str) -> DataFrame:
    """A scene graph for each concept: a phrase with two strings (often the same) and a malformed one."""
    b = table(spark, d, "concept_bank")
    category = F.coalesce("anatomy", F.lit("lung"))
    strings = F.array(F.concat_ws("|", category, F.lit("yes"), "canonical_finding"), F.concat_ws("|", category, F.when(F.col("resolved_polarity") == "absent", "no").otherwise("yes"), "canonical_finding"), F.lit("malformed"))
    graph = F.struct(F.col("concept_id").cast("string").alias("image_id"), F.array(F.struct(F.col("laterality").alias("bbox_name"), F.lit(1.5).alias("x1"))).alias("objects"), F.array(F.struct(F.col("laterality").alias("bbox_name"), F.array(strings).alias("attributes"), F.array("text").alias("phrases"))).alias("attributes"))
    path = folder(spark)
    b.select(F.to_json(graph).alias("value")).write.text(path)
    return spark.read.text(path).select(F.lit("m").alias("member"), F.col("value").alias("text"))


@query(f"WITH {_GRAPHS} SELECT graph::VARCHAR AS image_id, string_split(v, '|')[1] AS category, string_split(v, '|')[3] AS label, count(*) FILTER (WHERE string_split(v, '|')[2] = 'yes') AS n_yes, count(*) FILTER (WHERE string_split(v, '|')[2] <> 'yes') AS n_no FROM u GROUP BY ALL")
def scene_graph_labels(spark: SparkSession, d: str) -> DataFrame:
    return files.scene_graphs(_graphs(spark, d))[1].select("image_id", "category", "label", "n_yes", "n_no")


@query("SELECT concept_id::VARCHAR AS image_id, 1::BIGINT AS n_objects, 1::BIGINT AS bad FROM concept_bank")
def scene_graph_figures(spark: SparkSession, d: str) -> DataFrame:
    return files.scene_graphs(_graphs(spark, d))[2].select("image_id", F.col("n_objects").cast("bigint").alias("n_objects"), F.col("bad_attr_strings").cast("bigint").alias("bad"))


@query("SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1")
def atomic_table(spark: SparkSession, d: str) -> DataFrame:
    """A table that replaces an older one which the new rows are read from."""
    path = folder(spark)
    sinks.write_table(table(spark, d, "orders").select(F.col("o_custkey").alias("k")), path)
    return sinks.write_table(spark.read.parquet(path).groupBy("k").agg(F.count("*").alias("n")), path)


@query("SELECT c_custkey AS k, c_custkey * 2 AS twice FROM customer")
def resumed_table(spark: SparkSession, d: str) -> DataFrame:
    """A table of which a part was there; only the rest is computed."""
    path, rows = folder(spark), table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    double = lambda df: df.withColumn("twice", F.col("k") * 2)
    sinks.resume(rows.filter("k < 500"), path, ["k"], double)
    return sinks.resume(rows, path, ["k"], double)


@query("SELECT c_custkey AS k, c_name AS name FROM customer")
def appended_lines(spark: SparkSession, d: str) -> DataFrame:
    path, rows = folder(spark), table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    sinks.append_json(rows.filter("k < 700"), path, ["k"])
    return sinks.append_json(rows, path, ["k"])
