"""Queries p3_: belief_graphs as flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataform.operators.nested import Child, Element, flat_table, inline_plan, json_objects, schema_paths, shred
from strataform.runtime import table

ROOT = "graph"
GRAPH = {
    e.name: e
    for e in [
        Element("graph", {"study_id": "bigint", "no_acute_abnormality": "boolean"}, None, [Child("nodes", "node", "map", single="finding"), Child("audit", "audit"), Child("fused", "fused"), Child("edges", "edge"), Child("cases", "cases", "one")]),
        Element("node", {"finding": "string", "prob": "double", "band": "string", "side": "string", "side_conf": "double"}, "finding", [Child("anatomy", "anatomy"), Child("contributions", "contribution", "pairs", single="group", name="group"), Child("ctr", "ctr", "one")]),
        Element("ctr", {"ctr": "double", "reliable": "boolean", "note": "string"}),
        Element("anatomy", {"zone": "string", "side": "string", "score": "double", "source": "string"}, None, [Child("part_of", "part_of")]),
        Element("part_of", {"node": "string"}, None, [Child("part_of", "part_of")]),
        Element("contribution", {"value": "double"}),
        Element("audit", {"rule": "string", "target": "string", "field": "string", "before": "json", "after": "json", "reason": "string", "edge": "string"}, "rule"),
        Element("fused", {"finding": "string", "laterality": "string", "confidence": "double", "band": "string", "polarity": "string", "prior_source": "string", "admitted": "boolean"}, None, [Child("support", "support")]),
        Element("support", {"source": "string", "role": "string", "raw_score": "double", "calibrated": "double", "present_score": "double", "absent_score": "double", "present_support": "double", "absent_support": "double", "n_neighbours": "bigint"}, None, [Child("contributing_concepts", "concept")]),
        Element("concept", {"concept_id": "bigint", "contribution": "double", "text": "string"}, "concept_id"),
        Element("edge", {"type": "string", "id": "string", "child": "string", "parent": "string"}),
        Element("cases", {"nb_study_ids": "json", "nb_sims": "json"}),
    ]
}
PLAN = inline_plan(GRAPH, ROOT)


def last_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """graph_id and the payload last written; a null written_at is oldest, equal times go to the greater text. Rows without a graph_id are dropped."""
    rows = table(spark, sf_dir, "belief_graphs").filter("graph_id is not null")
    return rows.groupBy("graph_id").agg(F.max_by("payload", F.struct(F.col("written_at").isNotNull(), "written_at", F.coalesce("payload", F.lit("")))).alias("payload"))


def graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return json_objects(last_written(spark, sf_dir), "payload", "v")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each anatomy, contribution, audit entry, support and concept, with the key of its parent."""
    rows = shred(graphs(spark, sf_dir), "graph_id", "v", GRAPH, ROOT, {"anatomy", "contribution", "audit", "support", "concept"}, keep_values=False)
    own, above = F.try_element_at("keys", F.lit(-1)), F.try_element_at("keys", F.lit(-2))
    pos = F.try_element_at("pos", F.lit(-1)).cast("string")
    at = lambda i: F.element_at("pos", i).cast("string")
    e = F.col("element")
    parent = F.when(e == "audit", own).when(e == "support", at(1)).when(e == "concept", F.concat(at(1), F.lit("."), at(2))).otherwise(above)
    item = F.when(e.isin("contribution", "concept"), own).otherwise(pos)
    whole = F.when(e == "concept", F.coalesce(F.expr("cast(try_cast(trim(keys[size(keys) - 1]) AS bigint) AS string)"), item)).otherwise(item)
    return rows.select(F.col("doc_key").alias("graph_id"), e.alias("child_table"), parent.alias("parent_key"), whole.alias("item_key")).filter("child_table <> 'concept' or item_key is not null")


def p3_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of nodes, with the singleton ctr inlined."""
    return flat_table(shred(graphs(spark, sf_dir), "graph_id", "v", GRAPH, ROOT, {"node"}), PLAN["node"])


def p3_part_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recursive table of anatomy containers, each with the row that holds it."""
    return flat_table(shred(graphs(spark, sf_dir), "graph_id", "v", GRAPH, ROOT, {"part_of"}), PLAN["part_of"])


def p3_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every path of the payloads with the kinds of its values and their number, unknown keys included."""
    return schema_paths(graphs(spark, sf_dir), "v", {"nodes", "contributions"})


QUERIES = {"p3_found": p3_found, "p3_nodes": p3_nodes, "p3_part_of": p3_part_of, "p3_schema": p3_schema}
ORACLE_SQL: dict[str, str] = {}
