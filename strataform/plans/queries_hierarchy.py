"""Queries p2_: the hierarchies of radlex_classes and raw_classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataform.operators.hierarchy import ancestor_pairs, cycle_cases, root_paths
from strataform.runtime import table


def class_id(column: str | F.Column) -> F.Column:
    """RID plus digits, whatever the case, padding or prefix; null if there is no such id."""
    digits = F.regexp_extract(column, r"(?i)rid\s*(\d+)\s*$", 1)
    return F.when(digits != "", F.concat(F.lit("RID"), digits))


def class_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(child, parent), each as relation|id: is_a of both tables together, part_of of radlex_classes."""

    def of(name: str, column: str, rel: str) -> DataFrame:
        one = table(spark, sf_dir, name).select(class_id("rid").alias("c"), F.explode(column).alias("p"))
        key = lambda x: F.concat(F.lit(f"{rel}|"), x)
        return one.select(key(F.col("c")).alias("child"), key(class_id("p")).alias("parent"))

    return of("radlex_classes", "is_a_parents", "is_a").unionByName(of("raw_classes", "is_a_parents", "is_a")).unionByName(of("radlex_classes", "part_of", "part_of"))


def _named(column: str) -> list[F.Column]:
    return [F.substring_index(column, "|", 1).alias("rel_type"), F.substring_index(column, "|", -1).alias("rid")]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes on a cycle or under one, for each relation."""
    return cycle_cases(class_links(spark, sf_dir)).select(*_named("node"), "case_kind")


def p2_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every class of a relation and every root above it: depth and path from the root, joined by >."""
    found = root_paths(class_links(spark, sf_dir))
    ids = F.transform("path", lambda x: F.substring_index(x, "|", -1))
    return found.select(*_named("node"), F.substring_index("root", "|", -1).alias("root"), "depth", F.array_join(ids, ">").alias("path"))


def p2_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All descendants of every class of a relation with the least number of links between."""
    pairs = ancestor_pairs(class_links(spark, sf_dir))
    return pairs.select(*_named("ancestor"), F.substring_index("descendant", "|", -1).alias("descendant"), "distance")


LINKS_SQL = r"""
raw_links AS (
  SELECT 'is_a' AS rel_type, rid AS c, unnest(is_a_parents) AS p FROM radlex_classes
  UNION ALL SELECT 'is_a', rid, unnest(is_a_parents) FROM raw_classes
  UNION ALL SELECT 'part_of', rid, unnest(part_of) FROM radlex_classes
), ids AS (
  SELECT rel_type, 'RID' || nullif(regexp_extract(c, '(?i)rid\s*(\d+)\s*$', 1), '') AS child, 'RID' || nullif(regexp_extract(p, '(?i)rid\s*(\d+)\s*$', 1), '') AS parent FROM raw_links
), links AS (SELECT DISTINCT * FROM ids WHERE child IS NOT NULL AND parent IS NOT NULL)
"""

ORACLE_SQL = {
    "p2_found": f"""
WITH RECURSIVE {LINKS_SQL}, up(rel_type, a, b) AS (
  SELECT rel_type, child, parent FROM links
  UNION SELECT up.rel_type, up.a, links.parent FROM up JOIN links ON links.rel_type = up.rel_type AND links.child = up.b
), cyc AS (SELECT DISTINCT rel_type, a FROM up WHERE a = b)
SELECT rel_type, a AS rid, 'on_cycle' AS case_kind FROM cyc
UNION ALL
SELECT DISTINCT up.rel_type, up.a, 'below_cycle' FROM up JOIN cyc ON cyc.rel_type = up.rel_type AND cyc.a = up.b
WHERE NOT EXISTS (SELECT 1 FROM cyc c WHERE c.rel_type = up.rel_type AND c.a = up.a)
""",
    "p2_paths": f"""
WITH RECURSIVE {LINKS_SQL}, roots AS (SELECT DISTINCT rel_type, parent AS r FROM links p WHERE NOT EXISTS (SELECT 1 FROM links c WHERE c.rel_type = p.rel_type AND c.child = p.parent)),
walk(rel_type, rid, root, path) AS (
  SELECT rel_type, r, r, [r] FROM roots
  UNION ALL SELECT w.rel_type, l.child, w.root, list_append(w.path, l.child) FROM walk w JOIN links l ON l.rel_type = w.rel_type AND l.parent = w.rid
  WHERE NOT list_contains(w.path, l.child)
), best AS (SELECT *, row_number() OVER (PARTITION BY rel_type, rid, root ORDER BY len(path), path) AS n FROM walk)
SELECT rel_type, rid, root, CAST(len(path) - 1 AS INT) AS depth, array_to_string(path, '>') AS path FROM best WHERE n = 1
""",
    "p2_descendants": f"""
WITH RECURSIVE {LINKS_SQL}, down(rel_type, a, d, n) USING KEY (rel_type, a, d) AS (
  SELECT rel_type, parent, child, 1 FROM links
  UNION SELECT w.rel_type, w.a, l.child, min(w.n) + 1 FROM down w JOIN links l ON l.rel_type = w.rel_type AND l.parent = w.d
  WHERE NOT EXISTS (SELECT 1 FROM recurring.down v WHERE v.rel_type = w.rel_type AND v.a = w.a AND v.d = l.child) GROUP BY ALL
)
SELECT rel_type, a AS rid, d AS descendant, CAST(min(n) AS INT) AS distance FROM down GROUP BY rel_type, a, d
""",
}
QUERIES = {"p2_found": p2_found, "p2_paths": p2_paths, "p2_descendants": p2_descendants}
