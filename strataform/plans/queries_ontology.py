"""Closures, label rules, marginals and mappings over the findings' ontology."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataform.operators import ontology
from strataform.plans.base import CLOSURE_SQL, CODES_SQL, IS_A, LINKS_SQL, SCORES_SQL, codes, collector, links, scores
from strataform.plans.queries_hierarchy import class_id
from strataform.runtime import table

QUERIES, ORACLE_SQL, query = collector()


@query(f"WITH RECURSIVE {CLOSURE_SQL} SELECT ancestor, descendant, min(distance)::INT AS distance FROM closure GROUP BY ancestor, descendant")
def closure_ancestors(spark: SparkSession, d: str) -> DataFrame:
    return ontology.closure(links(spark))


@query(f"""WITH RECURSIVE {LINKS_SQL}, d(node, depth) AS (SELECT DISTINCT parent, 0 FROM links WHERE parent NOT IN (SELECT child FROM links) UNION ALL SELECT child, depth + 1 FROM d JOIN links ON parent = node)
SELECT node, max(depth)::INT AS depth FROM d GROUP BY node""")
def topo_depth(spark: SparkSession, d: str) -> DataFrame:
    return ontology.depths(links(spark))


@query(f"""WITH RECURSIVE {LINKS_SQL}, w(node, top, path) AS (SELECT child, parent, child || '>' || parent FROM links UNION ALL SELECT node, parent, path || '>' || parent FROM w JOIN links ON child = top)
SELECT node, path FROM w WHERE top NOT IN (SELECT child FROM links)""")
def path_to_root(spark: SparkSession, d: str) -> DataFrame:
    from strataform.operators.hierarchy import root_paths

    return root_paths(links(spark)).filter("depth > 0").select("node", F.array_join(F.reverse("path"), ">").alias("path"))


_TREE_SQL = """tree(child, parent) AS (SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier)"""


@query(f"WITH {_TREE_SQL} SELECT a.parent AS root, a.child AS node, b.child AS leaf FROM tree a JOIN tree b ON b.parent = a.child")
def part_of_paths(spark: SparkSession, d: str) -> DataFrame:
    from strataform.operators.hierarchy import root_paths

    k = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    tree = table(spark, d, "nation").select(k("n", "n_nationkey").alias("child"), k("r", "n_regionkey").alias("parent"))
    tree = tree.unionByName(table(spark, d, "customer").select(k("c", "c_custkey").alias("child"), k("n", "c_nationkey").alias("parent"))).unionByName(table(spark, d, "supplier").select(k("s", "s_suppkey").alias("child"), k("n", "s_nationkey").alias("parent")))
    return root_paths(tree).filter("depth = 2").select("root", F.col("path")[1].alias("node"), F.col("node").alias("leaf"))


_LABELS_SQL = f"""{CLOSURE_SQL}, {CODES_SQL[CODES_SQL.index('nodes AS'):]}, pos AS (
  SELECT c.entity, c.node, c.code, max((b.code = 1)::INT) AS pos FROM codes c LEFT JOIN (SELECT ancestor, descendant FROM closure UNION SELECT node, node FROM nodes) k ON k.ancestor = c.node LEFT JOIN codes b ON b.entity = c.entity AND b.node = k.descendant GROUP BY ALL
), m0 AS (SELECT entity, node FROM codes WHERE code = -1),
m1 AS (SELECT * FROM m0 UNION SELECT p.entity, p.node FROM pos p JOIN links l ON l.parent = p.node JOIN m0 m ON m.entity = p.entity AND m.node = l.child WHERE p.code = 9 AND p.pos = 0),
m2 AS (SELECT * FROM m1 UNION SELECT p.entity, p.node FROM pos p JOIN links l ON l.parent = p.node JOIN m1 m ON m.entity = p.entity AND m.node = l.child WHERE p.code = 9 AND p.pos = 0),
m3 AS (SELECT * FROM m2 UNION SELECT p.entity, p.node FROM pos p JOIN links l ON l.parent = p.node JOIN m2 m ON m.entity = p.entity AND m.node = l.child WHERE p.code = 9 AND p.pos = 0),
labels AS (SELECT p.entity, p.node, p.code, CASE WHEN p.pos = 1 THEN 1 WHEN p.code IN (0, 9) AND m.node IS NULL THEN 0 END AS label FROM pos p LEFT JOIN m3 m ON m.entity = p.entity AND m.node = p.node)"""


@query(f"WITH RECURSIVE {_LABELS_SQL} SELECT entity, node, code, label FROM labels")
def label_closure(spark: SparkSession, d: str) -> DataFrame:
    return ontology.close_labels(codes(spark, d), IS_A)


@query(f"""WITH RECURSIVE {_LABELS_SQL} SELECT node, count(*) FILTER (WHERE label = 1) AS positive, count(*) FILTER (WHERE label = 0) AS negative, count(*) FILTER (WHERE label IS NULL) AS unknown FROM labels GROUP BY node""")
def label_audit(spark: SparkSession, d: str) -> DataFrame:
    l = F.col("label")
    return ontology.close_labels(codes(spark, d), IS_A).groupBy("node").agg(F.count_if(l == 1).alias("positive"), F.count_if(l == 0).alias("negative"), F.count_if(l.isNull()).alias("unknown"))


@query(f"""WITH RECURSIVE {CLOSURE_SQL}, {SCORES_SQL}, k AS (SELECT ancestor, descendant FROM closure UNION SELECT DISTINCT parent, parent FROM links UNION SELECT child, child FROM links)
SELECT entity, ancestor AS node, max(p) AS value FROM scores JOIN k ON descendant = node GROUP BY entity, ancestor""")
def region_closure(spark: SparkSession, d: str) -> DataFrame:
    pairs = ontology.closure(links(spark), reflexive=True)
    return ontology.close_max(scores(spark, d).select("entity", "node", F.col("p").alias("value")), pairs, ["entity"])


@query(f"""WITH RECURSIVE {LINKS_SQL}, {SCORES_SQL}, w(entity, node, top, p) AS (SELECT entity, node, node, p FROM scores WHERE node IN (SELECT child FROM links) OR node = 'any_abnormality'
UNION ALL SELECT w.entity, w.node, l.parent, w.p * s.p FROM w JOIN links l ON l.child = w.top LEFT JOIN scores s ON s.entity = w.entity AND s.node = l.parent)
SELECT entity, node, round(p, 6) AS p FROM w WHERE top = 'any_abnormality'""")
def factorised_marginals(spark: SparkSession, d: str) -> DataFrame:
    known = sorted({x for e in IS_A for x in e})
    s = scores(spark, d).select("entity", "node", "p").filter(F.col("node").isin(known))
    return ontology.factorised(s, IS_A).select("entity", "node", F.round("p", 6).alias("p"))


@query(f"""WITH {LINKS_SQL}, {SCORES_SQL} SELECT child, parent, count(*) AS violations, count(DISTINCT c.entity) AS entities FROM links JOIN scores c ON c.node = child JOIN scores p ON p.node = parent AND p.entity = c.entity
WHERE c.p > p.p + 1e-12 GROUP BY child, parent""")
def hierarchy_violations(spark: SparkSession, d: str) -> DataFrame:
    v = ontology.violations(scores(spark, d), links(spark), "entity")
    return v.groupBy("child", "parent").agg(F.count("*").alias("violations"), F.countDistinct("entity").alias("entities"))


_MAP = [("Brand#11", "consolidation"), ("BRAND#12", "edema"), ("brand#21", "pneumonia"), ("Brand#33", "cardiomegaly")]
_MAP_SQL = "map(name, node) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _MAP) + ")"


@query(f"""WITH RECURSIVE {CLOSURE_SQL}, {_MAP_SQL}, c AS (SELECT p_brand AS label, count(*) AS n FROM part GROUP BY 1), k AS (SELECT ancestor, descendant FROM closure UNION SELECT child, child FROM links UNION SELECT parent, parent FROM links)
SELECT ancestor AS node, sum(n)::BIGINT AS n FROM c JOIN map ON lower(label) = lower(name) JOIN k ON descendant = node GROUP BY ancestor""")
def mapping_counts(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "part").groupBy(F.col("p_brand").alias("label")).agg(F.count("*").alias("n"))
    return ontology.mapped_counts(c, spark.createDataFrame(_MAP, "name string, node string"), ontology.closure(links(spark), reflexive=True))


@query(f"WITH {_MAP_SQL} SELECT p_brand AS label, count(*) AS n FROM part WHERE lower(p_brand) NOT IN (SELECT lower(name) FROM map) GROUP BY p_brand")
def mapping_only_unmapped(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "part").groupBy(F.col("p_brand").alias("label")).agg(F.count("*").alias("n"))
    return ontology.mapped_counts(c, spark.createDataFrame(_MAP, "name string, node string"), None, only_unmapped=True)


@query(f"""WITH {LINKS_SQL}, theirs(child, parent) AS (VALUES ('consolidation', 'lung_opacity'), ('pneumonia', 'lung_opacity'), ('lung_opacity', 'any_abnormality'), ('edema', 'any_abnormality'), ('fracture', 'trauma')),
k AS (SELECT child, parent FROM theirs UNION SELECT a.child, b.parent FROM theirs a JOIN theirs b ON b.child = a.parent), n AS (SELECT child AS x FROM theirs UNION SELECT parent FROM theirs)
SELECT child, parent, CASE WHEN child NOT IN (SELECT x FROM n) OR parent NOT IN (SELECT x FROM n) THEN 'not_comparable' WHEN EXISTS (SELECT 1 FROM k WHERE k.child = links.child AND k.parent = links.parent) THEN 'agree' ELSE 'differ' END AS verdict FROM links""")
def hierarchy_agreement(spark: SparkSession, d: str) -> DataFrame:
    theirs = spark.createDataFrame([("consolidation", "lung_opacity"), ("pneumonia", "lung_opacity"), ("lung_opacity", "any_abnormality"), ("edema", "any_abnormality"), ("fracture", "trauma")], "child string, parent string")
    return ontology.agreement(links(spark), theirs)


@query(f"""WITH RECURSIVE {CLOSURE_SQL}, k AS (SELECT * FROM closure UNION SELECT child, child, 0 FROM links UNION SELECT parent, parent, 0 FROM links)
SELECT node, mapped_to, distance::INT AS distance FROM (SELECT descendant AS node, ancestor AS mapped_to, distance, row_number() OVER (PARTITION BY descendant ORDER BY distance, ancestor) AS n FROM k WHERE distance <= 4 AND ancestor IN ('lung_opacity', 'any_abnormality')) WHERE n = 1""")
def bounded_ancestor_search(spark: SparkSession, d: str) -> DataFrame:
    mapped = spark.createDataFrame([("lung_opacity",), ("any_abnormality",)], "node string")
    return ontology.bounded_ancestor(ontology.closure(links(spark), reflexive=True), mapped, 4)


@query(r"""WITH r AS (SELECT 'RID' || regexp_extract(rid, '(?i)rid\s*(\d+)\s*$', 1) AS key, label, synonyms FROM radlex_classes), n AS (
SELECT key, 0 AS r, lower(trim(label)) AS name FROM r UNION ALL SELECT key, 1, lower(trim(unnest(synonyms))) FROM r)
SELECT name, key FROM (SELECT name, key, row_number() OVER (PARTITION BY name ORDER BY r, key) AS k FROM n WHERE name <> '' AND key <> 'RID') WHERE k = 1""")
def name_index(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "radlex_classes").select(class_id("rid").alias("rid"), "label", "synonyms")
    return ontology.name_index(r, "rid", "label", "synonyms")


@query("""SELECT p_type, CASE WHEN p_size < 15 THEN 'small' ELSE 'large' END AS kind, count(*) AS n FROM part GROUP BY ALL UNION ALL SELECT 'ALL', CASE WHEN p_size < 15 THEN 'small' ELSE 'large' END, count(*) FROM part GROUP BY ALL""")
def source_categories(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_type", F.when(F.col("p_size") < 15, "small").otherwise("large").alias("kind"))
    per = p.groupBy("p_type", "kind").agg(F.count("*").alias("n"))
    return per.unionByName(per.groupBy("kind").agg(F.sum("n").alias("n")).withColumn("p_type", F.lit("ALL")))
