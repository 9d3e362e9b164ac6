"""Ontology operators over small link tables (child, parent) and label tables (entity, node, code)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataform.operators.hierarchy import ancestor_pairs

POSITIVE, NEGATIVE, UNCERTAIN, BLANK, NO_ROW = 1, 0, -1, 9, -9


class OntologyError(ValueError):
    """An ontology that breaks its schema."""


def validate(nodes: list[dict], links: list[dict], required: Iterable[str] = ("id", "label"), enums: dict[str, set] | None = None) -> None:
    """Raises for missing keys, repeated ids, unknown references, values outside an enumeration and cycles."""
    problems = []
    ids = [n.get("id") for n in nodes]
    for n in nodes:
        problems += [f"node {n.get('id')}: no {k}" for k in required if n.get(k) in (None, "")]
        problems += [f"node {n.get('id')}: {k} is {n.get(k)!r}" for k, allowed in (enums or {}).items() if k in n and n[k] not in allowed]
    problems += [f"repeated id {i}" for i in sorted({i for i in ids if ids.count(i) > 1}, key=str)]
    for e in links:
        problems += [f"link {e.get('id')}: unknown {k} {e.get(k)}" for k in ("child", "parent") if e.get(k) not in ids]
    up: dict = {}
    for e in links:
        up.setdefault(e.get("child"), set()).add(e.get("parent"))
    for start in up:
        seen, todo = set(), list(up[start])
        while todo:
            x = todo.pop()
            if x == start:
                problems.append(f"cycle through {start}")
                break
            if x not in seen:
                seen.add(x)
                todo += up.get(x, ())
    if problems:
        raise OntologyError("; ".join(problems))


def closure(links: DataFrame, reflexive: bool = False) -> DataFrame:
    """(ancestor, descendant, distance); reflexive adds every node to itself at 0."""
    pairs = ancestor_pairs(links)
    if not reflexive:
        return pairs
    nodes = links.select(F.col("child").alias("n")).unionByName(links.select(F.col("parent").alias("n"))).distinct()
    return nodes.select(F.col("n").alias("ancestor"), F.col("n").alias("descendant"), F.lit(0).alias("distance")).unionByName(pairs)


def depths(links: DataFrame) -> DataFrame:
    """(node, depth): the greatest number of links to a root on an acyclic ontology, for orders with children first."""
    spark = links.sparkSession
    rows = [(r["child"], r["parent"]) for r in links.select("child", "parent").distinct().collect()]  # an ontology, not data
    up: dict[str, set[str]] = {}
    for c, p in rows:
        up.setdefault(c, set()).add(p)
        up.setdefault(p, set())
    known: dict[str, int] = {}

    def depth(n: str, path: tuple[str, ...] = ()) -> int:
        if n in path:
            raise OntologyError(f"cycle through {n}")
        if n not in known:
            known[n] = max((depth(p, (*path, n)) + 1 for p in up[n]), default=0)
        return known[n]

    return spark.createDataFrame([(n, depth(n)) for n in up], "node string, depth int")


def bounded_ancestor(pairs: DataFrame, mapped: DataFrame, levels: int) -> DataFrame:
    """(node, mapped_to, distance): the nearest ancestor-or-self in mapped (node) within levels; equal distances go to the smaller."""
    hits = pairs.filter(F.col("distance") <= levels).join(mapped.select(F.col("node").alias("ancestor")), "ancestor", "left_semi")
    best = hits.groupBy("descendant").agg(F.min(F.struct("distance", "ancestor")).alias("b"))
    return best.select(F.col("descendant").alias("node"), F.col("b.ancestor").alias("mapped_to"), F.col("b.distance").alias("distance"))


def close_labels(codes: DataFrame, links: list[tuple[str, str]]) -> DataFrame:
    """(entity, node, code, label) with three-valued labels closed over a small ontology.

    codes has entity, node and code, at most one row each. A blank is negative and an uncertain code unknown (null); no row
    is unknown. A positive child makes every ancestor positive. An uncertain or so masked child masks a blank parent that
    isn't positive, level by level up. Only nodes in codes come out, so give every entity all its nodes.

    The positive closure is one aggregation through the closure of the links; masking is unrolled over the ontology's
    levels, each one aggregation on the entity, which keeps its partitioning.
    """
    up: dict[str, set[str]] = {}
    for c, p in links:
        up.setdefault(c, set()).add(p)

    def above(n: str) -> set[str]:
        out: set[str] = set()
        for p in up.get(n, ()):
            out |= {p} | above(p)
        return out

    nodes = sorted({x for e in links for x in e})
    # The entity's nodes as one map: a row per entity, of as many entries as the ontology has nodes.
    wide = codes.groupBy("entity").agg(F.map_from_entries(F.collect_list(F.struct("node", "code"))).alias("codes"))
    positive: dict[str, Column] = {}
    own = {n: F.try_element_at("codes", F.lit(n)) for n in nodes}
    for n in nodes:
        below = [c for c in nodes if n in above(c)]
        any_below = F.lit(False)
        for c in below:
            any_below = any_below | F.coalesce(own[c] == POSITIVE, F.lit(False))
        positive[n] = F.coalesce(own[n] == POSITIVE, F.lit(False)) | any_below
    order = sorted(nodes, key=lambda n: -len(above(n)))  # children first: a child has more ancestors than its parents
    masked: dict[str, Column] = {}
    for n in order:
        from_child = F.lit(False)
        for c in [c for c in nodes if n in up.get(c, ())]:
            from_child = from_child | masked[c]
        masked[n] = F.coalesce(own[n] == UNCERTAIN, F.lit(False)) | (F.coalesce(own[n] == BLANK, F.lit(False)) & ~positive[n] & from_child)
    label = F.create_map(*[x for n in nodes for x in (F.lit(n), F.when(positive[n], 1).when(own[n].isin(NEGATIVE, BLANK) & ~masked[n], 0))])
    out = wide.select("entity", "codes", label.alias("labels"))
    rows = out.select("entity", "labels", F.explode("codes").alias("node", "code"))
    plain = F.when(F.col("code") == POSITIVE, 1).when(F.col("code").isin(NEGATIVE, BLANK), 0)
    in_ontology = F.map_contains_key("labels", F.col("node"))
    return rows.select("entity", "node", "code", F.when(in_ontology, F.try_element_at("labels", F.col("node"))).otherwise(plain).cast("int").alias("label"))


def close_max(values: DataFrame, pairs: DataFrame, entity: list[str]) -> DataFrame:
    """value of each node of an entity lifted to its ancestors by the maximum; pairs must be reflexive. Nulls don't count."""
    p = pairs.select(F.col("descendant").alias("node"), F.col("ancestor"))
    return values.join(F.broadcast(p), "node").groupBy(*entity, F.col("ancestor").alias("node")).agg(F.max("value").alias("value"))


def factorised(conditional: DataFrame, links: list[tuple[str, str]], entity: str = "entity") -> DataFrame:
    """P(node) = P(node | parent) x P(parent) down a tree; rows (entity, node, p), of which every node on the path must exist."""
    up = dict(links)
    if len(up) < len(links):
        raise OntologyError("a node has several parents; marginals need a tree")

    def path(n: str) -> list[str]:
        return [n, *path(up[n])] if n in up else [n]

    wide = conditional.groupBy(entity).agg(F.map_from_entries(F.collect_list(F.struct("node", "p"))).alias("m"))
    rows = wide.select(entity, "m", F.explode("m").alias("node", "own"))
    product = F.col("own")
    for n in sorted({x for e in links for x in e}):
        whole = F.lit(1.0)
        for x in reversed(path(n)):
            whole = whole * F.try_element_at("m", F.lit(x))
        product = F.when(F.col("node") == n, whole).otherwise(product)
    return rows.select(entity, "node", product.alias("p"))


def violations(values: DataFrame, links: DataFrame, entity: str, tolerance: float = 1e-12) -> DataFrame:
    """Rows (entity, child, parent, child_p, parent_p) where a child's p exceeds its parent's by more than tolerance."""
    e = F.broadcast(links.select("child", "parent"))
    child = values.select(entity, F.col("node").alias("child"), F.col("p").alias("child_p")).join(e, "child")
    parent = values.select(entity, F.col("node").alias("parent"), F.col("p").alias("parent_p"))
    return child.join(parent, [entity, "parent"]).filter(F.col("child_p") > F.col("parent_p") + tolerance)


def agreement(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(child, parent, verdict) of our links against the closure of another ontology.

    agree: the parent is an ancestor there; differ: both are known there but it isn't; not_comparable: one is unknown.
    """
    pairs = ancestor_pairs(theirs).select(F.col("descendant").alias("child"), F.col("ancestor").alias("parent"), F.lit(True).alias("hit"))
    known = theirs.select(F.col("child").alias("n")).unionByName(theirs.select(F.col("parent").alias("n"))).distinct()
    both = ours.join(known.select(F.col("n").alias("child"), F.lit(True).alias("c")), "child", "left").join(known.select(F.col("n").alias("parent"), F.lit(True).alias("p")), "parent", "left")
    both = both.join(pairs, ["child", "parent"], "left")
    verdict = F.when(F.col("c").isNull() | F.col("p").isNull(), "not_comparable").when(F.col("hit"), "agree").otherwise("differ")
    return both.select("child", "parent", verdict.alias("verdict"))


def mapped_counts(counts: DataFrame, mapping: DataFrame, pairs: DataFrame, only_unmapped: bool = False) -> DataFrame:
    """Counts (label, n) mapped to nodes without regard to case and lifted to ancestors; or the labels no mapping has.

    mapping: (name, node); pairs must be reflexive.
    """
    low = counts.select(F.lower(F.trim("label")).alias("k"), "label", "n").join(F.broadcast(mapping.select(F.lower(F.trim("name")).alias("k"), "node")), "k", "left")
    if only_unmapped:
        return low.filter("node is null").select("label", "n")
    up = low.filter("node is not null").join(F.broadcast(pairs.select(F.col("descendant").alias("node"), "ancestor")), "node")
    return up.groupBy(F.col("ancestor").alias("node")).agg(F.sum("n").alias("n"))


def name_index(df: DataFrame, key: str, label: str, synonyms: str) -> DataFrame:
    """(name, key): labels and synonyms in lower case; a name goes to a label before a synonym, then to the smaller key."""
    names = df.select(F.col(key).alias("key"), F.explode(F.concat(F.array(F.struct(F.lit(0).alias("r"), F.col(label).alias("n"))), F.coalesce(F.transform(synonyms, lambda s: F.struct(F.lit(1).alias("r"), s.alias("n"))), F.array()))).alias("x"))
    clean = names.select("key", "x.r", F.lower(F.trim("x.n")).alias("name")).filter("name is not null and name <> '' and key is not null")
    return clean.groupBy("name").agg(F.min(F.struct("r", "key")).alias("b")).select("name", F.col("b.key").alias("key"))


def links_frame(spark: SparkSession, links: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(links, "child string, parent string")
