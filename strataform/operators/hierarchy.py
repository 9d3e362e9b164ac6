"""Parent-child links to paths, depths, roots, descendants and cycles.

Links are rows (child, parent) of strings; null ends are dropped, repeated links count once, a class may be its own
parent. Nodes without a parent are roots. All functions take and return DataFrames; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataform.runtime import cut

#: Levels that one frontier join advances.
STRIDE = 16


def clean_links(links: DataFrame) -> DataFrame:
    """Distinct (child, parent) without null ends."""
    return links.select("child", "parent").filter("child is not null and parent is not null").distinct()


def endless(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node) of nodes whose way upward never ends, and the links among them; links as of clean_links.

    A frontier starts at the roots and doubles its reach every round: after round k all nodes less than 2^k levels under
    their roots are resolved, as no walk of 2^k links leads up from them. Walks of 2^k links are pairs of their ends, met
    from one midpoint. When every unresolved node has an unresolved parent, none of them will ever be resolved.
    """
    inner = cut(links)
    walks = inner.select(F.col("child").alias("node"), F.col("parent").alias("end"))
    open_nodes = cut(walks.select("node").distinct())
    while True:
        inner = inner.join(open_nodes.withColumnRenamed("node", "child"), "child", "left_semi").join(open_nodes.withColumnRenamed("node", "parent"), "parent", "left_semi")
        inner = cut(inner.select("child", "parent"))
        left = inner.select(F.col("child").alias("node")).distinct()
        if open_nodes.join(left, "node", "left_anti").isEmpty():
            return open_nodes, inner
        first = walks.join(left, "node", "left_semi").select("node", F.col("end").alias("middle"))
        walks = cut(first.join(walks.select(F.col("node").alias("middle"), "end"), "middle").select("node", "end").distinct())
        open_nodes = cut(walks.select("node").distinct())


def ancestor_pairs(links: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance) over one or more links, with the least distance; a cycle pairs a node with itself.

    Pairs up to distance 2^k are joined with those of distance exactly 2^k, so every pair is met from one midpoint and
    the rounds are the logarithm of the depth.
    """
    pairs = cut(clean_links(links).select(F.col("parent").alias("ancestor"), F.col("child").alias("descendant"), F.lit(1).alias("distance")))
    reach = 1
    while True:
        upper = pairs.select(F.col("ancestor"), F.col("descendant").alias("middle"), F.col("distance").alias("far"))
        lower = pairs.filter(F.col("distance") == reach).select(F.col("ancestor").alias("middle"), "descendant")
        met = upper.join(lower, "middle").groupBy("ancestor", "descendant").agg((F.min("far") + reach).cast("int").alias("distance"))
        new = cut(met.join(pairs.select("ancestor", "descendant"), ["ancestor", "descendant"], "left_anti"))
        if new.isEmpty():
            return pairs
        pairs = cut(pairs.unionByName(new))
        reach *= 2


def cycle_cases(links: DataFrame) -> DataFrame:
    """(node, case_kind) of the nodes whose way upward never ends: on_cycle or below_cycle.

    They are the nodes that a frontier from the roots never resolves (see endless). A second frontier from below leaves those
    that have a cycle under them too. Where each of them has one parent among them, they are the cycles; else those met
    among their own ancestors are.
    """
    nodes, inner = endless(clean_links(links))
    turned = inner.select(F.col("parent").alias("child"), F.col("child").alias("parent"))
    _, core = endless(turned)
    core = cut(core.select(F.col("parent").alias("child"), F.col("child").alias("parent")))
    several = core.groupBy("child").agg(F.count("*").alias("n")).filter("n > 1")
    on = core.select(F.col("child").alias("node")) if several.isEmpty() else ancestor_pairs(core).filter("ancestor = descendant").select(F.col("ancestor").alias("node"))
    marked = on.distinct().withColumn("on", F.lit(True))
    return nodes.join(marked, "node", "left").select("node", F.when(F.col("on"), "on_cycle").otherwise("below_cycle").alias("case_kind"))


def root_paths(links: DataFrame) -> DataFrame:
    """(node, root, depth, path) for every node and every root it is reached from, path from root to node.

    Of several paths from one root the shortest counts, then the smallest (see path_counts for how many there are). A
    frontier starts at the roots and advances STRIDE levels a join, over the shortest segments of up to STRIDE links that
    doubling has prepared. A node reached from no root gives no row: it is on or under a cycle only.
    """
    edges = cut(clean_links(links))
    segments = cut(edges.filter("child <> parent").select(F.col("parent").alias("top"), F.col("child").alias("node"), F.lit(1).alias("length"), F.array("child").alias("way")))
    reach = 1
    while reach < STRIDE:
        upper = segments.select("top", F.col("node").alias("middle"), F.col("length").alias("l"), F.col("way").alias("w"))
        lower = segments.filter(F.col("length") == reach).select(F.col("top").alias("middle"), "node", F.col("way").alias("v"))
        longer = upper.join(lower, "middle").filter("top <> node").select("top", "node", (F.col("l") + reach).alias("length"), F.concat("w", "v").alias("way"))
        segments = cut(_shortest(segments.unionByName(longer), ["top", "node"], "length", "way"))
        reach *= 2
    segments = cut(segments.repartition("top"))
    roots = edges.select(F.col("parent").alias("node")).distinct().join(edges.select(F.col("child").alias("node")).distinct(), "node", "left_anti")
    found = frontier = cut(roots.select("node", F.col("node").alias("root"), F.lit(0).alias("depth"), F.array("node").alias("path")))
    while True:
        start = frontier.select(F.col("node").alias("top"), "root", "depth", "path")
        on = start.join(segments, "top").select("node", "root", (F.col("depth") + F.col("length")).alias("depth"), F.concat("path", "way").alias("path"))
        ahead = _shortest(on, ["node", "root"], "depth", "path").join(found.select("node", "root"), ["node", "root"], "left_anti")
        ahead = cut(ahead.select("node", "root", "depth", "path"))
        deepest = ahead.agg(F.max("depth")).first()[0]
        if deepest is None:
            return found
        found = found.unionByName(ahead)
        frontier = ahead.filter(F.col("depth") == deepest)


def _shortest(df: DataFrame, keys: list[str], length: str, way: str) -> DataFrame:
    """The row of each key with the shortest, then the smallest way."""
    best = df.groupBy(*keys).agg(F.min(F.struct(length, way)).alias("b"))
    return best.select(*keys, F.col(f"b.{length}").alias(length), F.col(f"b.{way}").alias(way))


def path_counts(links: DataFrame) -> DataFrame:
    """(node, paths): how many paths lead from roots to each node whose ways upward all end; roots have one.

    All paths are the links themselves followed from the roots; their number may be exponential, their counts are not:
    they are summed level by level, a node when all its parents are done. Counts are exact up to 38 digits.
    """
    edges = cut(clean_links(links))
    never, _ = endless(edges)
    good = cut(edges.join(never.withColumnRenamed("node", "child"), "child", "left_anti").select("child", "parent"))
    one = F.lit(1).cast("decimal(38,0)")
    roots = edges.select(F.col("parent").alias("node")).distinct().join(edges.select(F.col("child").alias("node")).distinct(), "node", "left_anti")
    done = cut(roots.select("node", one.alias("paths")))
    left = good
    while not left.isEmpty():
        known = left.join(done.select(F.col("node").alias("parent"), "paths"), "parent", "left")
        sums = known.groupBy("child").agg(F.count_if(F.col("paths").isNull()).alias("open"), F.sum("paths").cast("decimal(38,0)").alias("paths"))
        new = cut(sums.filter("open = 0").select(F.col("child").alias("node"), "paths"))
        left = cut(left.join(new.select(F.col("node").alias("child")), "child", "left_anti").select("child", "parent"))
        done = cut(done.unionByName(new))
    return done
