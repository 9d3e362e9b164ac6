"""Connected components by frontier search from many seeds, and splits that keep components whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataform.runtime import checked_broadcast, cut

#: Edges of one node after which its adjacency list is spread over several partitions.
HOT_EDGES = 100_000
#: Hash buckets of the two-level prefix sum.
BUCKETS = 4096


def _order(column: str | F.Column) -> F.Column:
    """Total order of nodes by hash; the node itself decides where hashes agree."""
    return F.struct(F.xxhash64(column).alias("h"), F.col(column).alias("n") if isinstance(column, str) else column.alias("n"))


def _search(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One level: labels (node, label) of a symmetric graph, and the graph (src, dst) of labels that collided."""
    degrees = edges.groupBy("src").agg(F.count("*").alias("degree"), F.min(_order("dst")).alias("least"))
    degrees = cut(degrees)
    hot = cut(degrees.filter(F.col("degree") > HOT_EDGES).select(F.col("src").alias("hot"), F.ceil(F.col("degree") / HOT_EDGES).cast("int").alias("parts")))
    hot_rows = hot.count()
    spread = checked_broadcast(hot, hot_rows)

    def parts(df: DataFrame, node: str) -> DataFrame:
        if not hot_rows:
            return df.withColumn("parts", F.lit(1))
        return df.join(spread, df[node] == spread.hot, "left").withColumn("parts", F.coalesce("parts", F.lit(1))).drop("hot")

    lists = parts(edges, "src").select("src", "dst", F.pmod(F.xxhash64("dst"), "parts").cast("int").alias("part"))
    lists = cut(lists.repartition("src", "part"))
    seeds = degrees.filter(_order("src") < F.col("least")).select(F.col("src").alias("node"), F.col("src").alias("label"))
    visited = frontier = cut(seeds)
    while True:
        asked = parts(frontier, "node").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        met = asked.join(lists, (asked.node == lists.src) & (asked.part == lists.part)).groupBy("dst").agg(F.min(_order("label")).alias("o"))
        frontier = cut(met.select(F.col("dst").alias("node"), F.col("o.n").alias("label")).join(visited.select("node"), "node", "left_anti"))
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    visited = cut(visited)
    a = visited.select(F.col("node").alias("src"), F.col("label").alias("a"))
    b = visited.select(F.col("node").alias("dst"), F.col("label").alias("b"))
    collided = edges.filter(F.col("src") < F.col("dst")).join(a, "src").join(b, "dst").filter("a <> b").select("a", "b").distinct()
    both = collided.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(collided.select(F.col("b").alias("src"), F.col("a").alias("dst")))
    return visited, cut(both.distinct())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of the undirected graph edges (src, dst), both strings and not null.

    Nodes with one neighbour are set aside and take its label. In what remains, every node whose hash is least among its
    neighbours is a seed; all seeds expand at once, frontier by frontier, over adjacency lists partitioned by node, the
    lists of hot nodes over several partitions. A node keeps the first label that reaches it (of several the least by
    hash). Labels that meet along an edge form a smaller graph, which is merged in the same way until no labels meet.
    Every level leaves at most half of its connected nodes. Loops and repeated edges change nothing; an empty table gives
    an empty result.
    """
    one_way = edges.filter("src <> dst").select("src", "dst").distinct()
    loops = edges.filter("src = dst").select(F.col("src").alias("node")).distinct()
    graph = cut(one_way.unionByName(one_way.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    degree = graph.groupBy("src").agg(F.count("*").alias("degree"), F.min("dst").alias("hub"))
    single = degree.filter("degree = 1").select(F.col("src").alias("leaf"), "hub")
    pairs = single.select(F.col("leaf").alias("hub"), F.lit(True).alias("mutual"))
    leaves = cut(single.join(pairs, "hub", "left").filter(F.col("mutual").isNull() | (F.col("leaf") > F.col("hub"))).select("leaf", "hub"))
    gone = leaves.select(F.col("leaf").alias("src"))
    level = cut(graph.join(gone, "src", "left_anti").join(gone.withColumnRenamed("src", "dst"), "dst", "left_anti"))
    rest = graph.select(F.col("src").alias("node")).distinct().join(gone.withColumnRenamed("src", "node"), "node", "left_anti")
    labels = rest.select("node", F.col("node").alias("label"))
    while not level.isEmpty():
        found, level = _search(level)
        step = found.select(F.col("node").alias("label"), F.col("label").alias("next"))
        labels = cut(labels.join(step, "label", "left").select("node", F.coalesce("next", "label").alias("label")))
    hung = leaves.join(labels, F.col("hub") == F.col("node")).select(F.col("leaf").alias("node"), "label")
    known = labels.unionByName(hung)
    alone = loops.join(known.select("node"), "node", "left_anti").select("node", F.col("node").alias("label"))
    return known.unionByName(alone)


def _keyed(df: DataFrame, keys: list[str]) -> DataFrame:
    """df with a column _k0, _k1 ... per key (a node, or null) and _anchor, the first of them that isn't null."""
    for i, k in enumerate(keys):
        df = df.withColumn(f"_k{i}", F.concat(F.lit(f"{i}:"), F.col(k).cast("string")))
    return df.withColumn("_anchor", F.coalesce(*[F.col(f"_k{i}") for i in range(len(keys))]))


def linked(keyed: DataFrame, keys: list[str]) -> DataFrame:
    """(node, label) of all nodes that share a row with another node. Input: the result of _keyed."""
    n = range(1, len(keys))
    links = [keyed.select(F.col("_anchor").alias("src"), F.col(f"_k{i}").alias("dst")).filter(f"_k{i} is not null and _anchor <> _k{i}").distinct() for i in n]
    edges = links[0]
    for more in links[1:]:
        edges = edges.unionByName(more)
    return cut(connected_components(edges))


def label_anchors(counted: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds label to rows with a unique or pre-aggregated _anchor; an unlinked anchor is its own label."""
    got = labels.select(F.col("node").alias("_anchor"), "label")
    return counted.join(got, "_anchor", "left").withColumn("label", F.coalesce("label", "_anchor"))


def broken_members(df: DataFrame, keys: list[str], given: str) -> DataFrame:
    """Values of keys[0] whose group has rows in more than one value of given.

    Rows that share a value of any key, directly or through further rows, form a group. Null values of a key link
    nothing; null values of given are ignored. Rows without any key can't break a group. Repeated rows change nothing.
    Returns one column, keys[0], without nulls.
    """
    own = [f"_v{i}" for i in range(len(keys))]  # names that can't clash with those used below
    keyed = _keyed(df.select(*[F.col(k).alias(o) for k, o in zip(keys, own)], F.col(given).alias("_given")), own)
    labels = linked(keyed, own)
    seen = keyed.filter(F.col("_anchor").isNotNull() & F.col("_given").isNotNull()).groupBy("_anchor", "_given").agg(F.lit(1).alias("one"))
    spans = label_anchors(seen, labels).groupBy("label").agg(F.min("_given").alias("lo"), F.max("_given").alias("hi")).filter("lo <> hi").select("label")
    members = keyed.filter(F.col(own[0]).isNotNull()).groupBy(F.col("_k0").alias("_anchor"), own[0]).agg(F.lit(1).alias("one"))
    return label_anchors(members, labels).join(spans, "label", "left_semi").select(F.col(own[0]).alias(keys[0]))


def grouped_splits(df: DataFrame, keys: list[str], row_id: str, shares: dict[str, float], giant: float | None = None) -> DataFrame:
    """Every row with new_split, so that rows sharing a value of any key never part and the shares of rows are met.

    Groups are ordered by the hash of their label and cut where the running number of rows reaches the shares, so a share
    is met up to half of the group at its limit. giant, if given, is a share of all rows: groups above it (at most 1 / giant)
    go first, each to the split that lacks most rows, which meets the shares where single groups are large. The running number is a prefix
    sum over hash buckets and then inside each bucket, so no task sees all groups. Rows without any key are groups of
    their own by row_id (rows whose row_id is null too form one group). The result depends on the keys only, not on the
    order or partitioning of rows. An empty table gives an empty result; the other columns pass through, but for
    any called group_label or new_split, which are replaced.
    """
    keyed = _keyed(df, keys)
    labels = linked(keyed, keys)
    keyed = keyed.withColumn("_anchor", F.coalesce("_anchor", F.concat(F.lit("r:"), F.col(row_id).cast("string")), F.lit("r")))
    anchors = cut(label_anchors(keyed.groupBy("_anchor").agg(F.count("*").alias("rows")), labels))
    groups = cut(anchors.groupBy("label").agg(F.sum("rows").alias("rows")))
    total = groups.agg(F.sum("rows")).first()[0] or 0
    names = list(shares)
    lack = {s: total * shares[s] for s in names}
    placed = []
    for label, rows in groups.filter(F.col("rows") > giant * total).orderBy(F.desc("rows"), "label").collect() if giant else []:  # at most 1 / giant rows
        to = max(names, key=lambda s: (lack[s], -names.index(s)))
        lack[to] -= rows
        placed.append((label, to))
    giants = df.sparkSession.createDataFrame(placed, "label string, giant string")
    rest = groups.join(F.broadcast(giants), "label", "left").withColumn("h", F.xxhash64("label")).withColumn("bucket", F.pmod(F.shiftrightunsigned("h", 52), F.lit(BUCKETS)))
    rest = cut(rest)
    free = rest.filter("giant is null")
    sums = free.groupBy("bucket").agg(F.sum("rows").alias("in_bucket"))  # at most BUCKETS rows
    before = sums.select("bucket", (F.sum("in_bucket").over(Window.orderBy("bucket")) - F.col("in_bucket")).alias("before"))
    w = Window.partitionBy("bucket").orderBy("h", "label").rowsBetween(Window.unboundedPreceding, -1)
    running = free.join(F.broadcast(before), "bucket").withColumn("at", F.col("before") + F.coalesce(F.sum("rows").over(w), F.lit(0)) + F.col("rows") / 2)
    edge, choice = 0.0, F.lit(names[-1])
    limits = []
    for s in names[:-1]:
        edge += max(lack[s], 0.0)
        limits.append((edge, s))
    scale = sum(max(x, 0.0) for x in lack.values())
    open_rows = free.agg(F.sum("rows")).first()[0] or 0
    for edge, s in reversed(limits):
        choice = F.when(F.col("at") < F.lit(edge * open_rows / scale if scale else 0.0), s).otherwise(choice)
    chosen = running.select("label", choice.alias("new_split")).unionByName(rest.filter("giant is not null").select("label", F.col("giant").alias("new_split")))
    by_anchor = cut(anchors.join(chosen, "label").select("_anchor", F.col("label").alias("_l"), F.col("new_split").alias("_s"), "rows"))
    big = by_anchor.filter(F.col("rows") > HOT_EDGES).drop("rows")
    many = by_anchor.filter(F.col("rows") <= HOT_EDGES).drop("rows")
    # Rows of hot anchors meet a short broadcast list; the rest are joined by a shuffle.
    marked = keyed.join(checked_broadcast(big), "_anchor", "left")
    cold = marked.filter("_s is null").drop("_l", "_s").join(many, "_anchor")
    done = cold.unionByName(marked.filter("_s is not null"))
    return done.select(*[c for c in df.columns if c not in ("group_label", "new_split")], F.col("_l").alias("group_label"), F.col("_s").alias("new_split"))
