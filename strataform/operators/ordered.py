"""Ranks, first-of-group, running counts and samples; every order ends in a unique key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataform.functions.hashing import hex_number

#: Ranges of the score over which running counts are taken in two steps.
RANGES = 1024


def first_per_group(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in an order that must be total."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def numbered(df: DataFrame, group: list[str], order: list[Column], into: str = "n") -> DataFrame:
    """Rows numbered from 1 inside their group."""
    return df.withColumn(into, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; Spark limits each partition before the shuffle."""
    return numbered(df, group, order, "_n").filter(F.col("_n") <= k).drop("_n")


def average_rank(df: DataFrame, group: list[str], score: str, into: str = "rank") -> DataFrame:
    """Rank from 1 by ascending score in each group, ties averaged; null scores rank null.

    Scores are first counted by value; the running count over values is taken by ranges, so no task sorts a whole group.
    """
    values = df.filter(F.col(score).isNotNull()).groupBy(*group, score).agg(F.count("*").alias("_n"))
    before = running_before(values, group, score, ["_n"], descending=False)
    ranks = before.select(*group, score, (F.col("before__n") + (F.col("_n") + 1) / 2).alias(into))
    return df.join(ranks, [*group, score], "left") if group else df.join(ranks, [score], "left")


def running_before(values: DataFrame, group: list[str], score: str, counts: list[str], descending: bool) -> DataFrame:
    """Adds before_<count>: the sum over all smaller (or greater, if descending) scores of the group.

    values has one row a group and score. Scores are cut into RANGES ranges between the group's least and greatest; sums
    over ranges, of which there are few, are added to sums inside each range.
    """
    span = values.groupBy(*group).agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))
    v = values.join(span, group) if group else values.crossJoin(F.broadcast(span))  # one row
    width = F.when(F.col("_hi") > F.col("_lo"), (F.col(score) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)
    v = v.withColumn("_range", F.least(F.floor(width * RANGES), F.lit(RANGES - 1)).cast("int"))
    ranges = v.groupBy(*group, "_range").agg(*[F.sum(c).alias(f"_r_{c}") for c in counts])
    order = F.col("_range").desc() if descending else F.col("_range").asc()
    wr = Window.partitionBy(*(group or [F.lit(1)])).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(*group, "_range", *[F.coalesce(F.sum(f"_r_{c}").over(wr), F.lit(0)).alias(f"_b_{c}") for c in counts])
    inner = F.col(score).desc() if descending else F.col(score).asc()
    w = Window.partitionBy(*group, "_range").orderBy(inner).rowsBetween(Window.unboundedPreceding, -1)
    joined = v.join(ranges, [*group, "_range"])
    return joined.select(*values.columns, *[(F.col(f"_b_{c}") + F.coalesce(F.sum(c).over(w), F.lit(0))).alias(f"before_{c}") for c in counts])


def hash_sample(df: DataFrame, salt: str, key: str, n: int) -> DataFrame:
    """n rows by the order of the salted hash of a unique key: the same on every run and engine."""
    h = hex_number(F.concat(F.lit(f"{salt}:"), F.col(key).cast("string")), 15)
    return df.withColumn("_h", h).orderBy("_h", key).limit(n).drop("_h")


def capped_negatives(df: DataFrame, group: list[str], positive: Column, key: str, ratio: int, salt: str) -> DataFrame:
    """All positives of each group and at most ratio times as many negatives, chosen by hash."""
    h = hex_number(F.concat(F.lit(f"{salt}:"), F.col(key).cast("string")), 15)
    marked = df.withColumn("_pos", F.coalesce(positive, F.lit(False))).withColumn("_h", h)
    n = marked.groupBy(*group).agg(F.count_if("_pos").alias("_np"))
    negative = numbered(marked.filter("not _pos"), group, [F.col("_h").asc(), F.col(key).asc()], "_n").join(n, group).filter(F.col("_n") <= ratio * F.col("_np"))
    return marked.filter("_pos").select(*df.columns).unionByName(negative.select(*df.columns))


def nearest_index_quantile(df: DataFrame, value: str, q: float) -> DataFrame:
    """sorted[min(n - 1, int(q n))] of the values that aren't null, as one row q, value."""
    v = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    ranked = running_before(v, [], "_v", ["_n"], descending=False)
    total = v.agg(F.sum("_n").alias("_t"))
    at = F.least(F.col("_t") - 1, F.floor(F.lit(q) * F.col("_t")))
    hit = ranked.crossJoin(F.broadcast(total)).filter((F.col("before__n") <= at) & (at < F.col("before__n") + F.col("_n")))
    return hit.select(F.lit(q).alias("q"), F.col("_v").alias("value"))


def pick_without_reuse(df: DataFrame, key: str, categories: list[tuple[str, Column]]) -> DataFrame:
    """(category, key): for each category in order, the smallest key that matches it and wasn't taken before; a few rows."""
    taken: list = []
    for name, condition in categories:
        free = df.filter(condition)
        for _, k in taken:
            free = free.filter(F.col(key) != F.lit(k))
        first = free.agg(F.min(key)).first()[0]
        if first is not None:
            taken.append((name, first))
    return df.sparkSession.createDataFrame(taken, f"category string, `{key}` {df.schema[key].dataType.simpleString()}")
