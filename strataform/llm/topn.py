"""Top N items of every group by lower bounds found inside each partition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataform.runtime import checked_broadcast, cut

#: Rows after which a partition reports its bounds and starts anew, so that a task's memory is bounded.
CHUNK_ROWS = 1_000_000


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    encoded = column.combine_chunks().dictionary_encode()
    if isinstance(encoded, pa.ChunkedArray):
        encoded = encoded.combine_chunks()
    return encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _chunk_bounds(rows: pa.Table, groups: list[str], n: int) -> pa.Table:
    """For each group with more than n different items in these rows: its n-th best (score, item)."""
    code = np.zeros(rows.num_rows, dtype=np.int64)
    for g in groups:
        c = _codes(rows[g])
        code = np.unique(code * (c.max(initial=0) + 1) + c, return_inverse=True)[1]
    score = rows["score"].to_numpy()
    item = rows["item"]
    if pa.types.is_string(item.type):
        item = np.unique(np.array(item.to_pylist(), dtype=object), return_inverse=True)[1]  # codes in the order of the strings
    else:
        item = item.to_numpy()
    order = np.lexsort((-score, item, code))  # an item's best row comes first among its repeats
    first = np.ones(len(order), dtype=bool)
    first[1:] = (code[order][1:] != code[order][:-1]) | (item[order][1:] != item[order][:-1])
    order = order[first]
    order = order[np.lexsort((item[order], -score[order], code[order]))]
    starts = np.flatnonzero(np.r_[True, code[order][1:] != code[order][:-1]]) if len(order) else np.zeros(0, int)
    sizes = np.diff(np.r_[starts, len(order)])
    nth = order[starts[sizes > n] + n - 1]
    return rows.take(pa.array(nth))


def top_n_per_group(df: DataFrame, groups: list[str], score: str, item: str, n: int) -> DataFrame:
    """The n rows of every group with the highest score; equal scores go to the smaller item.

    Each partition's n-th best (score, item) of a group is a lower bound of the group's n-th best. The highest bound of
    each group is joined, rows under it are dropped before any shuffle, and only the survivors are ranked: at most n
    items a chunk of a partition, however large the group is.

    Null or NaN scores and null groups or items don't count. A repeated item of a group counts once, with its highest
    score. Groups with fewer than n items come out whole; an empty table gives no rows. Other columns are ignored, so
    their names can't clash. Returns the groups, item, score and rank (from 1).
    """
    rows = df.select(*[F.col(g).alias(f"g{i}") for i, g in enumerate(groups)], F.col(score).cast("double").alias("score"), F.col(item).alias("item"))
    keys = [f"g{i}" for i in range(len(groups))]
    for c in [*keys, "score", "item"]:
        rows = rows.filter(F.col(c).isNotNull())
    rows = rows.filter(~F.isnan("score"))

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= CHUNK_ROWS:
                yield from _chunk_bounds(pa.Table.from_batches(held), keys, n).to_batches()
                held, count = [], 0
        if count:
            yield from _chunk_bounds(pa.Table.from_batches(held), keys, n).to_batches()

    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in rows.schema])
    local = rows.mapInArrow(bounds, schema)
    best = cut(local.groupBy(*keys).agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("item").alias("i"))).alias("bound")))
    best = best.select(*[F.col(k).alias(f"b_{k}") for k in keys], "bound")
    on = [F.col(k) == F.col(f"b_{k}") for k in keys]
    position = F.struct((-F.col("score")).alias("s"), F.col("item").alias("i"))
    kept = rows.join(checked_broadcast(best), on, "left").filter(F.col("bound").isNull() | (position <= F.col("bound"))).select(*keys, "score", "item")
    # One exchange: the grouping by (group, item) and the window both run on the partitioning by group.
    once = kept.repartition(*keys).groupBy(*keys, "item").agg(F.max("score").alias("score"))
    w = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("item").asc())
    ranked = once.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    return ranked.select(*[F.col(k).alias(g) for k, g in zip(keys, groups)], F.col("item").alias(item), F.col("score").alias(score), "rank")
