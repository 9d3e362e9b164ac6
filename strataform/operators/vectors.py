"""Cosine scores, exact nearest neighbours with group exclusion, and features from neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataform.functions.numeric import dot, l2_normalise
from strataform.operators.contracts import ContractError

#: Query vectors that are held at once while the corpus streams past.
BLOCK = 4096


def checked_unit(df: DataFrame, vector: str, tolerance: float = 1e-3) -> DataFrame:
    """Raises if a vector is null, not finite or not of unit length."""
    n = dot(F.col(vector), F.col(vector))
    bad = df.filter(F.coalesce(F.isnan(n) | (F.abs(n - 1) > tolerance), F.lit(True))).limit(1).count()
    if bad:
        raise ContractError("a vector is not of unit length")
    return df


def blocks(rows: DataFrame) -> Iterator[list]:
    """Rows on the driver, at most BLOCK at a time."""
    block: list = []
    for row in rows.toLocalIterator():
        block.append(row)
        if len(block) == BLOCK:
            yield block
            block = []
    if block:
        yield block


def cosine_scores(left: DataFrame, right: DataFrame, left_id: str, right_id: str, vector: str) -> DataFrame:
    """Cosine of every row of left with every row of right, which is taken in blocks of at most BLOCK rows, each broadcast once."""
    a = left.select(left_id, l2_normalise(F.col(vector)).alias("_a"))
    b = right.select(right_id, l2_normalise(F.col(vector)).alias("_b"))
    found = None
    for block in blocks(b):
        one = a.crossJoin(F.broadcast(left.sparkSession.createDataFrame(block, b.schema))).select(left_id, right_id, dot(F.col("_a"), F.col("_b")).alias("similarity"))
        found = one if found is None else found.unionByName(one)
    return a.crossJoin(b).select(left_id, right_id, dot(F.col("_a"), F.col("_b")).alias("similarity")).filter("false") if found is None else found


def nearest(queries: DataFrame, corpus: DataFrame, key: str, group: str, vector: str, k: int, floor: float | None = None, decimals: int = 6) -> DataFrame:
    """(query, neighbour, similarity, rank): the k most similar corpus rows of another group, exactly.

    The stated query set is taken in blocks of at most BLOCK vectors, each broadcast once; the corpus streams past every
    block and every partition keeps only its own k best of each query, so what is shuffled doesn't grow with the corpus.
    Own-group rows are left out before ranking. Equal similarities (rounded) go to the smaller key; null groups exclude
    nothing. Fewer than k candidates give fewer rows.
    """
    spark = queries.sparkSession
    q = queries.select(F.col(key).cast("bigint").alias("id"), F.col(group).cast("string").alias("g"), F.col(vector).cast("array<double>").alias("v"))
    c = corpus.select(F.col(key).cast("bigint").alias("id"), F.col(group).cast("string").alias("g"), F.col(vector).cast("array<double>").alias("v"))
    schema = "query bigint, neighbour bigint, similarity double"
    found = None

    def unit(v: list) -> np.ndarray:
        x = np.array(v, dtype=np.float64)
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)

    def search(rows: list) -> DataFrame:
        held = spark.sparkContext.broadcast((np.array([r["id"] for r in rows]), np.array([r["g"] for r in rows], dtype=object), unit([r["v"] for r in rows])))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, groups, x = held.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                names = batch.column(0).to_numpy()
                s = np.round(x @ unit(batch.column(2).to_pylist()).T, decimals)
                own = np.array(batch.column(1).to_pylist(), dtype=object)
                s[(groups[:, None] == own[None]) & np.not_equal(own, None)[None]] = -np.inf
                order = np.lexsort((np.broadcast_to(names, s.shape), -s), axis=1)[:, :k]
                r = np.repeat(np.arange(len(ids)), order.shape[1])
                best = s[r, order.ravel()]
                keep = (best > -np.inf) & (best >= (floor if floor is not None else -2))
                yield pa.RecordBatch.from_arrays([pa.array(ids[r][keep]), pa.array(names[order.ravel()][keep]), pa.array(best[keep])], names=["query", "neighbour", "similarity"])

        return c.mapInArrow(run, schema)

    block: list = []
    for row in q.toLocalIterator():
        block.append(row)
        if len(block) == BLOCK:
            found, block = (search(block) if found is None else found.unionByName(search(block))), []
    if block or found is None:
        found = search(block) if found is None and block else found.unionByName(search(block)) if block else spark.createDataFrame([], schema)
    w = Window.partitionBy("query").orderBy(F.col("similarity").desc(), F.col("neighbour").asc())
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def neighbour_features(neighbours: DataFrame, labels: DataFrame, ks: list[int]) -> DataFrame:
    """(query, k, fraction, n_known, mean_similarity) for each k; fraction is null if no neighbour has a label.

    labels: (neighbour, label), at most one row each; null labels are unknown.
    """
    joined = neighbours.join(labels, "neighbour", "left").withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).filter("rank <= k")
    return joined.groupBy("query", "k").agg(F.avg(F.col("label").cast("double")).alias("fraction"), F.count("label").alias("n_known"), F.avg("similarity").alias("mean_similarity"))


def case_evidence(neighbours: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """(query, ids, similarities, pos, known) with ordered arrays of at most k neighbours."""
    joined = neighbours.filter(F.col("rank") <= k).join(labels, "neighbour", "left")
    cases = joined.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "neighbour", "similarity"))).alias("c"), F.count_if(F.col("label") == 1).alias("pos"), F.count("label").alias("known"))
    return cases.select("query", F.col("c.neighbour").alias("ids"), F.transform("c.similarity", lambda x: F.round(x, 4)).alias("similarities"), "pos", "known")


def weighted_votes(neighbours: DataFrame, votes: DataFrame, absent_weight: float, min_support: float) -> DataFrame:
    """(query, concept, present, absent, support): one vote a neighbour and concept, weighted by similarity.

    votes: (neighbour, concept, polarity), repeats counted once; absent votes weigh absent_weight.
    """
    one = votes.select("neighbour", "concept", "polarity").distinct()
    s = F.col("similarity")
    out = neighbours.join(one, "neighbour").groupBy("query", "concept").agg(F.sum(F.when(F.col("polarity") == "present", s).otherwise(0.0)).alias("present"), F.sum(F.when(F.col("polarity") == "absent", s * absent_weight).otherwise(0.0)).alias("absent"))
    return out.withColumn("support", F.col("present") - F.col("absent")).filter(F.greatest("present", "absent") >= min_support)


def index_contract(corpus: DataFrame, key: str, vector: str, size: int, split: str | None = None) -> DataFrame:
    """One row: rows, distinct keys, wrong sizes, rows outside train, and a hash of all keys."""
    outside = F.count_if(F.col(split) != "train") if split else F.lit(0).cast("bigint")
    return corpus.agg(F.count("*").alias("rows"), F.countDistinct(key).alias("keys"), F.count_if(F.size(vector) != size).alias("wrong_size"), outside.alias("outside_train"), F.sum(F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 31))).alias("key_hash"))


def box_cells(boxes: DataFrame, grid: int, width: Column, height: Column) -> DataFrame:
    """Share of every grid cell that a box covers, as rows (.., cell_x, cell_y, share) of the covered cells only.

    A box generates just its own cells by arithmetic, so there is no join with the grid.
    """
    cw, ch = width / grid, height / grid
    cells = lambda lo, hi, step: F.sequence(F.greatest(F.floor(lo / step), F.lit(0)).cast("int"), F.least(F.ceil(hi / step) - 1, F.lit(grid - 1)).cast("int"))
    good = boxes.filter("x2 > x1 and y2 > y1").withColumn("cell_x", F.explode(cells(F.col("x1"), F.col("x2"), cw))).withColumn("cell_y", F.explode(cells(F.col("y1"), F.col("y2"), ch)))
    part = lambda lo, hi, i, step: F.greatest(F.lit(0.0), F.least(hi, (i + 1) * step) - F.greatest(lo, i * step)) / step
    return good.withColumn("share", part(F.col("x1"), F.col("x2"), F.col("cell_x"), cw) * part(F.col("y1"), F.col("y2"), F.col("cell_y"), ch)).filter("share > 0")


def run_lengths(df: DataFrame, rle: str) -> DataFrame:
    """Rows with start and length (bigint) for every run of a text 'start length start length ...' (starts from 1)."""
    n = F.transform(F.filter(F.split(F.trim(rle), r"\s+"), lambda x: x != ""), lambda x: x.cast("bigint"))
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("_n") / 2).cast("int") - 1), lambda i: F.struct(F.element_at("_n", 2 * i + 1).alias("start"), F.element_at("_n", 2 * i + 2).alias("length")))
    return df.withColumn("_n", n).filter(F.size("_n") >= 2).withColumn("_r", F.explode(pairs)).select(*df.columns, "_r.start", "_r.length")


def mask_shape(runs: DataFrame, key: list[str], width: str) -> DataFrame:
    """Area, bounding box, centroid and widest row of a mask from its runs, without its pixels.

    Runs over a row's end are cut at it first. Positions count from 0.
    """
    first = F.floor((F.col("start") - 1) / F.col(width))
    last = F.floor((F.col("start") + F.col("length") - 2) / F.col(width))
    rows = runs.filter("length > 0").withColumn("row", F.explode(F.sequence(first.cast("bigint"), last.cast("bigint"))))
    lo = F.greatest(F.col("start") - 1, F.col("row") * F.col(width)) - F.col("row") * F.col(width)
    hi = F.least(F.col("start") + F.col("length") - 1, (F.col("row") + 1) * F.col(width)) - F.col("row") * F.col(width)
    cut_rows = rows.withColumn("lo", lo).withColumn("hi", hi).withColumn("n", F.col("hi") - F.col("lo"))
    per_row = cut_rows.groupBy(*key, "row").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum(F.col("n") * (F.col("lo") + F.col("hi") - 1) / 2).alias("sx"))
    return per_row.groupBy(*key).agg(
        F.sum("n").alias("area"), F.min("lo").alias("x_min"), (F.max("hi") - 1).alias("x_max"), F.min("row").alias("y_min"), F.max("row").alias("y_max"),
        (F.sum("sx") / F.sum("n")).alias("x_mean"), (F.sum(F.col("row") * F.col("n")) / F.sum("n")).alias("y_mean"), F.max(F.col("hi") - F.col("lo")).alias("widest"),
    )


def mask_thirds(runs: DataFrame, key: list[str], width: str) -> DataFrame:
    """(key, third, area): the mask's area in three bands of equal height of its vertical extent, the cuts rounded half to even."""
    first = F.floor((F.col("start") - 1) / F.col(width))
    last = F.floor((F.col("start") + F.col("length") - 2) / F.col(width))
    rows = runs.filter("length > 0").withColumn("row", F.explode(F.sequence(first.cast("bigint"), last.cast("bigint"))))
    n = F.least(F.col("start") + F.col("length") - 1, (F.col("row") + 1) * F.col(width)) - F.greatest(F.col("start") - 1, F.col("row") * F.col(width))
    per_row = rows.withColumn("n", n).groupBy(*key, "row").agg(F.sum("n").alias("n"))
    extent = per_row.groupBy(*key).agg(F.min("row").alias("top"), (F.max("row") + 1).alias("bottom"))
    j = per_row.join(extent, key)
    cut_at = lambda k: F.bround(F.col("top") + (F.col("bottom") - F.col("top")) * k / 3)
    third = F.when(F.col("row") < cut_at(1), "upper").when(F.col("row") < cut_at(2), "middle").otherwise("lower")
    return j.groupBy(*key, third.alias("third")).agg(F.sum("n").alias("area"))


def canvas(x: Column, y: Column, width: Column, height: Column, size: int, letterbox: bool) -> list[Column]:
    """Position on a square canvas of that size: stretched, or scaled by the longer side and padded to the middle."""
    if not letterbox:
        return [x * size / width, y * size / height]
    scale = F.lit(float(size)) / F.greatest(width, height)
    new_w, new_h = F.floor(width * scale), F.floor(height * scale)
    return [x * new_w / width + F.floor((size - new_w) / 2), y * new_h / height + F.floor((size - new_h) / 2)]


def chooser_baselines(df: DataFrame, item: list[str], region: str, score: str, size: str, tests: list[str]) -> DataFrame:
    """(item, chooser, tests): each test for the region of the highest score, for the largest, and as expected by chance.

    Equal scores and sizes go to the smaller region; null tests are left out of the mean of chance. Null scores and sizes
    lose against any other.
    """
    w = lambda c: F.row_number().over(Window.partitionBy(*item).orderBy(F.col(c).desc_nulls_last(), F.col(region).asc()))
    ranked = df.withColumn("_s", w(score)).withColumn("_z", w(size))
    per = ranked.groupBy(*item).agg(
        F.max(F.when(F.col("_s") == 1, F.struct(*[F.col(t).cast("double").alias(t) for t in tests]))).alias("model"),
        F.max(F.when(F.col("_z") == 1, F.struct(*[F.col(t).cast("double").alias(t) for t in tests]))).alias("largest_region"),
        F.struct(*[F.avg(F.col(t).cast("double")).alias(t) for t in tests]).alias("random_region"),
    )
    who = F.array(*[F.struct(F.lit(c).alias("chooser"), F.col(c).alias("t")) for c in ("model", "largest_region", "random_region")])
    return per.select(*item, F.explode(who).alias("w")).select(*item, "w.chooser", *[F.col(f"w.t.{t}").alias(t) for t in tests])


def window_bytes(values: Column, low: float = 0.5, high: float = 99.5, invert: bool = False) -> Column:
    """An array clipped to its own exact percentiles (linear between neighbours) and spread over 0 to 255, rounded half up.

    Equal percentiles count as one apart; an empty or null array stays so.
    """
    x = F.array_sort(F.transform(values, lambda v: v.cast("double")))

    def at(q: float) -> Column:
        place = (F.size(x) - 1) * F.lit(q / 100.0)
        below = F.floor(place).cast("int")
        a, b = F.get(x, below), F.get(x, F.least(below + 1, F.size(x) - 1))
        return a + (b - a) * (place - below)

    lo, top = at(low), at(high)
    hi = F.when(top <= lo, lo + 1.0).otherwise(top)
    ends = F.struct(lo.alias("lo"), hi.alias("hi"))
    share = lambda v, e: F.least(F.greatest((v.cast("double") - e["lo"]) / (e["hi"] - e["lo"]), F.lit(0.0)), F.lit(1.0))
    turn = (lambda s: 1.0 - s) if invert else (lambda s: s)
    spread = F.transform(F.array(ends), lambda e: F.transform(values, lambda v: F.floor(turn(share(v, e)) * 255.0 + 0.5).cast("int")))[0]
    return F.when(F.size(values) > 0, spread).otherwise(values.cast("array<int>"))


def rebuild_in_order(shards: DataFrame, ids: DataFrame, row: str, key: str) -> DataFrame:
    """ids (row, key) with the other columns of shards, which hold rows in any order and may repeat a row identically.

    Raises if a row of ids is in no shard, or if a row of the shards is in no id: nothing is filled or dropped in silence.
    """
    once = shards.dropDuplicates([row])
    missing = ids.join(once.select(row), row, "left_anti").count()
    extra = once.join(ids.select(row), row, "left_anti").count()
    if missing or extra:
        raise ContractError(f"{missing} rows are in no shard, {extra} rows of the shards are unknown")
    return ids.select(row, key).join(once.drop(key), row)
