"""Near-equal vectors across splits, by a full-text index of the evaluation side."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataform.llm.neighbours import Leaves, _matrix, valid_vectors, with_classes, write_leaves
from strataform.llm.symbolindex import CELL, MATCH, ROTATIONS, WordIndex, common_symbols, rotation, words_of
from strataform.llm.vectortree import unit
from strataform.runtime import checked_broadcast, cores, cut

#: Vectors of one shard of the index; more are taken in further shards.
SHARD = 524_288
#: Coordinates at which the words of one band begin.
BAND = 8
#: Vectors that are searched for at once, and pairs that are compared at once.
STEP, PAIRS = 65_536, 100_000
#: Coordinates of a further rotation that are compared first: vectors as near as asked are as near in any of them.
SKETCH = 24
#: Squared distances in single precision may be off by so much; cosines are computed in double at the end.
SLACK = 1e-5

_SHARDS: dict[tuple[str, int, int, int], tuple[pa.Array, np.ndarray, list[WordIndex]]] = {}


def _turned(leaves: Leaves, number: int, k: int, band: int, step: int) -> Iterator[tuple[pa.Array, np.ndarray, list[np.ndarray]]]:
    """Ids, sketches and words of one band of the k-th rotation, of one shard or part, at least step rows at a time."""
    ids, sketches, symbols = [], [], []
    parts = leaves.parts.get(number, [])
    for i, part in enumerate(parts):
        names, _, x, _ = leaves.batch(part)
        size = x.shape[1]
        turn = rotation(size, k)[:, band : min(size, band + BAND + MATCH - 1)].astype(np.float32)
        ids.append(names)
        sketches.append(x @ rotation(size, ROTATIONS)[:, :SKETCH].astype(np.float32))
        symbols.append((np.floor(x @ turn / np.float32(CELL)) + np.ceil(1 / CELL)).astype(np.uint8))
        if sum(map(len, ids)) >= step or i == len(parts) - 1:
            yield pa.concat_arrays(ids), np.concatenate(sketches), list(words_of(np.concatenate(symbols), MATCH))
            ids, sketches, symbols = [], [], []


def _shard(leaves: Leaves, number: int, k: int, band: int) -> tuple[pa.Array, np.ndarray, list[WordIndex]]:
    """Ids, sketches and indexes of one band of a shard; a worker holds the last ones."""
    name = (leaves.folder, number, k, band)
    if name not in _SHARDS:
        _SHARDS.clear()
        ids, sketches, words = next(_turned(leaves, number, k, band, 1 << 62))
        _SHARDS[name] = (ids, sketches, [WordIndex.build(w) for w in words])
    return _SHARDS[name]


def _near(shards: Leaves, shard: int, queries: Leaves, part: int, k: int, band: int, cosine: float) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Ids of pairs of a shard and a part of the queries that share a word of one band of one rotation and may have the cosine."""
    ids, sketches, indexes = _shard(shards, shard, k, band)
    most = 2 - 2 * cosine + SLACK
    for names, own, words in _turned(queries, part, k, band, STEP):
        found = [np.zeros(0, dtype=np.int64)]
        for index, word in zip(indexes, words):
            for l, r in index.hits(word, PAIRS):  # noqa: E741
                d = own[l] - sketches[r]
                good = np.einsum("ij,ij->i", d, d) <= most
                found.append(l[good] * len(ids) + r[good])
        l, r = np.divmod(np.unique(np.concatenate(found)), len(ids))  # noqa: E741
        yield names.take(pa.array(l)), ids.take(pa.array(r))


def near_equal_across(df: DataFrame, sides: DataFrame, key: str, vector: str, size: int, cosine: float, latest: str | None = None, shared: bool = False) -> DataFrame:
    """(left_id, right_id) of pairs, one of side a and one of side b, whose vectors have at least that cosine.

    sides has id and side (a or b); ids without a side or a valid vector take no part, an id of both sides takes part in
    both but never with itself. With shared a third column gives the symbols of their maximal matches under all rotations.
    The vectors of side b (held-out splits) are indexed in shards of bounded size, a band of words of one rotation at a
    time; those of side a stream past every band (see symbolindex): pairs with enough equal symbols in a row are candidates.
    Those too far apart in a few coordinates are dropped, the cosine of the others is computed exactly, so every pair is right. A pair at the very limit
    of 0.98 has no long enough match under any rotation in about 1 of 20,000 cases, closer ones far more rarely. Equal
    vectors are compared once and then expanded. Repeated rows change nothing; an empty table gives no rows.
    """
    spark = df.sparkSession
    roles = sides.groupBy("id").agg(F.bool_or(F.col("side") == "a").alias("a"), F.bool_or(F.col("side") == "b").alias("b"))
    marked, first = with_classes(valid_vectors(df, key, vector, size, latest).join(roles, "id"), 1)
    classes = cut(marked.select("id", "rep", "copies", "a", "b"))
    of_many = cut(classes.filter("copies > 1").groupBy("rep").agg(F.bool_or("a").alias("any_a"), F.bool_or("b").alias("any_b")))
    reps = first.filter("id = rep").join(checked_broadcast(of_many), "rep", "left").select("id", "vector", F.coalesce("any_a", "a").alias("a"), F.coalesce("any_b", "b").alias("b"))
    held_out, asked = reps.agg(F.count_if("b"), F.count_if("a")).first()
    pair = "left_id string, right_id string" + (", shared bigint" if shared else "")
    if not held_out or not asked:
        return spark.createDataFrame([], pair)
    shards = -(-held_out // SHARD)
    bands = range(0, max(1, size - MATCH + 1), BAND)
    # At least two tasks a core, and some million vectors a task at most.
    parts = max(-(-2 * cores(spark) // (shards * ROTATIONS * len(bands))), -(-asked // 2_000_000))
    number = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n)).cast("int").alias("leaf")
    held = spark.sparkContext.broadcast(tuple(write_leaves(reps.filter(side).select("id", "vector", F.lit(True).alias("asked"), number(n, salt))) for side, n, salt in (("b", shards, 3), ("a", parts, 4))))
    work = [(s, p, k, band) for s in held.value[0].parts for p in held.value[1].parts for k in range(ROTATIONS) for band in bands]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, queries = held.value
        for batch in batches:
            for i in batch.column(0).to_pylist():
                s, p, k, band = work[i]
                for l, r in _near(index, s, queries, p, k, band, cosine):  # noqa: E741
                    yield pa.RecordBatch.from_arrays([l, r], names=["l", "r"])

    found = cut(spark.range(0, len(work), 1, len(work)).mapInArrow(run, "l string, r string").distinct())

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = unit(_matrix(batch.column(2))), unit(_matrix(batch.column(3)))
                good = np.flatnonzero(np.einsum("ij,ij->i", x, y) >= cosine - 1e-12)
                n = common_symbols(x[good], y[good])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(good)), batch.column(1).take(pa.array(good)), pa.array(n)], names=["l", "r", "shared"])

    # Few vectors are in a pair; only those are read again.
    met = found.select(F.explode(F.array("l", "r")).alias("id")).distinct()
    vectors = cut(reps.select("id", "vector").join(checked_broadcast(cut(met)), "id"))
    both = found.join(vectors.select(F.col("id").alias("l"), F.col("vector").alias("x")), "l").join(vectors.select(F.col("id").alias("r"), F.col("vector").alias("y")), "r")
    pairs = cut(both.select("l", "r", "x", "y").mapInArrow(exact, "l string, r string, shared bigint"))
    of_a = classes.filter("a").select(F.col("rep").alias("l"), F.col("id").alias("left_id"))
    of_b = classes.filter("b").select(F.col("rep").alias("r"), F.col("id").alias("right_id"))
    return pairs.join(of_a, "l").join(of_b, "r").filter("left_id <> right_id").select("left_id", "right_id", *(["shared"] if shared else []))
