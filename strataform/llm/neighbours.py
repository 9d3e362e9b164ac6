"""Most similar vectors of every vector, over a hierarchical k-means tree."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataform.llm.vectortree import MAX_LEAVES, Tree, unit
from strataform.runtime import BROADCAST_LIMIT, checked_broadcast, cores, cut, file_system, kept, row_bytes, shared_folder

#: Vectors of the sample on which the tree is fitted (a fixed bound; every vector is indexed).
SAMPLE = 65_536
#: Vectors a leaf is to hold.
LEAF = 1024
#: Queries of the calibration, each compared with all vectors, and the recall they must reach.
CALIBRATION, RECALL = 256, 0.98
#: Members of one batch and queries asked at once; leaves with more are cut into several batches.
CELL_MEMBERS, CELL_QUERIES = 8192, 32_768
#: Rows of the batches that a worker holds.
HELD_ROWS = 200_000
#: Rows of equal vectors that meet one result row in a task.
COPIES = 100_000

_BATCHES: dict[tuple[str, tuple[str, int, int]], tuple] = {}


def valid_vectors(df: DataFrame, key: str, vector: str, size: int, latest: str | None = None) -> DataFrame:
    """(id, vector): one row a key, of vectors with size finite numbers that aren't all zero.

    Null keys and null, empty, wrong-length, not finite or zero vectors are dropped. Of several rows of a key the one last
    by latest counts, then the greatest vector.
    """
    rows = df.select(F.col(key).alias("id"), F.col(vector).alias("vector"), (F.col(latest) if latest else F.lit(0)).alias("at"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = rows.filter(F.col("id").isNotNull() & (F.size("vector") == size)).filter(finite & F.exists("vector", lambda x: x != 0))
    return good.groupBy("id").agg(F.max(F.struct("at", "vector")).alias("m")).select("id", "m.vector")


def with_classes(vectors: DataFrame, keep: int) -> tuple[DataFrame, DataFrame]:
    """(id, vector, rep, copies) and further columns of every vector, and the same with place of the first keep of each class.

    Vectors equal in every number form a class (told by two 64-bit hashes); rep is its smallest id. place counts from 1 in
    the order of ids and is set only in the second result. The vectors are kept once; both results read them there.
    """
    hashed = lambda df: df.withColumn("k1", F.xxhash64("vector")).withColumn("k2", F.xxhash64(F.reverse("vector"), F.lit(7)))
    v = hashed(kept(vectors, "vectors"))
    dup = cut(v.select("id", "k1", "k2").groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).filter("copies > 1"))
    small = dup.count() * row_bytes(dup) <= BROADCAST_LIMIT
    marked = v.join(F.broadcast(dup) if small else dup, ["k1", "k2"], "left").select(*vectors.columns, F.coalesce("rep", "id").alias("rep"), F.coalesce("copies", F.lit(1)).alias("copies"))
    marked = marked if small else kept(marked, "marked")
    alone = marked.filter("copies = 1").withColumn("place", F.lit(1))
    w = Window.partitionBy("rep").orderBy("id")
    first = marked.filter("copies > 1").withColumn("place", F.row_number().over(w)).filter(F.col("place") <= keep)
    return marked, alone.unionByName(cut(first))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(a, pa.ChunkedArray):
        a = pa.concat_arrays(a.chunks)
    return a.flatten().to_numpy(zero_copy_only=False).reshape(len(a), -1) if len(a) else np.zeros((0, 1), np.float32)


def _map(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield f(batch)

    return df.mapInArrow(run, schema)


def fit_tree(vectors: DataFrame, rows: int, leaf: int) -> Tree:
    """The tree of (id, vector), fitted on at most about SAMPLE vectors chosen by the hash of their id."""
    share = min(1.0, SAMPLE / max(1, rows))
    chosen = vectors.filter(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1) if share < 1 else vectors
    sample = chosen.select("id", "vector").orderBy("id").limit(2 * SAMPLE).toArrow()
    return Tree.fit(unit(_matrix(sample["vector"])), min(MAX_LEAVES, math.ceil(rows / leaf)))


@dataclass
class Leaves:
    """Where the members of every leaf lie: leaf -> [(file, number of the batch, rows)]; batches are read when asked for."""

    folder: str
    parts: dict[int, list[tuple[str, int, int]]]

    def batch(self, part: tuple[str, int, int]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """Ids, vectors, unit vectors in single precision and whether each is asked, of one batch; the last ones are kept."""
        got = _BATCHES.pop((self.folder, part), None)
        if got is None:
            files, path = file_system(f"{self.folder}/{part[0]}")
            with (pa.memory_map(path) if isinstance(files, fs.LocalFileSystem) else files.open_input_file(path)) as f:
                b = pa.ipc.open_file(f).get_batch(part[1])
            x = _matrix(b.column("vector"))
            got = (b.column("id"), x, unit(x).astype(np.float32), b.column("asked").to_numpy(zero_copy_only=False))
            while sum(len(g[1]) for g in _BATCHES.values()) + len(x) > HELD_ROWS and _BATCHES:
                _BATCHES.pop(next(iter(_BATCHES)))
        _BATCHES[self.folder, part] = got
        return got


def write_leaves(members: DataFrame) -> Leaves:
    """(id, vector, asked, leaf), sorted by leaf into files of the shared folder, one batch a leaf or up to CELL_MEMBERS rows of it.

    Only the list of batches passes through the driver. Files of tasks that failed are in no list.
    """
    folder, most = shared_folder(members.sparkSession, "leaves"), CELL_MEMBERS

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = file_system(folder)
        files.create_dir(path, recursive=True)
        name, done, writer, rest = f"{uuid4().hex}.arrow", [], None, None
        for batch in chain(batches, [None]):
            if batch is not None and not batch.num_rows:
                continue
            table = pa.Table.from_batches([b for b in (rest, batch) if b is not None]) if rest is not None or batch is not None else None
            if table is None:
                continue
            leaf = table["leaf"].to_numpy()
            edges = np.flatnonzero(np.r_[True, leaf[1:] != leaf[:-1], True])
            rest = None
            for lo, hi in zip(edges[:-1], edges[1:]):
                for start in range(lo, hi, most):
                    end = min(hi, start + most)
                    part = table.slice(start, end - start).combine_chunks().to_batches()[0]
                    if batch is not None and end == len(leaf) and end - start < most:
                        rest = part  # the leaf may go on
                        continue
                    if writer is None:
                        sink = files.open_output_stream(f"{path}/{name}")
                        writer = pa.ipc.new_file(sink, part.schema)
                    writer.write_batch(part)
                    done.append((int(leaf[lo]), name, len(done), end - start))
        if writer is not None:
            writer.close()
            sink.close()
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.int32(), pa.string(), pa.int32(), pa.int32()))], names=["leaf", "file", "batch", "rows"])

    rows = cut(members.repartitionByRange("leaf", "id").sortWithinPartitions("leaf", "id").mapInArrow(write, "leaf int, file string, batch int, rows int")).collect()
    parts: dict[int, list[tuple[str, int, int]]] = {}
    for r in sorted(rows):
        parts.setdefault(r.leaf, []).append((r.file, r.batch, r.rows))
    return Leaves(folder, parts)


def _best_of(leaves: Leaves, tree: Tree, own: tuple[str, int, int], visits: int, n: int) -> Iterator[pa.RecordBatch]:
    """(rep, best) of the asked vectors of one batch: the n most similar members of the leaves each of them visits.

    Every leaf is compared in single precision with the queries that visit it. What can't be below the n-th best met so
    far is kept, and its cosine is computed in double precision once all leaves are done.
    """
    ids, x, x32, asked = leaves.batch(own)
    mine = np.flatnonzero(asked)
    for first in range(0, len(mine), CELL_QUERIES):
        some = mine[first : first + CELL_QUERIES]
        q64, q32 = unit(x[some]), x32[some]
        bins = tree.best_bins(q32, visits)
        order = np.argsort(bins.ravel(), kind="stable")
        leaf, rank = bins.ravel()[order], order % bins.shape[1]
        edges = np.flatnonzero(np.r_[True, leaf[1:] != leaf[:-1], True])
        spans = sorted(zip(edges[:-1], edges[1:]), key=lambda e: rank[e[0] : e[1]].mean())  # near leaves first: bounds are high soon
        top = np.full((len(some), n), -2, dtype=np.float32)
        found: list[tuple[tuple[str, int, int], np.ndarray, np.ndarray, np.ndarray]] = []
        for lo, hi in spans:
            rows = order[lo:hi] // bins.shape[1]
            for part in leaves.parts.get(int(leaf[lo]), []):
                m32 = leaves.batch(part)[2]
                s = q32[rows] @ m32.T
                bound = top[rows, 0]
                fresh = np.flatnonzero(bound == -2)
                if len(fresh) and len(m32) >= n:
                    bound[fresh] = np.partition(s[fresh], len(m32) - n, axis=1)[:, len(m32) - n]
                at = np.flatnonzero(s >= (bound - 3e-6)[:, None])  # all that may still tie after rounding
                if not len(at):
                    continue
                r, c = np.divmod(at, len(m32))
                value = s[r, c]
                found.append((part, rows[r], c, value))
                by = np.lexsort((-value, r))
                r, value = r[by], value[by]
                head = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
                at = np.arange(len(r)) - np.repeat(head, np.diff(np.r_[head, len(r)]))
                met, in_met = np.unique(r, return_inverse=True)
                more = np.full((len(met), n), -2, dtype=np.float32)
                more[in_met[at < n], at[at < n]] = value[at < n]
                top[rows[met]] = np.sort(np.concatenate([top[rows[met]], more], axis=1), axis=1)[:, n:]
        who, similar, names = [], [], []
        for part, r, c, value in found:
            left = value >= top[r, 0] - 3e-6
            if left.any():
                r, c = r[left], c[left]
                batch_ids, y = leaves.batch(part)[:2]
                who.append(r)
                similar.append(np.round(np.einsum("ij,ij->i", q64[r], unit(y[c])), 6))
                names.append(batch_ids.take(pa.array(c)))
        r, s, name = np.concatenate(who), np.concatenate(similar), pa.concat_arrays(names)
        by = np.lexsort((np.unique(np.array(name.to_pylist(), dtype=object), return_inverse=True)[1], -s, r))
        r, s, name = r[by], s[by], name.take(pa.array(by))
        head = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
        kept_rows = np.flatnonzero(np.arange(len(r)) - np.repeat(head, np.diff(np.r_[head, len(r)])) < n)
        structs = pa.StructArray.from_arrays([pa.array(-s[kept_rows]), name.take(pa.array(kept_rows))], names=["minus", "id"])
        offsets = np.r_[0, np.cumsum(np.bincount(r[kept_rows], minlength=len(some)))].astype(np.int32)
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(some)), pa.ListArray.from_arrays(pa.array(offsets), structs)], names=["rep", "best"])


def _calibrated_visits(spark, vectors: DataFrame, tree: Tree, held, k: int, recall: float) -> int:
    """Leaf visits with which a fixed number of queries, compared with all vectors, find the share recall of their k best."""
    asked = vectors.select("id", "vector").orderBy(F.xxhash64("id", F.lit(5)), "id").limit(CALIBRATION).toArrow()
    ids, x = np.array(asked["id"].to_pylist(), dtype=object), unit(_matrix(asked["vector"])).astype(np.float32)
    if not len(ids):
        return 1
    shared = spark.sparkContext.broadcast((ids, x))

    def best(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, y = np.array(batch.column(0).to_pylist(), dtype=object), unit(_matrix(batch.column(1))).astype(np.float32)
        own, q = shared.value
        s = q @ y.T
        s[own[:, None] == names[None]] = -2
        top = np.argpartition(-s, min(k, s.shape[1]) - 1, axis=1)[:, :k]
        leaves = held.value.assign(y)
        r = np.repeat(np.arange(len(q)), top.shape[1])
        return pa.RecordBatch.from_arrays([pa.array(r, pa.int32()), pa.array(s[r, top.ravel()].astype(np.float64)), pa.array(leaves[top.ravel()], pa.int32())], names=["q", "s", "leaf"])

    w = Window.partitionBy("q").orderBy(F.desc("s"))
    true = _map(vectors.select("id", "vector"), best, "q int, s double, leaf int").filter("s > -2").withColumn("n", F.row_number().over(w)).filter(F.col("n") <= k).select("q", "leaf").collect()
    if not true:
        return 1
    order = tree.best_bins(x, tree.leaves)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order.astype(np.int64), np.broadcast_to(np.arange(order.shape[1]), order.shape), axis=1)
    ranks = np.sort([rank[q, leaf] for q, leaf in true])
    return int(ranks[min(len(ranks) - 1, math.ceil(recall * len(ranks)))]) + 1


def most_similar(df: DataFrame, key: str, vector: str, size: int, k: int, latest: str | None = None, recall: float = RECALL, leaf: int = LEAF) -> DataFrame:
    """(id, neighbour, similarity, rank) of the k most similar vectors of every valid vector (see valid_vectors).

    Similarity is the cosine in double precision, rounded to 6 decimals; of equal ones the smaller id comes first. A
    hierarchical k-means tree is fitted on a bounded sample and indexes every vector; each query takes its leaves best bin
    first by a priority queue, as many as reached the wanted recall on a calibration against all vectors. Members are sorted by
    leaf into files of the shared folder; the task that asks for a leaf's vectors reads the leaves they visit there, so no
    vector is shuffled by visit and a query's list is complete in one task. Of equal vectors only the first k + 1 ids are
    indexed and one is asked, as no others can be among the first k; all of them get their rows. Fewer than k + 1 vectors
    give fewer rows; an empty table gives none.
    """
    spark = df.sparkSession
    marked, first = with_classes(valid_vectors(df, key, vector, size, latest), k + 1)
    marked = cut(marked.filter("copies > 1").select("id", "rep", "copies"))
    rows = first.count()
    if not rows:
        return spark.createDataFrame([], "id string, neighbour string, similarity double, rank int")
    tree = fit_tree(first, rows, leaf)
    held = spark.sparkContext.broadcast(tree)
    visits = _calibrated_visits(spark, first, tree, held, k, recall)

    def put(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = held.value.assign(unit(_matrix(batch.column(1))).astype(np.float32))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int32())], names=["id", "vector", "asked", "leaf"])

    leaves = write_leaves(_map(first.select("id", "vector", (F.col("id") == F.col("rep")).alias("asked")), put, "id string, vector array<float>, asked boolean, leaf int"))
    held_leaves = spark.sparkContext.broadcast(leaves)
    # Batches of neighbouring leaves are asked by one task, as they visit much the same leaves.
    batches = [part for at in sorted(leaves.parts) for part in leaves.parts[at]]
    tasks = min(len(batches), max(4 * cores(spark), rows // 20_000))

    def ask(batch_of: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for numbers in batch_of:
            for i in numbers.column(0).to_pylist():
                yield from _best_of(held_leaves.value, held.value, batches[i], visits, k + 1)

    found = spark.range(0, len(batches), 1, tasks).mapInArrow(ask, "rep string, best array<struct<minus:double,id:string>>")
    merged = kept(found, "merged")  # it is read twice
    # Every member of a class takes the list of its rep, without itself; hot classes are spread over several tasks.
    salts = lambda c: F.ceil(F.col(c) / COPIES).cast("int")
    many = marked.withColumn("salt", F.pmod(F.xxhash64("id"), salts("copies")).cast("int"))
    sizes = checked_broadcast(cut(marked.filter("id = rep").select("rep", salts("copies").alias("salts"))))
    spread = merged.join(sizes, "rep").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    of_many = many.join(spread.select("rep", "salt", "best"), ["rep", "salt"]).select("id", "best")
    of_one = merged.join(sizes.select("rep"), "rep", "left_anti").select(F.col("rep").alias("id"), "best")
    lists = of_one.unionByName(of_many)
    others = lists.select("id", F.posexplode(F.slice(F.filter("best", lambda x: x["id"] != F.col("id")), 1, k)).alias("n", "b"))
    return others.select("id", F.col("b.id").alias("neighbour"), (-F.col("b.minus")).alias("similarity"), (F.col("n") + 1).alias("rank"))
