"""Evaluation passages inside training texts, by the q-gram lemma on diagonals and banded alignment."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import dataset, fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataform.runtime import ensure_checkpoint_dir

#: Characters of evaluation text that one index holds; more items are taken in further blocks.
BLOCK_CHARS = 4_000_000
#: Characters of training text that a task handles at once.
CHUNK_CHARS = 2_000_000
#: Most and fewest characters of a q-gram; shorter ones are met too often by chance.
MOST_Q, LEAST_Q = 16, 8
_BASE = np.uint64(0x9E3779B97F4A7C15)
_TABLE_BITS = 22


def plain_words(text: str | F.Column) -> F.Column:
    """Lower-case words (runs of letters and digits), each followed by one blank, the first preceded by one; null stays null."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{Nd}]+", " ")), F.lit(" "))


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each closed by 0, and where each starts."""
    joined = "\0".join(texts) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return points, starts


def gram_size(min_words: int, edits: int) -> int:
    """Characters of a q-gram: min_words words take m = 2 * min_words + 1 characters with their blanks, and m - q + 1 - edits * q
    of their q-grams survive that many edits, which must be at least one."""
    q = min(MOST_Q, (2 * min_words + 1) // (edits + 1))
    if q < LEAST_Q:
        raise ValueError(f"too few words for so many edits: q-grams would be shorter than {LEAST_Q} characters")
    return q


def _grams(points: np.ndarray, q: int) -> np.ndarray:
    """A hash of the q characters from each place on."""
    n = len(points) - q + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    for j in range(q):
        h *= _BASE
        h += points[j : j + n]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


@dataclass
class PassageIndex:
    """The q-grams of a block of evaluation items, sorted by hash."""

    q: int
    items: int
    points: np.ndarray
    starts: np.ndarray
    hashes: np.ndarray
    places: np.ndarray
    table: np.ndarray

    @classmethod
    def build(cls, texts: list[str], q: int) -> PassageIndex:
        points, starts = _points(texts)
        h = _grams(points, q)
        inside = np.cumsum(points == 0)
        whole = np.flatnonzero(inside[q - 1 :][: len(h)] - np.r_[0, inside][: len(h)] == 0) if len(h) else np.zeros(0, int)
        order = whole[np.argsort(h[whole], kind="stable")]
        table = np.zeros(1 << _TABLE_BITS, dtype=bool)
        table[(h[order] & np.uint64((1 << _TABLE_BITS) - 1)).astype(np.int64)] = True
        return cls(q, len(texts), points, starts, h[order], order, table)

    def hits(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places (in points, in the items) that share a q-gram."""
        h = _grams(points, self.q)
        at = np.flatnonzero(self.table[(h & np.uint64((1 << _TABLE_BITS) - 1)).astype(np.int64)]) if len(h) else np.zeros(0, int)
        lo = np.searchsorted(self.hashes, h[at], "left")
        n = np.searchsorted(self.hashes, h[at], "right") - lo
        at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
        first = np.cumsum(n) - n
        return np.repeat(at, n), self.places[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(first, n)]


def banded_run(a: np.ndarray, b: np.ndarray, low: int, high: int) -> int:
    """Most whole words in a row shared by two texts (blank before and after each word) on diagonals low to high (place in a less place in b)."""
    best = 0
    for d in range(low, high + 1):
        i, j = max(0, d), max(0, -d)
        n = min(len(a) - i, len(b) - j)
        if n <= 0:
            continue
        same = a[i : i + n] == b[j : j + n]
        edges = np.flatnonzero(np.diff(np.r_[False, same, False].astype(np.int8)))
        blanks = np.r_[0, np.cumsum(a[i : i + n] == 32)]
        for s, e in zip(edges[::2], edges[1::2]):
            best = max(best, int(blanks[e] - blanks[s]) - 1)
    return best


def banded_distance(passage: np.ndarray, text: np.ndarray, low: int, high: int, most: int) -> int:
    """Least edits that turn passage into some stretch of text, on diagonals (place in text less place in passage) low to high; most + 1 if more."""
    width = high - low + 1
    shown = np.full(len(passage) + width, 0xFFFFFFFF, dtype=np.int64)  # text on the band, beyond its ends nothing
    a, b = max(low, 0), min(len(text), low + len(shown))
    if b > a:
        shown[a - low : b - low] = text[a:b]
    cost = np.zeros(width, dtype=np.int64)  # a stretch may start anywhere on the band
    for i, c in enumerate(passage.tolist()):
        now = cost + (shown[i : i + width] != c)
        now[:-1] = np.minimum(now[:-1], cost[1:] + 1)
        for d in range(1, width):
            now[d] = min(now[d], now[d - 1] + 1)
        cost = now
        if cost.min() > most:
            return most + 1
    return int(cost.min())


def _holds(index: PassageIndex, item: int, text: np.ndarray, places: np.ndarray, low: int, high: int, min_words: int, edits: int) -> bool:
    """Whether min_words words in a row of an item that touch these places lie on the band of a text within so many edits."""
    b = index.points[index.starts[item] : index.starts[item + 1] - 1]
    if not edits:
        return banded_run(text, b, low, high) >= min_words
    blanks = np.flatnonzero(b == 32)
    first, last = np.searchsorted(blanks, places.min(), "right") - 1, np.searchsorted(blanks, places.max(), "right")
    for w in range(max(0, first - min_words), min(len(blanks) - min_words, last + 1)):
        s, e = blanks[w], blanks[w + min_words] + 1
        if banded_distance(b[s:e], text, s + low - edits, s + high + edits, edits) <= edits:
            return True
    return False


def leaked_pairs(index: PassageIndex, texts: list[str], min_words: int, edits: int = 0) -> list[tuple[int, int]]:
    """(number of text, number of item) of all pairs that share at least min_words words in a row with at most so many edits.

    min_words words take at least m = 2 * min_words + 1 characters with their blanks. By the q-gram lemma at least
    m - q + 1 - edits * q of their q-grams are shared, on diagonals no more than edits apart. Hits are counted in
    overlapping bands of diagonals; bands with fewer hits are dropped, the rest is verified by alignment on the band.
    Without edits a band is one diagonal and its hits lie in a row.
    """
    points, starts = _points(texts)
    at, place = index.hits(points)
    if not len(at):
        return []
    doc = np.searchsorted(starts, at, "right") - 1
    item = np.searchsorted(index.starts, place, "right") - 1
    diagonal = (at - starts[doc]) - (place - index.starts[item])
    key = doc * index.items + item
    least = 2 * min_words + 2 - index.q * (edits + 1)
    found: set[int] = set()

    def verify(k: int, rows: np.ndarray, low: int, high: int) -> None:
        if k not in found:
            d, i = divmod(k, index.items)
            if _holds(index, i, points[starts[d] : starts[d + 1] - 1], place[rows] - index.starts[i], low, high, min_words, edits):
                found.add(k)

    if not edits:
        order = np.lexsort((at, diagonal, key))
        k, dg, a = key[order], diagonal[order], at[order]
        first = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (dg[1:] != dg[:-1]) | (a[1:] != a[:-1] + 1)])
        length = np.diff(np.r_[first, len(a)])
        blanks = np.r_[0, np.cumsum(points == 32)]
        words = blanks[a[first] + length - 1 + index.q] - blanks[a[first]] - 1
        for x in first[(length >= least) & (words >= min_words)].tolist():
            verify(int(k[x]), order[x : x + 1], int(dg[x]), int(dg[x]))
    else:
        for shift in (0, edits + 1):
            band = (diagonal + shift) // (2 * (edits + 1))
            order = np.lexsort((at, band, key))
            k, b = key[order], band[order]
            first = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (b[1:] != b[:-1])])
            for x, n in zip(first.tolist(), np.diff(np.r_[first, len(k)]).tolist()):
                if n >= least:
                    rows = order[x : x + n]
                    verify(int(k[x]), rows, int(diagonal[rows].min()), int(diagonal[rows].max()))
    return [divmod(k, index.items) for k in sorted(found)]


#: Indexes that a worker holds at once; more blocks are taken in further passes over the corpus.
HELD_BLOCKS = 4
_INDEXES: dict[str, tuple[pa.Array, PassageIndex]] = {}


def _index(folder: str, block: int, q: int) -> tuple[pa.Array, PassageIndex]:
    """Ids and index of one block, built once in each worker from the shared folder, whose name is unique to the run."""
    name = f"{folder}/block={block}"
    if name not in _INDEXES:
        if len(_INDEXES) >= HELD_BLOCKS:
            _INDEXES.clear()
        files, path = (fs.LocalFileSystem(), "/" + name[5:].lstrip("/")) if name.startswith("file:") else fs.FileSystem.from_uri(name)
        rows = dataset.dataset(path, filesystem=files, format="parquet").to_table(columns=["i", "w"])
        _INDEXES[name] = (rows["i"].combine_chunks(), PassageIndex.build(rows["w"].to_pylist(), q))
    return _INDEXES[name]


def find_leaks(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, min_words: int = 10, edits: int = 0) -> DataFrame:
    """(doc_id, item_id) of every document and item that share at least min_words words in a row, each pair once.

    edits: characters that may be changed, left out or put in within these words. The items are written to the shared folder
    in blocks of about BLOCK_CHARS characters and indexed where they are searched; the corpus streams past up to HELD_BLOCKS
    blocks at once without a shuffle. Ids may be of any type. Null texts and texts with too few words share nothing, nor do
    rows with a null id; repeated rows are reported once. Whole texts are searched.
    """
    q = gram_size(min_words, edits)
    spark = docs.sparkSession
    least = 2 * min_words - edits
    pairs = items.filter(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).alias("i"), plain_words(item_text).alias("w")).filter(F.length("w") > least)
    corpus = docs.filter(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("d"), plain_words(text).alias("w")).filter(F.length("w") > least)
    schema = T.StructType([T.StructField("d", corpus.schema["d"].dataType), T.StructField("i", pairs.schema["i"].dataType)])
    chars = pairs.agg(F.sum(F.length("w"))).first()[0] or 0
    blocks = -(-chars // BLOCK_CHARS)
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/passages-{uuid4().hex}"
    put = pairs.withColumn("block", F.pmod(F.xxhash64("i"), F.lit(max(1, blocks))).cast("int"))
    put.repartition("block").write.partitionBy("block").parquet(folder)
    there = sorted(r[0] for r in put.select("block").distinct().collect())

    def search(some: list[int]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, words = batch.column(0), batch.column(1).to_pylist()
                start = size = 0
                for k, w in enumerate(words):
                    size += len(w)
                    if size >= CHUNK_CHARS or k == len(words) - 1:
                        for block in some:
                            names, index = _index(folder, block, q)
                            got = leaked_pairs(index, words[start : k + 1], min_words, edits)
                            yield pa.RecordBatch.from_arrays([ids.take(pa.array([start + x for x, _ in got], pa.int64())), names.take(pa.array([y for _, y in got], pa.int64()))], names=["d", "i"])
                        start, size = k + 1, 0

        return corpus.mapInArrow(run, schema)

    found = spark.createDataFrame([], schema)
    for at in range(0, len(there), HELD_BLOCKS):
        found = found.unionByName(search(there[at : at + HELD_BLOCKS]))
    return found.distinct().select(F.col("d").alias(doc_id), F.col("i").alias(item_id))


def brute_leaks(docs: pd.DataFrame, items: pd.DataFrame, min_words: int) -> set[tuple[int, int]]:
    """The same by sets of word n-grams, for tests; columns id and words (a list)."""
    grams: dict[tuple[str, ...], set[int]] = {}
    for i, w in zip(items.id, items.words):
        for k in range(len(w) - min_words + 1):
            grams.setdefault(tuple(w[k : k + min_words]), set()).add(i)
    return {(d, i) for d, w in zip(docs.id, docs.words) for k in range(len(w) - min_words + 1) for i in grams.get(tuple(w[k : k + min_words]), ())}
