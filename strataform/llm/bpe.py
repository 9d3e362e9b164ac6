"""Byte-level BPE with a public vocabulary, by a segment tree over the ranks of adjacent pairs."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folder of the public vocabulary files; a parameter of every function that needs one.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
# The pattern published with the vocabulary, which splits text before any merge.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces that a worker remembers; the memory is emptied when full, which changes no result.
REMEMBERED = 200_000
#: Pieces longer than this are encoded each time they are met.
LONG = 64
NONE = 1 << 40


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> id (which is also the rank) of a file with one base64 token and id a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece.

    A segment tree holds, at each leaf i, the rank of the pair that starts at byte i (NONE where there is none) and at each
    inner node the lesser of its children, the left one on ties. Its root therefore names the leftmost pair of lowest rank.
    A merge changes three leaves, so it costs the logarithm of the length; it ends when the root is NONE.
    """
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    size = 1 << (n - 1).bit_length()
    end = [i + 1 for i in range(n)]  # where the token that starts at i ends
    before = [i - 1 for i in range(n)]  # where the token before it starts
    tree = [NONE] * (2 * size)
    get = ranks.get
    for i in range(n - 1):
        tree[size + i] = get(piece[i : i + 2], NONE)
    for k in range(size - 1, 0, -1):
        left, right = tree[2 * k], tree[2 * k + 1]
        tree[k] = left if left <= right else right

    def put(i: int, rank: int) -> None:
        k = size + i
        tree[k] = rank
        k >>= 1
        while k:
            left, right = tree[2 * k], tree[2 * k + 1]
            least = left if left <= right else right
            if tree[k] == least:
                return
            tree[k] = least
            k >>= 1

    while tree[1] < NONE:
        least, k = tree[1], 1
        while k < size:
            k = 2 * k if tree[2 * k] == least else 2 * k + 1
        i = k - size
        j = end[i]
        stop = end[j]
        end[i] = stop
        put(j, NONE)
        if stop < n:
            before[stop] = i
            put(i, get(piece[i : end[stop]], NONE))
        else:
            put(i, NONE)
        if before[i] >= 0:
            put(before[i], get(piece[before[i] : stop], NONE))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Encoder:
    """Encodes texts; one lives in each Python worker."""

    def __init__(self, path: str) -> None:
        self.ranks = read_ranks(path)
        self.pieces = regex.compile(PATTERN).findall
        self.known: dict[str, list[int]] = {}

    def __call__(self, text: str | None) -> list[int]:
        out: list[int] = []
        known = self.known
        for piece in self.pieces(text or ""):
            ids = known.get(piece)
            if ids is None:
                ids = merge_piece(piece.encode("utf-8"), self.ranks)
                if len(piece) <= LONG:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[piece] = ids
            out += ids
        return out


_ENCODERS: dict[str, Encoder] = {}


def encode_texts(df: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """key and ids (array of int) of every row, in one pass without a shuffle.

    No special tokens: their strings in a text are ordinary text. Null and empty texts give an empty list. Very long
    texts and pieces cost n log n. Repeated rows come out as often as they are; keys may be null. Texts must be valid
    Unicode, as Spark's strings are; path names a .tiktoken rank file present on every executor.
    """
    path = path or f"{TOKENIZERS}/byte_bpe_50k.tiktoken"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _ENCODERS:
            _ENCODERS[path] = Encoder(path)
        encoder = _ENCODERS[path]
        for batch in batches:
            for start in range(0, max(batch.num_rows, 1), 1000):
                part = batch.slice(start, 1000)
                lists = [encoder(t) for t in part.column(1).to_pylist()]
                offsets = np.zeros(len(lists) + 1, dtype=np.int32)
                np.cumsum([len(x) for x in lists], out=offsets[1:])
                flat = np.fromiter((i for x in lists for i in x), dtype=np.int32, count=int(offsets[-1]))
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["k", "ids"])

    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t"))
    schema = T.StructType([T.StructField("k", rows.schema["k"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return rows.mapInArrow(encode, schema).withColumnRenamed("k", key)
