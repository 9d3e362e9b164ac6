"""Readers: delimited text, JSON, archives, arrays, XML, and manifests of files. Each returns a DataFrame with a schema."""

from __future__ import annotations

import bisect
import csv
import hashlib
import io
import json
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataform.operators.contracts import require_columns

#: Bytes of a file that are held at once while it is hashed.
CHUNK = 1 << 22


def delimited(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None, separator: str = ",") -> DataFrame:
    """CSV or TSV (gzip too) with a header and a stated schema; only the named columns are parsed."""
    df = spark.read.csv(path, schema=schema, header=True, sep=separator, mode="FAILFAST", multiLine=False)
    return df.select(*columns) if columns else df


def delimited_checked(spark: SparkSession, path: str, required: list[str], separator: str = "\t") -> DataFrame:
    """All columns as text; raises if a required header is missing."""
    return require_columns(spark.read.csv(path, header=True, sep=separator, inferSchema=False), required)


def delimited_where(spark: SparkSession, path: str, schema: str, keys: DataFrame, key: str) -> DataFrame:
    """Only rows whose key is in keys, by a semi join, so that others are never kept."""
    return delimited(spark, path, schema).join(keys.select(key).distinct(), key, "left_semi")


def parquet_where(spark: SparkSession, path: str, column: str, values: list, columns: list[str] | None = None) -> DataFrame:
    """Parquet rows with column in a short list of values; the filter reaches the scan."""
    df = spark.read.parquet(path).filter(F.col(column).isin(values))
    return df.select(*columns) if columns else df


def parquet_with(spark: SparkSession, path: str, columns: list[str], mandatory: list[str]) -> DataFrame:
    """The named columns and those mandatory ones that the file's schema has; no data is read for that."""
    have = spark.read.parquet(path).schema.names
    chosen = [*columns, *[c for c in mandatory if c in have and c not in columns]]
    return require_columns(spark.read.parquet(path), columns).select(*chosen)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def json_nested(spark: SparkSession, path: str, schema: str, array: str) -> DataFrame:
    """A JSON file with one list of objects: a row an element of the named array, with the object's other fields."""
    df = spark.read.schema(schema).json(path, multiLine=True)
    return df.select(*[c for c in df.columns if c != array], F.posexplode_outer(array).alias("pos", "item"))


def listing(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, length, modified) of files; their content is never read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "length", F.col("modificationTime").alias("modified"))


def file_hashes(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(name, length, sha256) of every file, by its name below path; each is read in chunks where it is hashed, on a shared path or by a URI."""
    root = F.concat(F.substring_index(F.lit(path.rstrip("/")), ":", -1), F.lit("/"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            hashes = []
            for p in t.path:
                system, at = (fs.LocalFileSystem(), "/" + p[5:].lstrip("/")) if p.startswith("file:") else fs.FileSystem.from_uri(p)
                h = hashlib.sha256()
                with system.open_input_stream(at) as f:
                    while chunk := f.read(CHUNK):
                        h.update(chunk)
                hashes.append(h.hexdigest())
            yield pd.DataFrame({"name": t.name_, "length": t.length, "sha256": hashes})

    found = listing(spark, path, glob).select("path", F.element_at(F.split("path", F.concat(F.lit("\\Q"), root, F.lit("\\E"))), -1).alias("name_"), "length")
    return found.mapInPandas(run, "name string, length bigint, sha256 string")


def _zips(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def zip_members(spark: SparkSession, path: str) -> DataFrame:
    """(archive, member, size) of every archive; an archive a task."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            for p, content in zip(t.path, t.content):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    yield pd.DataFrame([(p, i.filename, i.file_size) for i in z.infolist() if not i.is_dir()], columns=["archive", "member", "size"])

    return _zips(spark, path).mapInPandas(run, "archive string, member string, size bigint")


def zip_texts(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """(archive, member, text) of all members whose name ends so; members are read one by one."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            for p, content in zip(t.path, t.content):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for i in z.infolist():
                        if not i.is_dir() and i.filename.endswith(suffix):
                            yield pd.DataFrame([(p, i.filename, z.read(i).decode("utf-8", "replace"))], columns=["archive", "member", "text"])

    return _zips(spark, path).mapInPandas(run, "archive string, member string, text string")


def zip_csv(spark: SparkSession, path: str, member: str, columns: list[str]) -> DataFrame:
    """Rows of a CSV inside archives, all as text, streamed."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            for content in t.content:
                with zipfile.ZipFile(io.BytesIO(content)) as z, z.open(member) as f:
                    reader = csv.DictReader(io.TextIOWrapper(f, "utf-8", newline=""))
                    rows: list = []
                    for r in reader:
                        rows.append([r.get(c) for c in columns])
                        if len(rows) == 5000:
                            yield pd.DataFrame(rows, columns=columns)
                            rows = []
                    yield pd.DataFrame(rows, columns=columns)

    return _zips(spark, path).mapInPandas(run, ", ".join(f"`{c}` string" for c in columns))


class SplitFile(io.RawIOBase):
    """A read-only view of files as if they were one, found by position without joining them."""

    def __init__(self, paths: list[str]) -> None:
        self.files = [open(p, "rb") for p in paths]  # noqa: SIM115
        sizes = [f.seek(0, 2) for f in self.files]
        self.ends = np.cumsum(sizes).tolist()
        self.at = 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = 0) -> int:
        self.at = offset + (0, self.at, self.ends[-1] if self.ends else 0)[whence]
        return self.at

    def tell(self) -> int:
        return self.at

    def readinto(self, buffer) -> int:
        k = bisect.bisect_right(self.ends, self.at)
        if k == len(self.files):
            return 0
        self.files[k].seek(self.at - (self.ends[k - 1] if k else 0))
        n = self.files[k].readinto(memoryview(buffer)[: self.ends[k] - self.at])
        self.at += n
        return n

    def close(self) -> None:
        for f in self.files:
            f.close()
        super().close()


def split_zip_members(spark: SparkSession, parts: list[str], names: DataFrame) -> DataFrame:
    """(member, text) of the named members (one column, member) of an archive cut into parts on a shared path."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with zipfile.ZipFile(io.BufferedReader(SplitFile(parts))) as z:
            for t in batches:
                for m in t.member:
                    yield pd.DataFrame([(m, z.read(m).decode("utf-8", "replace"))], columns=["member", "text"])

    return names.select("member").mapInPandas(run, "member string, text string")


def array_rows(spark: SparkSession, path: str, rows_per_task: int = 65_536) -> DataFrame:
    """(row, vector) of a two-dimensional .npy file on a shared path; every task maps only its range of rows."""
    n = np.load(path, mmap_mode="r").shape[0]
    ranges = spark.range(0, max(1, -(-n // rows_per_task)), 1, max(1, -(-n // rows_per_task)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a = np.load(path, mmap_mode="r")
        for t in batches:
            for k in t.id:
                for lo in range(int(k) * rows_per_task, min(n, (int(k) + 1) * rows_per_task), 4096):
                    part = np.asarray(a[lo : min(lo + 4096, n, (int(k) + 1) * rows_per_task)], dtype=np.float32)
                    yield pd.DataFrame({"row": np.arange(lo, lo + len(part)), "vector": list(part)})

    return ranges.mapInPandas(run, "row bigint, vector array<float>")


def array_shards(spark: SparkSession, path: str, key: str, values: str) -> DataFrame:
    """(key, vector) of .npz shards that hold an array of ids and an array of rows each; a shard a task."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            for content in t.content:
                with np.load(io.BytesIO(content)) as z:
                    yield pd.DataFrame({"key": z[key].astype(np.int64), "vector": list(np.asarray(z[values], dtype=np.float32))})

    return _zips(spark, path).mapInPandas(run, "key bigint, vector array<float>")


def xml_classes(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    """Rows of an XML file by their tag and a stated schema; Spark splits the file."""
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def scene_graphs(members: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Regions, label counts and one row of figures a graph. members: (member, text), each a JSON graph.

    Regions: image_id, region, the box and the original box and sizes. Labels: image_id, region, category, label, n_yes and
    n_no, where a string that a phrase repeats counts once; a string without exactly three parts counts as bad and gives no
    label. Figures: viewpoint, study_id, patient_id, n_objects, n_attr_regions, n_relationships, bad_attr_strings. Texts that
    are no JSON object give nothing but a row of nulls and zeros in figures.
    """
    box = [p + c for p in ("", "original_") for c in ("x1", "y1", "x2", "y2")] + ["original_width", "original_height"]
    objects = ",".join(["bbox_name:string", *[f"{c}:double" for c in box]])
    schema = (
        f"image_id string, viewpoint string, study_id string, patient_id string, objects array<struct<{objects}>>, relationships array<string>, "
        "attributes array<struct<bbox_name:string,attributes:array<array<string>>,phrases:array<string>>>"
    )
    g = members.select(F.from_json("text", schema).alias("g")).select("g.*")
    regions = g.select("image_id", F.explode("objects").alias("o")).select("image_id", F.col("o.bbox_name").alias("region"), *[F.col(f"o.{c}").alias(c) for c in box])
    once = F.flatten(F.transform("a.attributes", lambda phrase: F.array_distinct(phrase)))
    values = g.select("image_id", F.explode("attributes").alias("a")).select("image_id", F.col("a.bbox_name").alias("region"), F.explode(once).alias("v")).withColumn("p", F.split("v", r"\|", -1))
    good = values.filter(F.size("p") == 3).select("image_id", "region", F.get("p", F.lit(0)).alias("category"), F.get("p", F.lit(1)).alias("polarity"), F.get("p", F.lit(2)).alias("label"))
    labels = good.groupBy("image_id", "region", "category", "label").agg(F.count_if(F.col("polarity") == "yes").alias("n_yes"), F.count_if(F.col("polarity") != "yes").alias("n_no"))
    strings = F.flatten(F.transform("attributes", lambda a: F.flatten(F.transform(F.coalesce(a["attributes"], F.array().cast("array<array<string>>")), lambda phrase: F.array_distinct(phrase)))))
    count = lambda c: F.coalesce(F.greatest(F.size(c), F.lit(0)), F.lit(0))
    bad = F.filter(strings, lambda s: F.size(F.split(s, r"\|", -1)) != 3)
    figures = g.select("image_id", "viewpoint", "study_id", "patient_id", count("objects").alias("n_objects"), count("attributes").alias("n_attr_regions"), count("relationships").alias("n_relationships"), count(bad).alias("bad_attr_strings"))
    return regions, labels, figures


def yaml_rows(path: str) -> dict:
    """A YAML (or JSON) file of an ontology, read on the driver."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        import yaml
    except ImportError:
        return json.loads(text)
    return yaml.safe_load(text)
