"""Readers and writers on small files."""

import gzip
import json
import zipfile

import numpy as np
import pytest

from strataform.operators.contracts import ContractError
from strataform.sources import files, sinks
from strataform.streaming.increments import append_new_files


def test_delimited(spark, tmp_path):
    with gzip.open(tmp_path / "a.csv.gz", "wt") as f:
        f.write("id,name,x\n1,a,0.5\n2,b,\n")
    p = str(tmp_path / "a.csv.gz")
    df = files.delimited(spark, p, "id int, name string, x double", ["id", "x"])
    assert [tuple(r) for r in df.collect()] == [(1, 0.5), (2, None)]
    keys = spark.createDataFrame([(2,)], "id int")
    assert files.delimited_where(spark, p, "id int, name string, x double", keys, "id").count() == 1
    with pytest.raises(ContractError):
        files.delimited_checked(spark, p, ["other"], ",")


def test_json_and_parquet(spark, tmp_path):
    (tmp_path / "n.json").write_text(json.dumps([{"study": "s1", "items": [{"a": 1}, {"a": 2}]}, {"study": "s2", "items": []}]))
    df = files.json_nested(spark, str(tmp_path / "n.json"), "study string, items array<struct<a:int>>", "items")
    assert sorted((r.study, r.item.a if r.item else None) for r in df.collect()) == [("s1", 1), ("s1", 2), ("s2", None)]
    spark.range(5).selectExpr("id", "id * 2 as b").write.parquet(str(tmp_path / "p"))
    assert files.parquet_with(spark, str(tmp_path / "p"), ["id"], ["b", "none"]).columns == ["id", "b"]
    assert files.parquet_where(spark, str(tmp_path / "p"), "id", [1, 9]).count() == 1


def archive(path):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("d/a.txt", "first ü")
        z.writestr("d/b.txt", "second " * 500)
        z.writestr("t.csv", "x,y\n1,2\n3,\n")


def test_archives(spark, tmp_path):
    archive(tmp_path / "z.zip")
    p = str(tmp_path / "z.zip")
    assert {r.member for r in files.zip_members(spark, p).collect()} == {"d/a.txt", "d/b.txt", "t.csv"}
    assert {r.text[:6] for r in files.zip_texts(spark, p, ".txt").collect()} == {"first ", "second"}
    assert [tuple(r) for r in files.zip_csv(spark, p, "t.csv", ["x", "y"]).collect()] == [("1", "2"), ("3", "")]
    whole = (tmp_path / "z.zip").read_bytes()
    parts = []
    for i in range(0, len(whole), 97):
        parts.append(str(tmp_path / f"z.{i:05d}"))
        open(parts[-1], "wb").write(whole[i : i + 97])
    names = spark.createDataFrame([("d/a.txt",), ("d/b.txt",)], "member string")
    assert {r.member: r.text[:7] for r in files.split_zip_members(spark, parts, names).collect()} == {"d/a.txt": "first ü", "d/b.txt": "second "}


def test_arrays_xml_and_graphs(spark, tmp_path):
    a = np.arange(24, dtype=np.float16).reshape(8, 3)
    np.save(tmp_path / "a.npy", a)
    got = {r.row: list(r.vector) for r in files.array_rows(spark, str(tmp_path / "a.npy"), 3).collect()}
    assert got == {i: a[i].tolist() for i in range(8)}
    (tmp_path / "s").mkdir()
    np.savez(tmp_path / "s" / "1.npz", ids=np.array([5, 6]), x=a[:2])
    assert {r.key: list(r.vector) for r in files.array_shards(spark, str(tmp_path / "s" / "*.npz"), "ids", "x").collect()} == {5: [0, 1, 2], 6: [3, 4, 5]}
    (tmp_path / "o.xml").write_text("<o><c id='1'><label>A</label><up>0</up></c><c id='2'><label>B</label><up>1</up><up>0</up></c></o>")
    x = files.xml_classes(spark, str(tmp_path / "o.xml"), "c", "_id string, label string, up array<string>")
    assert {r["_id"]: r.up for r in x.collect()} == {"1": ["0"], "2": ["1", "0"]}
    g = spark.createDataFrame([("m", json.dumps({"image_id": "i", "objects": [{"bbox_name": "lung", "x1": 0, "y1": 0, "x2": 1, "y2": 1}], "attributes": [{"bbox_name": "lung", "attributes": [["finding|yes|edema", "finding|no|mass"], ["finding|yes|edema"]], "phrases": []}]}))], "member string, text string")
    regions, values, figures = files.scene_graphs(g)
    assert regions.count() == 1 and {(r.label, r.n_yes, r.n_no) for r in values.collect()} == {("edema", 2, 0), ("mass", 0, 1)}
    odd = [("a", json.dumps({"image_id": "j", "attributes": [{"bbox_name": "lung", "attributes": [["f|yes|x", "f|yes|x", "bad"]], "phrases": ["p"]}, {"bbox_name": "lung"}]})), ("b", "no json"), ("c", None)]
    regions, values, figures = files.scene_graphs(spark.createDataFrame(odd, "member string, text string"))
    assert regions.count() == 0 and [(r.label, r.n_yes) for r in values.collect()] == [("x", 1)]
    assert sorted((r.image_id or "", r.n_attr_regions, r.bad_attr_strings) for r in figures.collect()) == [("", 0, 0), ("", 0, 0), ("j", 2, 1)]
    (tmp_path / "k.yaml").write_text('{"nodes": [{"id": "a"}]}')
    assert files.yaml_rows(str(tmp_path / "k.yaml"))["nodes"][0]["id"] == "a"


def test_manifest(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc")
    r = files.file_hashes(spark, str(tmp_path), "*.bin").first()
    assert (r.name, r.length, r.sha256[:8]) == ("a.bin", 3, "ba7816bf")
    assert files.listing(spark, str(tmp_path), "*.bin").count() == 1


def test_sinks(spark, tmp_path):
    df, p = spark.range(4).withColumnRenamed("id", "k"), str(tmp_path / "t")
    sinks.write_frozen(df, p)
    sinks.write_frozen(df, p)
    with pytest.raises(ContractError):
        sinks.write_frozen(spark.range(5).withColumnRenamed("id", "k"), p)
    seen = []

    def compute(todo):
        seen.append(todo.count())
        return todo

    assert sinks.resume(spark.range(6).withColumnRenamed("id", "k"), p, ["k"], compute).count() == 6 and seen == [2]
    j = str(tmp_path / "j")
    sinks.append_json(df, j, ["k"])
    assert sinks.append_json(spark.range(6).withColumnRenamed("id", "k"), j, ["k"]).count() == 6
    sinks.write_report(df.orderBy("k"), str(tmp_path / "r" / "a.md"), "md")
    assert (tmp_path / "r" / "a.md").read_text().startswith("| k |")
    with pytest.raises(ContractError):
        sinks.write_report(spark.range(20), str(tmp_path / "b.csv"), most=10)
    checks = {r.check: r.passed for r in sinks.verified_archive(spark.createDataFrame([(0.5,), (1.5,)], "p double"), ["p"], 2).collect()}
    assert checks == {"rows": True, "p": False}


def test_increments(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    spark.range(3).write.parquet(src)
    append_new_files(spark, src, "id bigint", out, cp, ["id"]).awaitTermination()
    spark.range(2, 6).write.mode("append").parquet(src)
    append_new_files(spark, src, "id bigint", out, cp, ["id"]).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [0, 1, 2, 3, 4, 5]
