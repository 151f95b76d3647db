"""Ordered folds, harvests, tree listings and versions against plain loops."""

import json
import os

from pyspark.sql import functions as F

from quarrystone.operators import folds, harvest
from quarrystone.sources import trees, versions


def test_fold_of_long_and_of_many_files(spark):
    """1,000 chunks of one file and 1,000 files of few; the state is not commutative."""
    rows = [("long", i) for i in range(1000)] + [(f"f{k}", i) for k in range(1000) for i in range(k % 3 + 1)] + [(None, 5), (None, 2)]
    df = spark.createDataFrame(rows, "file string, n int").withColumn("state", F.col("n") * 7 % 11).repartition(6)
    step = lambda s, r: (s * 31 + r["state"]) % 1_000_003
    got = folds.rolling_fold(df, ["file"], ["n"], step, "total long", start=lambda: 1, finish=lambda s: {"total": s})
    want = {}
    for file, n in sorted(rows, key=lambda r: r[1]):
        want[file] = (want.get(file, 1) * 31 + n * 7 % 11) % 1_000_003
    assert got.columns == ["file", "total"] and {r["file"]: r["total"] for r in got.collect()} == want
    assert got.count() == 1002 and folds.rolling_fold(df.where("false"), ["file"], ["n"], step, "total long", finish=lambda s: {"total": s}).count() == 0


def test_harvest_of_odd_summaries(spark):
    body = lambda **x: json.dumps(x)
    rows = [
        ("b", "jcl", body(business_overview={"glossary": [{"term": "T", "definition": "late"}, {"definition": "no term"}, "text", 5, None], "scope": ["R1", "R1", 7, None]}, technical_analysis={"io_datasets": [{"dataset": "a.rpt", "usage": "new"}, {"usage": "old"}, "x", {"dataset": "temp.y", "usage": "OLD"}, {"dataset": 5}]})),
        ("a", "JCL", body(business_overview={"glossary": [{"term": "T", "definition": "early"}, {"term": "U"}]})),
        ("c", "COBOL", body(technical_analysis={"io_datasets": [{"dataset": "SYSOUT", "usage": "NEW"}]})),
        ("d", "JCL", "not json"), ("e", "JCL", None), ("f", None, "[]"), ("g", "JCL", body(business_overview="none", technical_analysis={"io_datasets": {"dataset": "x.rpt"}})),
    ]
    out = harvest.harvest(spark.createDataFrame(rows, "filename string, file_type string, body string"))
    told = {k: sorted((tuple(r) for r in v.collect()), key=str) for k, v in out.items()}
    assert told == {"rules": [("7",), ("R1",)], "glossary": [("T", "late"), ("U", None)], "reports": [("b", "A.RPT")], "interfaces": [("b", "", "OLD"), ("b", "A.RPT", "NEW")]}


def test_tree_of_nested_paths(spark):
    paths = ["b.txt", "A/z", "A/B/c", "A/b.txt", "a2/x", "bin/y", "A/obj/q", "A//z", "", None, "Z"]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    folders = spark.createDataFrame([("A/B/empty/deep",), ("lone",), ("A",)], "path string")
    rows = trees.listing(files, skip=("bin", "obj"), folders=folders).orderBy("sort_key").collect()
    assert [(r["path"], r["depth"], r["n_files"]) for r in rows] == [
        ("A", 0, 3), ("A/B", 1, 1), ("A/B/empty", 2, 0), ("A/B/empty/deep", 3, 0), ("A/B/c", 2, 1), ("A/b.txt", 1, 1), ("A/z", 1, 1), ("a2", 0, 1), ("a2/x", 1, 1), ("lone", 0, 0), ("b.txt", 0, 1), ("Z", 0, 1),
    ]
    assert {r["path"] for r in trees.empty_folders(folders, files).collect()} == {"A/B/empty", "A/B/empty/deep", "lone"}
    assert trees.listing(files.where("false")).count() == 0


def test_large_tree(spark):
    files = spark.range(100_000).select(F.concat_ws("/", F.concat(F.lit("d"), F.col("id") % 50), F.concat(F.lit("e"), F.col("id") % 1000), F.concat(F.lit("f"), "id")).alias("path"))
    out = trees.listing(files)
    assert out.where("is_folder").count() == 1050 and out.where("depth = 0").agg(F.sum("n_files")).first()[0] == 100_000
    rows = out.where("path like 'd7/%' or path = 'd7'").orderBy("sort_key").select("path", "is_folder").collect()
    open_, ok = [], True
    for r in rows:  # every row follows the folder that it lies in
        parts = r["path"].split("/")
        open_ = open_[: len(parts) - 1]
        ok &= open_ == parts[:-1]
        if r["is_folder"]:
            open_ = parts
    assert ok and len(rows) == 1 + 20 + 2000


def test_versions(spark, tmp_path):
    path = str(tmp_path / "index")
    assert not versions.exists(spark, path) and versions.load(spark, path) is None and versions.delete(spark, path) is False
    first = versions.publish(spark.createDataFrame([(1, "a")], "id long, folder string"), path, partition_by=["folder"])
    reader = versions.load(spark, path)
    versions.publish(spark.createDataFrame([(2, "b"), (3, "a")], "id long, folder string"), path)
    assert [r["id"] for r in reader.collect()] == [1]  # a rebuild while a reader is open
    assert {r["id"] for r in versions.load(spark, path).collect()} == {2, 3}
    os.makedirs(f"{path}/000000000009-{'f' * 32}")  # rows of a writer that never came to an end
    versions.publish(spark.createDataFrame([(4, "c")], "id long, folder string"), path, add=True)
    assert {r["id"] for r in versions.load(spark, path).collect()} == {2, 3, 4}
    assert {r["id"] for r in versions.load(spark, path, first).collect()} == {1} and versions.load(spark, path, "none") is None
    assert versions.prune(spark, path) == [first] and len(versions.versions(spark, path)) == 2
    assert versions.delete(spark, path) and not versions.exists(spark, path) and not os.path.exists(path)
