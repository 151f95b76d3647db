"""Sections of answers, results as JSON, stored files, reachability, searches within a label and compaction, on small tables."""

import json

import pytest
from conftest import SF, assert_same
from pyspark.sql import functions as F

from quarrystone.operators import graph, search, sections, source_chunks, vectors
from quarrystone.plans import catalogue
from quarrystone.plans import composed_tables as C
from quarrystone.plans import written_tables as W
from quarrystone.sources import files, projects, results, store
from quarrystone.streaming import ingest

WRITTEN = [n for n, f in catalogue.QUERIES.items() if f.__module__ in (C.__name__, W.__name__)]


@pytest.mark.parametrize("name", WRITTEN)
def test_written_queries(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    assert df.count() > 0
    assert_same(df, duck.sql(catalogue.ORACLES[name]))


ANSWER = """ lost
- lost item
PURPOSE:  First
Purpose: Pays
 the rest: of it
not this:
- nor this
Notes: dropped
- one
-two
 -  three:

- four
Table Name: X:Y
- five
Entity: E
- lost
gone
Key Fields:
- k
Notes:
- six
"""


def _plain(text):
    """The rule, line by line."""
    out, at = {"purpose": "", "entity": "", "table_name": "", "notes": [], "key_fields": []}, None
    for line in (text or "").split("\n"):
        line = line.strip()
        low = line.lower()
        value = line.partition(":")[2].strip()
        if not line:
            continue
        if low.startswith("purpose:"):
            out["purpose"], at = value, "purpose"
        elif low.startswith("entity:"):
            out["entity"], at = value, "entity"
        elif low.startswith("table name:"):
            out["table_name"] = value
        elif low.startswith("notes:"):
            at = "notes"
        elif low.startswith("key fields:"):
            at = "key_fields"
        elif line.startswith("- "):
            if at in ("notes", "key_fields"):
                out[at].append(line[2:].strip())
        elif at == "purpose" and not line.endswith(":"):
            out["purpose"] += " " + line
    return out


def test_sections(spark):
    texts = {"a": ANSWER, "b": "", "c": None, "d": "- x\ny", "e": "Purpose:\ngoes on", "f": "Notes:\n" + "- n\n" * 5000}
    df = spark.createDataFrame(list(texts.items()), "filename string, text string")
    got = {r["filename"]: r.asDict() for r in sections.sections(df).collect()}
    assert set(got) == set(texts)
    for name, text in texts.items():
        want = _plain(text)
        assert {k: got[name][k] for k in want} == want
    assert got["a"]["purpose"] == "Pays the rest: of it" and got["a"]["notes"] == ["one", "three:", "four", "five", "six"]
    assert sections.sections(df.limit(0)).count() == 0
    assert {"functionalities", "register_usage", "host_structure"} <= set(got["b"]) and got["c"]["steps"] == []


def test_fenced_json(spark):
    rows = [("a", '```json\n{"x": 1}\n```'), ("b", '```json {"x": 2}'), ("c", '{"x": 3'), ("d", None), ("e", "``` ```"), ("f", " [4] ")]
    out = sections.fenced_json(spark.createDataFrame(rows, "filename string, text string"))
    got = {r["filename"]: (r["j"], r["error"]) for r in out.select("filename", F.to_json("body").alias("j"), "error").collect()}
    assert got == {"a": ('{"x":1}', None), "b": ('{"x":2}', None), "c": (None, "no JSON"), "d": (None, "no JSON"), "e": (None, "no JSON"), "f": ("[4]", None)}


def test_results(spark, tmp_path):
    own = spark.createDataFrame([("a", "cobol"), ("b", "jcl"), ("none", "jcl")], "filename string, file_type string")
    calls = spark.createDataFrame([("a", "Z", 10), ("a", "Y", 9), ("b", 'q"', None), ("other", "X", 1)], "filename string, target string, line int")
    names = spark.createDataFrame([("a", None), ("a", "n"), ("a", "n")], "filename string, name string")
    out = results.results(own, {"calls": calls, "names": names}).join(own, "filename")
    got = {r["filename"]: json.loads(r["result"]) for r in out.collect()}
    assert got["a"] == {"calls": [{"target": "Y", "line": 9}, {"target": "Z", "line": 10}], "names": [{"name": "n"}, {"name": "n"}, {}]}
    assert got["b"] == {"calls": [{"target": 'q"'}], "names": []} and got["none"] == {"calls": [], "names": []} and len(got) == 3
    assert {r["result"] for r in results.results(own, {}).collect()} == {"{}"}
    results.write_joined(out, str(tmp_path / "joined"))
    back = results.read_joined(spark, str(tmp_path / "joined"))
    assert sorted(map(tuple, back.select("file_type", "filename", "result").collect())) == sorted(map(tuple, out.select("file_type", "filename", "result").collect()))
    results.write_each(out, str(tmp_path / "each"))
    assert {p.name for p in (tmp_path / "each").glob("*/*") if p.is_dir()} == {"filename=a", "filename=b", "filename=none"}


def test_store(spark, tmp_path):
    root = str(tmp_path / "s")
    store.save(spark, root, "p", "cobol", "A.cbl", b"\x00\xff1")
    store.save(spark, root, "p", "cobol", "A.cbl", b"\x00\xff2")
    store.save(spark, root, "p", "jcl", "empty", b"")
    assert store.exists(spark, root, "p", "cobol", "A.cbl") and store.read(spark, root, "p", "cobol", "A.cbl") == b"\x00\xff2"
    listed = spark.createDataFrame([("p", "cobol", "A.cbl", 1), ("p", "cobol", "gone", 2), ("p", None, "x", 3)], "project_id string, file_type string, filename string, content_no int")
    got = {r["filename"]: (r["found"], r["content"]) for r in store.contents(listed, store.stored(spark, root)).collect()}
    assert got == {"A.cbl": (True, bytearray(b"\x00\xff2")), "gone": (False, None), "x": (False, None)}
    with pytest.raises(FileNotFoundError):
        store.read(spark, root, "p", "cobol", "gone")
    for bad in ("..", "", "a/b", "."):
        with pytest.raises(ValueError):
            store.save(spark, root, "p", bad, "f", b"")
    assert store.delete(spark, root, "p", "cobol", "A.cbl") and not store.delete(spark, root, "p", "cobol", "A.cbl")
    assert not (tmp_path / "s" / "p" / "cobol").exists() and (tmp_path / "s" / "p" / "jcl").exists()
    assert store.delete(spark, root, "p", "jcl", "empty") and not (tmp_path / "s" / "p").exists()
    store.save(spark, root, "q", "jcl", "f", b"1")
    assert store.delete_project(spark, root, "q") and not store.delete_project(spark, root, "q")


def test_guard_and_status(spark):
    rows = [("a", "COBOL", b""), ("b", "copybook", b""), ("c", "jcl", b""), ("d", "cobol", b"x"), ("e", "copybook", b"x" * (10 * 1024 * 1024 + 1)), ("f", "cobol", b"x" * (10 * 1024 * 1024 + 1)), ("g", None, b"")]
    got = {tuple(r) for r in files.parser_guard(spark.createDataFrame(rows, "filename string, file_type string, content binary")).collect()}
    assert got == {("a", "error", "File is empty"), ("b", "warning", "File is empty"), ("e", "error", "File exceeds maximum size of 10 MB")}
    outputs = spark.createDataFrame([(1, "t"), (1, "f"), (1, "t"), (2, "t"), (2, "other")], "project_id int, output string")
    three = spark.createDataFrame([(1,), (2,), (3,)], "project_id int")
    got = {r["project_id"]: (r["status"], r["progress"], r["outputs"]) for r in projects.output_status(three, outputs, ("t", "f")).collect()}
    assert got == {1: ("COMPLETED", 100.0, ["f", "t"]), 2: ("PROCESSING", 0.0, ["t"]), 3: ("PROCESSING", 0.0, [])}


def test_reachable(spark):
    chain = [(f"n{i}", f"n{i + 1}") for i in range(12)] + [("n3", "n0"), ("n0", "n5"), ("n2", "n2"), (None, "x"), ("n1", None)]
    edges, start = spark.createDataFrame(chain, "src string, dst string"), spark.createDataFrame([("n0",), ("n0",), (None,), ("lone",)], "node string")
    out = graph.reachable(edges, start, 9)
    want = {"lone": 0, "n0": 0, "n1": 1, "n2": 2, "n3": 3, "n4": 4, "n5": 1} | {f"n{i}": i - 4 for i in range(6, 13)}
    assert {r["node"]: r["distance"] for r in out.collect()} == want
    assert len(out._jdf.queryExecution().optimizedPlan().toString()) < 20_000
    assert graph.reachable(edges, start.limit(0), 3).count() == 0


@pytest.mark.parametrize("most", [1000, 2])
def test_search_within(spark, monkeypatch, most):
    monkeypatch.setattr(vectors, "MOST_QUERIES", most)
    rows = [(i, [float(i), 0.0], None if i == 7 else i % 2) for i in range(12)]
    own = spark.createDataFrame(rows, "vec_id int, embedding array<float>, label int")
    asked = own.where("vec_id in (0, 1, 6, 7, 9)").withColumnRenamed("vec_id", "query_id")
    got = {}
    for r in vectors.nearest_of_each(own, asked, 3, within="label").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    assert {k: [v for _, v in sorted(x)] for k, x in got.items()} == {0: [0, 2, 4], 1: [1, 3, 5], 6: [6, 4, 8], 9: [9, 11, 5]}
    hits = spark.createDataFrame([(1, 0.5, 3, "b"), (1, 0.1, 4, "a"), (1, 0.2, 9, None), (2, 0.0, 1, "long text")], "q int, distance double, id int, text string")
    assert {r["q"]: (r["context"], r["previews"]) for r in vectors.contexts(hits, 4, by="q").collect()} == {1: ("a\n\nb", ["a", "b"]), 2: ("long text", ["long"])}


def test_compaction(spark, tmp_path):
    source, target, base = (str(tmp_path / n) for n in ("in", "out", "base"))
    schema = "k int, ts int, v string"

    def arrive(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(source)
        ingest.latest_by_key(ingest.arriving(spark, source, schema), ["k"], "ts", target, str(tmp_path / "cp")).awaitTermination(120)

    def now(compacted=None):
        return sorted(tuple(r) for r in ingest.current(spark, target, ["k"], "ts", compacted).select("k", "ts", "v").collect())

    arrive((1, 5, "a"), (2, 1, "b"))
    assert now(base) == now() == [(1, 5, "a"), (2, 1, "b")]
    arrive((1, 4, "late"), (2, 1, "tie"))
    ingest.compact(spark, target, ["k"], "ts", base)
    assert now(base) == now() == [(1, 5, "a"), (2, 1, "tie")]
    arrive((1, 6, "new"), (3, 0, "c"))
    assert now(base) == now() == [(1, 6, "new"), (2, 1, "tie"), (3, 0, "c")]
    ingest.compact(spark, target, ["k"], "ts", base)
    assert now(base) == now()


def test_containing_takes_rare_words_and_blocks(spark):
    texts = [(1, "a the b of the c"), (2, "the the the"), (None, "x the b of y"), (4, None), (5, ""), (5, "q the b of z"), (6, "tab\tthe b of\nline")]
    items = [(1, "the b of"), (2, "x the b of y"), (3, "the"), (None, "the the"), (4, "none of these"), (5, ""), (6, None), (7, "the b of"), (8, "b of\nline")]
    t, i = spark.createDataFrame(texts, "t int, text string"), spark.createDataFrame(items, "i int, text string")
    want = {(a, b) for a, x in items for b, y in texts if x is not None and y is not None and x in y}
    for kw in ({}, {"block": 1}, {"block": 1, "most_broadcast": 0}):
        assert {tuple(r) for r in search.containing(i, t, "i", "t", **kw).collect()} == want
    assert search.containing(i.limit(0), t, "i", "t").count() == 0 and search.containing(i, t.limit(0), "i", "t").count() == 0


def test_clean_pli(spark):
    rows = [("s", "000100 A/*x*/B;\n000200 C = 1;\n000300 \n000400 END;\n"), ("p", "\n A;/* 1\n2 */\n\n\tB;\n\n"), ("i", "000100 A;\n X = 12345;")]
    df = spark.createDataFrame(rows, "k string, text string")
    got = {r["k"]: (r["c"], r["i"]) for r in df.select("k", source_chunks.clean_pli(F.col("text")).alias("c"), source_chunks.clean_include(F.col("text")).alias("i")).collect()}
    assert got["s"] == ("A B;\nC = 1;\n000300 \nEND;", "000100 A B;\n000200 C = 1;\n000300 \n000400 END;")
    assert got["p"] == ("A; \n\tB;",) * 2
    assert got["i"] == ("000100 A;\n X = 12345;",) * 2  # half of the lines have no number
