import duckdb
import pytest

from quarrystone.operators import chunks
from quarrystone.plans import catalogue, summary_tables
from quarrystone.sources import notes

SF = "/root/testdata/sf0.001"
NAMES = [n for n, f in catalogue.QUERIES.items() if n in catalogue.ORACLES and (f.__module__ == summary_tables.__name__)]


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, name):
    db = duckdb.connect()
    for t in ("supplier", "part", "orders", "customer", "documents"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = catalogue.QUERIES[name](spark, SF)
    want = db.execute(catalogue.ORACLES[name])
    columns = [c[0] for c in want.description]
    rows = want.fetchall()
    assert sorted(got.columns) == sorted(columns) and rows
    assert sorted(map(repr, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(repr, rows))


def test_notes(spark, tmp_path):
    root = str(tmp_path)
    notes.start_notes(spark, root)
    assert all(notes.read_notes(spark, root, k).count() == 0 for k in notes.NOTES)
    for status in ("in_progress", "converted"):
        notes.append_notes(spark.createDataFrame([("PAY", status, None, 1)], "component string, status string, notes string, other int"), root, "status")
    assert notes.read_notes(spark, root, "status").count() == 2
    assert [(r["component"], r["status"]) for r in notes.latest_status(notes.read_notes(spark, root, "status")).collect()] == [("PAY", "converted")]


def test_recursive_chunks(spark):
    texts = {"a": "one two\n\nthree four five\nsix", "b": "abcdefghijklmnopqrstuvwxyz", "c": "", "d": None, "e": " \n\n ", "f": "short"}
    rows = chunks.recursive(spark.createDataFrame(list(texts.items()), "k string, text string"), "k", size=10, overlap=4).orderBy("k", "n").collect()
    found = {}
    for r in rows:
        found.setdefault(r["k"], []).append(r["chunk"])
    assert found == {"a": ["one two", "three", "four five", "six"], "b": ["abcdefghij", "ghijklmnop", "mnopqrstuv", "stuvwxyz"], "f": ["short"]}


def test_recursive_chunks_lose_no_word(spark):
    whole = catalogue.table(spark, SF, "documents")
    words = {r["doc_id"]: set((r["text"] or "").split()) for r in whole.collect()}
    kept = {}
    for r in chunks.recursive(whole, "doc_id").collect():
        assert 0 < len(r["chunk"]) <= 1000
        kept.setdefault(r["doc_id"], set()).update(r["chunk"].split())
    assert all(w <= kept.get(k, set()) for k, w in words.items() if all(len(x) < 900 for x in w))


def test_sizes_of_recursive_chunks(spark):
    with pytest.raises(ValueError):
        chunks.recursive(spark.createDataFrame([], "text string"), size=5, overlap=5)
