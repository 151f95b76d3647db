import duckdb
import pytest

from quarrystone.operators import documents
from quarrystone.plans import catalogue, document_tables

SF = "/root/testdata/sf0.001"
NAMES = [n for n, f in catalogue.QUERIES.items() if f.__module__ == document_tables.__name__]


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, name):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW supplier AS SELECT * FROM '{SF}/supplier.parquet'")
    got = catalogue.QUERIES[name](spark, SF)
    want = db.execute(catalogue.ORACLES[name])
    columns = [c[0] for c in want.description]
    rows = want.fetchall()
    assert sorted(got.columns) == sorted(columns) and rows
    assert sorted(map(repr, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(repr, rows))


def test_empty_and_null_rows(spark):
    files = spark.createDataFrame([(None, None), ("x.json", None)], "path string, text string")
    assert [tuple(r) for r in documents.finished_summaries(files).collect()] == [("", 1)]
    records, rejects = documents.merged_summaries(files, "filename string")
    assert records.count() == 0 and [r["path"] for r in rejects.collect()] == ["x.json"]
    assert documents.merged_summaries(files.limit(0), "filename string")[0].count() == 0
    programs = spark.createDataFrame([("P", [(None, "READ"), (None, "READ")]), (None, None)], "filename string, data_interactions array<struct<target: string, operation: string>>")
    assert [tuple(r) for r in documents.data_dependencies(programs).collect()] == [("P", None, "READ")]
    told = spark.createDataFrame([], "filename string, n long, functional_category string")
    assert [tuple(r) for r in documents.hot_modules(spark.createDataFrame([("A",), (None,)], "name string"), told).orderBy("name").collect()] == [(None, "Core Processing", "High (Critical Path)"), ("A", "Core Processing", "High (Critical Path)")]
