"""Queries of the operators of documents, over made-up rows for each supplier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarrystone.operators import documents
from quarrystone.plans.catalogue import query
from quarrystone.plans.source_tables import _values
from quarrystone.plans.summary_tables import _each

_FILES = {
    "out§/summaries/b.json": '{"filename": "B§", "file_type": "JCL"}',
    "out§/summaries/a.json": '{"filename": "A§", "file_type": "COBOL"}',
    "out§/summaries/c.json": '{"filename": ',
    "out§/summaries/_status.json": '{"filename": "status"}',
    "out§/summaries/more/d.json": '{"filename": "D§"}',
    "out§/notes/readme.txt": "text",
}


def _files(spark: SparkSession, d: str) -> DataFrame:
    return _each(spark, d, "path string, text string", *({"path": p, "text": t} for p, t in _FILES.items()))


@query("finished_summaries", _values(["folder", "n_files"], [("out§/summaries", 3), ("out§/summaries/more", 1), ("out§/notes", 0)]))
def finished_summaries(spark: SparkSession, d: str) -> DataFrame:
    return documents.finished_summaries(_files(spark, d))


@query("merged_summaries", _values(["path", "filename", "file_type"], [("out§/summaries/a.json", "A§", "COBOL"), ("out§/summaries/b.json", "B§", "JCL"), ("out§/summaries/more/d.json", "D§", None)]))
def merged_summaries(spark: SparkSession, d: str) -> DataFrame:
    return documents.merged_summaries(_files(spark, d), "filename string, file_type string")[0]


@query("merged_summary_rejects", _values(["path", "reason"], [("out§/summaries/c.json", "no JSON")]))
def merged_summary_rejects(spark: SparkSession, d: str) -> DataFrame:
    return documents.merged_summaries(_files(spark, d), "filename string, file_type string")[1]


@query("summary_file_list", _values(["filename", "file_type"], [("A§", "COBOL"), ("B§", "JCL"), ("D§", None)]))
def summary_file_list(spark: SparkSession, d: str) -> DataFrame:
    return documents.file_list(documents.merged_summaries(_files(spark, d), "filename string, file_type string")[0])


@query("data_dependencies", _values(["filename", "target", "operation"], [("P§", "T1", "READ"), ("P§", "T1", "WRITE"), ("P§", "X§", "READ"), ("Q§", "T1", "READ")]))
def data_dependencies(spark: SparkSession, d: str) -> DataFrame:
    does = lambda target, operation: {"target": target, "operation": operation}
    programs = (
        {"filename": "P§", "data_interactions": [does("T1", "READ"), does("T1", "WRITE"), does("T1", "READ"), does("X§", "READ")]},
        {"filename": "Q§", "data_interactions": [does("T1", "READ")]},
        {"filename": "R§", "data_interactions": []},
        {"filename": "S§"},
    )
    return documents.data_dependencies(_each(spark, d, "filename string, data_interactions array<struct<target: string, operation: string>>", *programs))


@query("hot_modules", _values(["name", "area", "profile"], [("A§", "Billing", "High (Critical Path)"), ("B§", "Business Logic", "High (Critical Path)"), ("C§", "Core Processing", "High (Critical Path)")]))
def hot_modules(spark: SparkSession, d: str) -> DataFrame:
    told = _each(
        spark, d, "filename string, n long, functional_category string",
        {"filename": "A§", "n": 2, "functional_category": "Accounts"}, {"filename": "A§", "n": 1, "functional_category": "Billing"}, {"filename": "B§", "n": 3}, {"filename": "E§", "n": 4},
    )
    return documents.hot_modules(_each(spark, d, "name string", {"name": "A§"}, {"name": "B§"}, {"name": "C§"}), told)
