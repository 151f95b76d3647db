"""Markdown reports as ordered lines, put together by the cluster.

A report is a table (section, part, at, line): its order is that of its first
three columns, so sections of any size stay distributed until they are written.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_COLUMNS = "section int, part int, at string, line string"


def _fixed(spark: SparkSession, section: int, part: int, texts: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([(section, part, f"{i:08d}", t) for i, t in enumerate(texts)], _COLUMNS)


def _cell(name: str, kind: str) -> Column:
    text = F.array_join(F.col(name).cast("array<string>"), ", ") if kind.startswith("array") else F.col(name).cast("string")
    return F.coalesce(F.nullif(F.replace(F.regexp_replace(text, r"\s*\n\s*", " "), F.lit("|"), F.lit("\\|")), F.lit("")), F.lit("-"))


def _joined(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def relation_section(df: DataFrame, section: int, title: str) -> DataFrame:
    """A heading, the number of rows, and the rows in the order of their columns; or a note that there are none."""
    spark = df.sparkSession
    cells = [_cell(n, k) for n, k in df.dtypes]
    rows = df.select(F.lit(section).alias("section"), F.lit(3).alias("part"), F.concat_ws("\u0001", *cells).alias("at"), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
    count = df.agg(F.count("*").alias("n")).select(F.lit(section).alias("section"), F.lit(1).alias("part"), F.lit("").alias("at"), F.when(F.col("n") == 0, F.lit("No entries.")).otherwise(F.concat(F.lit("Entries: "), F.col("n"))).alias("line"))
    head = ["", "| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
    return _joined([_fixed(spark, section, 0, [f"## {title}", ""]), count, _fixed(spark, section, 2, head), rows, _fixed(spark, section, 4, [""])])


def dependency_report(spark: SparkSession, project: str, relations: Mapping[str, DataFrame], missing_types: Sequence[str] = ()) -> DataFrame:
    """Dependency report of a project: totals by relation, one section a relation, and file types that were not parsed."""
    top = _fixed(spark, 0, 0, ["# Dependency Graph", "", f"> Project: {project}", "", "## Summary", "", "| relation | rows |", "|-|-|"])
    totals = [df.agg(F.count("*").alias("n")).select(F.lit(0).alias("section"), F.lit(1).alias("part"), F.lit(f"{i:08d}").alias("at"), F.concat(F.lit(f"| {name} | "), F.col("n"), F.lit(" |")).alias("line")) for i, (name, df) in enumerate(relations.items())]
    sections = [relation_section(df, i + 1, name) for i, (name, df) in enumerate(relations.items())]
    gaps = [_fixed(spark, len(relations) + 1, 0, ["## Missing file types", "", *(f"- {t}" for t in missing_types)])] if missing_types else []
    return _joined([top, *totals, _fixed(spark, 0, 2, [""]), *sections, *gaps])


def summary_report(summaries: DataFrame, titles: Mapping[str, str]) -> DataFrame:
    """File summaries (file_type, filename, purpose, functions array) under one heading a type, files in order."""
    spark = summaries.sparkSession
    parts = [_fixed(spark, 0, 0, ["# File Summaries", ""])]
    for i, (kind, title) in enumerate(titles.items()):
        own = summaries.where(F.col("file_type") == kind)
        some = own.limit(1).select(F.lit(i + 1).alias("section"), F.lit(0).alias("part"), F.lit("").alias("at"), F.lit(f"## {title}").alias("line"))
        body = F.concat(F.array(F.concat(F.lit("### "), "filename"), F.concat(F.lit("**Purpose**: "), F.coalesce("purpose", F.lit("N/A")))), F.transform(F.coalesce("functions", F.array().cast("array<string>")), lambda x: F.concat(F.lit("- "), x)), F.array(F.lit("")))
        lines = own.select("filename", F.posexplode(body).alias("n", "line"))
        parts += [some, lines.select(F.lit(i + 1).alias("section"), F.lit(1).alias("part"), F.concat("filename", F.lit("\u0001"), F.lpad(F.col("n").cast("string"), 8, "0")).alias("at"), "line")]
    return _joined(parts)


def write_report(report: DataFrame, path: str) -> None:
    """The lines in order, as text files whose names follow that order."""
    report.orderBy("section", "part", "at").select("line").write.mode("overwrite").text(path)
