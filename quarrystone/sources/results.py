"""Parsed relations as JSON: one object for each source file, joined results by type, and their writers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def results(files: DataFrame, relations: Mapping[str, DataFrame], key: str = "filename", order: str = "line") -> DataFrame:
    """(key, result): a JSON object of every file with a list of rows under the name of each relation.

    Every relation carries the key.  Rows are in the order of their line, where they have one, then
    of their JSON; a relation without rows of a file is an empty list there.  Rows of files that aren't listed are left out.
    """
    if not relations:
        return files.select(key).distinct().withColumn("result", F.lit("{}"))
    parts = None
    for n, rows in enumerate(relations.values()):
        at = F.col(order).cast("long") if order in rows.columns else F.lit(None).cast("long")
        one = rows.select(key, F.struct(F.lit(n).alias("n"), at.alias("at"), F.to_json(F.struct(*(c for c in rows.columns if c != key))).alias("row")).alias("r"))
        parts = one if parts is None else parts.unionByName(one)
    by_file = parts.groupBy(key).agg(F.array_sort(F.collect_list("r")).alias("rows"))
    joined = files.select(key).distinct().join(by_file, key, "left").withColumn("rows", F.coalesce("rows", F.expr("cast(array() as array<struct<n: int, at: bigint, row: string>>)")))

    def listed(n: int, name: str) -> Column:
        own = F.filter("rows", lambda r: r["n"] == n)
        return F.concat(F.lit(f'"{name}":['), F.array_join(F.transform(own, lambda r: r["row"]), ","), F.lit("]"))

    lists = [listed(n, name) for n, name in enumerate(relations)]
    return joined.select(key, F.concat(F.lit("{"), F.concat_ws(",", *lists), F.lit("}")).alias("result"))


def write_each(rows: DataFrame, path: str) -> None:
    """A folder with the JSON of each file (file_type, filename, result)."""
    rows.select("file_type", "filename", "result").repartition("file_type", "filename").write.mode("overwrite").partitionBy("file_type", "filename").text(path)


def write_joined(rows: DataFrame, path: str) -> None:
    """The results of each type as JSON lines, in a folder of the type; every line has the name of its file."""
    line = F.to_json(F.struct("filename", F.col("result").alias("parsed")))
    rows.select("file_type", line.alias("value")).write.mode("overwrite").partitionBy("file_type").text(path)


def read_joined(spark: SparkSession, path: str) -> DataFrame:
    """(file_type, filename, result) of joined results."""
    lines = spark.read.schema("value string, file_type string").text(path)
    return lines.select("file_type", F.from_json("value", "filename string, parsed string").alias("r")).select("file_type", "r.filename", F.col("r.parsed").alias("result"))
