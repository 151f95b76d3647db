"""Tables in versions: a reader sees one whole version or the one before.

A version is written to a folder of its own; only when it is complete does an empty file in
``_versions`` name it.  The last such name is the version that counts.  Nothing is overwritten or renamed,
so this holds on file systems and object stores alike, and a reader of an older version keeps it until it is pruned.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

_NAMES = "_versions"


def _system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join((path.rstrip("/"), *parts)))


def versions(spark: SparkSession, path: str) -> list[str]:
    """Folders of the versions that are complete, the oldest first."""
    system, at = _system(spark, path)
    if not system.exists(at(_NAMES)):
        return []
    names = sorted(s.getPath().getName() for s in system.listStatus(at(_NAMES)))
    return [n for n in names if re.fullmatch(r"\d{12}-[0-9a-f]{32}", n)]


def publish(df: DataFrame, path: str, partition_by: Sequence[str] = (), add: bool = False) -> str:
    """Write a version, with ``add`` after the rows of the last one, and make it the one that counts."""
    spark = df.sparkSession
    before = versions(spark, path)
    if add and before:
        df = spark.read.parquet(f"{path.rstrip('/')}/{before[-1]}").select(*df.columns).unionByName(df)
    name = f"{int(before[-1][:12]) + 1 if before else 0:012d}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(f"{path.rstrip('/')}/{name}")
    system, at = _system(spark, path)
    system.mkdirs(at(_NAMES))
    system.createNewFile(at(_NAMES, name))
    return name


def exists(spark: SparkSession, path: str) -> bool:
    return bool(versions(spark, path))


def load(spark: SparkSession, path: str, version: str | None = None) -> DataFrame | None:
    """The version that counts, or the one that is named; None where there is none."""
    known = versions(spark, path)
    name = version or (known[-1] if known else None)
    return spark.read.parquet(f"{path.rstrip('/')}/{name}") if name in known else None


def prune(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Delete all but the last versions: first their names, then their rows; gives the names."""
    gone = versions(spark, path)[:-keep] if keep else versions(spark, path)
    system, at = _system(spark, path)
    for name in gone:
        system.delete(at(_NAMES, name), False)
        system.delete(at(name), True)
    return gone


def delete(spark: SparkSession, path: str) -> bool:
    """Delete the table with all versions; whether there was one."""
    system, at = _system(spark, path)
    there = exists(spark, path)
    prune(spark, path, keep=0)
    system.delete(at(), True)
    return there
