"""Bytes of project files under a root folder: <root>/<project>/<type>/<name>.

Single files are saved and deleted through the file system of the session, so that the root
can be any storage that it knows; tables of files are read by Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _at(spark: SparkSession, root: str, *parts: str):
    """The file system and the path; a part that could lead elsewhere is an error."""
    for p in parts:
        if not p or p in (".", "..") or "/" in p or "\\" in p or "\0" in p:
            raise ValueError(f"no name of a file or folder: {p!r}")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join((root.rstrip("/"), *parts)))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def save(spark: SparkSession, root: str, project_id: str, file_type: str, filename: str, content: bytes) -> str:
    """Write a file, over one of that name if there is one; gives its path."""
    system, path = _at(spark, root, project_id, file_type, filename)
    out = system.create(path, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()
    return path.toString()


def exists(spark: SparkSession, root: str, project_id: str, file_type: str, filename: str) -> bool:
    system, path = _at(spark, root, project_id, file_type, filename)
    return system.exists(path)


def read(spark: SparkSession, root: str, project_id: str, file_type: str, filename: str) -> bytes:
    """The bytes of one file; FileNotFoundError where there is none."""
    system, path = _at(spark, root, project_id, file_type, filename)
    if not system.exists(path):
        raise FileNotFoundError(path.toString())
    stream = system.open(path)
    try:
        return bytes(stream.readAllBytes())
    finally:
        stream.close()


def prune(spark: SparkSession, root: str, project_id: str, file_type: str) -> None:
    """Delete the folder of a type if nothing is in it, then that of the project likewise."""
    for parts in ((project_id, file_type), (project_id,)):
        system, path = _at(spark, root, *parts)
        if system.exists(path) and not system.listStatus(path):
            system.delete(path, False)


def delete(spark: SparkSession, root: str, project_id: str, file_type: str, filename: str) -> bool:
    """Delete a file, and its folders where nothing else is in them; whether there was one."""
    system, path = _at(spark, root, project_id, file_type, filename)
    there = system.exists(path) and system.delete(path, False)
    prune(spark, root, project_id, file_type)
    return bool(there)


def delete_project(spark: SparkSession, root: str, project_id: str) -> bool:
    """Delete the folder of a project with all in it; whether there was one."""
    system, path = _at(spark, root, project_id)
    return bool(system.exists(path) and system.delete(path, True))


def stored(spark: SparkSession, root: str) -> DataFrame:
    """(project_id, file_type, filename, length, modified, content) of every file of the store; without ``content`` selected only the names are listed."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    part = lambda n: F.try_element_at(F.split("path", "/"), F.lit(n))
    return found.select(part(-3).alias("project_id"), part(-2).alias("file_type"), part(-1).alias("filename"), "length", F.col("modificationTime").alias("modified"), "content")


def contents(files: DataFrame, store: DataFrame) -> DataFrame:
    """Rows of a catalogue with their bytes and whether they were found: a row may be there whose file isn't."""
    keys = ["project_id", "file_type", "filename"]
    side = store.select(*keys, F.col("content").alias("__content"), F.lit(True).alias("__found"))
    return files.join(side, keys, "left").select(*(files[c] for c in files.columns), F.col("__content").alias("content"), F.coalesce("__found", F.lit(False)).alias("found"))
