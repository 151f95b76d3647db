"""Listings of stored trees, from a table of file paths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FOLDER, _FILE = "0", "1"  # folders come before files


def _parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: x != "")


def _sort_key(parts: Column, last: str) -> Column:
    """Names from the root, each after a sign of its kind; ascending keys list a folder before what lies in it."""
    return F.array_join(F.transform(parts, lambda x, i: F.concat(F.when(i == F.size(parts) - 1, F.lit(last)).otherwise(F.lit(_FOLDER)), F.lower(x), F.lit("\u0001"), x)), "\u0002")


def listing(files: DataFrame, skip: Sequence[str] = (), folders: DataFrame | None = None) -> DataFrame:
    """(path, depth, is_folder, n_files, sort_key) of every file and folder of a table (path).

    Ordered by ``sort_key`` the rows are the tree from top to bottom, folders before files and
    names without regard to case.  Files below a folder named in ``skip`` are left out.  ``folders`` (path) are
    folders that may hold nothing.  Paths that are null or have no name are in no row; equal paths are one file.
    """
    own = files.select(_parts(F.col("path")).alias("p")).where("size(p) > 0").distinct()
    inside = F.slice("p", F.lit(1), F.greatest(F.size("p") - 1, F.lit(0)))
    if skip:
        own = own.where(~F.arrays_overlap(inside, F.array(*map(F.lit, skip))) | (F.size(inside) == 0))
    listed = own.select(F.col("p"), F.lit(False).alias("is_folder"), F.lit(1).alias("n"))
    above = own.where("size(p) > 1").select(F.explode(F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda k: F.slice("p", F.lit(1), k))).alias("p"), F.lit(1).alias("n"))
    if folders is not None:
        extra = folders.select(_parts(F.col("path")).alias("q")).where("size(q) > 0")
        extra = extra.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("q")), lambda k: F.slice("q", F.lit(1), k))).alias("p"))
        if skip:
            extra = extra.where(~F.arrays_overlap("p", F.array(*map(F.lit, skip))))
        above = above.unionByName(extra.select("p", F.lit(0).alias("n")))
    counted = above.groupBy("p").agg(F.sum("n").alias("n")).select("p", F.lit(True).alias("is_folder"), "n")
    rows = listed.unionByName(counted)
    key = F.when(F.col("is_folder"), _sort_key(F.col("p"), _FOLDER)).otherwise(_sort_key(F.col("p"), _FILE))
    return rows.select(F.array_join("p", "/").alias("path"), (F.size("p") - 1).alias("depth"), "is_folder", F.col("n").cast("long").alias("n_files"), key.alias("sort_key"))


def empty_folders(folders: DataFrame, files: DataFrame) -> DataFrame:
    """Folders (path) without a file in or below them, the deepest of a branch first by ``depth``: what can be pruned."""
    return listing(files, folders=folders).where("is_folder and n_files = 0").select("path", "depth")
