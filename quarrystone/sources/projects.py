"""Projects and their files as tables: every change gives a new table, which the caller writes.

Projects: (project_id, name, description, created_at, statuses map<string,string>); files: (project_id, file_type, filename, ...).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.sources.files import DEFAULT_LIMIT_MB, LIMITS_MB

#: Steps that a new project has before it.
STEPS = ("parsing", "dependencies", "summaries", "documents", "index", "code")


def created(projects: DataFrame, new: DataFrame, steps: Sequence[str] = STEPS) -> DataFrame:
    """With new projects (project_id, name, description), all steps pending; ids that exist are left as they are."""
    pending = F.map_from_arrays(F.array(*(F.lit(s) for s in steps)), F.array(*(F.lit("pending") for _ in steps)))
    rows = new.select("project_id", "name", "description", F.current_timestamp().alias("created_at"), pending.alias("statuses"))
    return projects.unionByName(rows.dropDuplicates(["project_id"]).join(projects.select("project_id"), "project_id", "left_anti"))


def updated(projects: DataFrame, changes: DataFrame) -> DataFrame:
    """Fields of changes (one row a project) that aren't null replace the old ones."""
    fields = [c for c in changes.columns if c != "project_id"]
    side = changes.select("project_id", *(F.col(c).alias(f"__{c}") for c in fields))
    both = projects.join(side, "project_id", "left")
    return both.select(*(F.coalesce(f"__{c}", c).alias(c) if c in fields else F.col(c) for c in projects.columns))


def with_status(projects: DataFrame, changes: DataFrame) -> DataFrame:
    """Statuses by step (project_id, step, status); of several for one step the greatest stays."""
    by_project = changes.groupBy("project_id", "step").agg(F.max("status").alias("status")).groupBy("project_id").agg(F.map_from_entries(F.collect_list(F.struct("step", "status"))).alias("__new"))
    both = projects.join(by_project, "project_id", "left")
    kept = F.map_filter("statuses", lambda k, v: ~F.coalesce(F.map_contains_key("__new", k), F.lit(False)))
    return both.withColumn("statuses", F.when(F.col("__new").isNull(), F.col("statuses")).otherwise(F.map_concat(kept, "__new"))).drop("__new")


def deleted(projects: DataFrame, files: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the projects whose ids are in ``gone``."""
    ids = gone.select("project_id").distinct()
    return projects.join(ids, "project_id", "left_anti"), files.join(ids, "project_id", "left_anti")


def without_files(files: DataFrame, gone: DataFrame) -> DataFrame:
    return files.join(gone.select("project_id", "file_type", "filename").distinct(), ["project_id", "file_type", "filename"], "left_anti")


def limit_mb(file_type: Column) -> Column:
    out = F.lit(DEFAULT_LIMIT_MB)
    for kind, mb in LIMITS_MB.items():
        out = F.when(file_type == kind, F.lit(mb)).otherwise(out)
    return out


def accepted(uploads: DataFrame, types: Sequence[str]) -> DataFrame:
    """Uploads (project_id, batch, file_type, filename, size) of batches in which every file has a known type, a name and a size within its limit: all or none of a batch."""
    known = F.coalesce(F.col("file_type").isin(*types), F.lit(False))
    fine = known & F.coalesce(F.length("filename") > 0, F.lit(False)) & F.coalesce((F.col("size") > 0) & (F.col("size") <= limit_mb(F.col("file_type")) * 1024 * 1024), F.lit(False))
    bad = uploads.where(~fine).select("project_id", "batch").distinct()
    return uploads.join(bad, (uploads["project_id"].eqNullSafe(bad["project_id"])) & (uploads["batch"].eqNullSafe(bad["batch"])), "left_anti")


def progress(tasks: DataFrame) -> DataFrame:
    """Percent of done tasks by project (project_id, done boolean), one decimal."""
    return tasks.groupBy("project_id").agg(F.count("*").alias("total"), F.count_if("done").alias("done")).withColumn("percent", F.round(100.0 * F.col("done") / F.col("total"), 1))


def output_status(projects: DataFrame, outputs: DataFrame, required: Sequence[str]) -> DataFrame:
    """Whether all required outputs (project_id, output) of each project are there: (project_id, status, progress, outputs).

    COMPLETED and 100 or PROCESSING and 0, with the required ones found, in order of name; without any required nothing is complete.
    """
    own = outputs.where(F.col("output").isin(*required)).groupBy("project_id").agg(F.array_sort(F.collect_set("output")).alias("found"))
    both = projects.select("project_id").join(own, "project_id", "left").withColumn("outputs", F.coalesce("found", F.array().cast("array<string>")))
    ready = (F.size("outputs") == len(set(required))) & F.lit(bool(required))
    return both.select("project_id", F.when(ready, "COMPLETED").otherwise("PROCESSING").alias("status"), F.when(ready, 100.0).otherwise(0.0).alias("progress"), "outputs")
