"""Parts of documents about an estate: files with a summary, joined summaries, data dependencies of programs, heavily used modules.

An empty table gives an empty result; columns beside those named are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.sources import notes

# The file in a folder of summaries that isn't one, and the texts for modules.
STATUS_FILE = "_status.json"
WITHOUT_SUMMARY = "Core Processing"
WITHOUT_CATEGORY = "Business Logic"
PROFILE = "High (Critical Path)"


def _is_summary():
    name = F.element_at(F.split("path", "/"), -1)
    return F.endswith(name, F.lit(".json")) & (name != STATUS_FILE)


def finished_summaries(files: DataFrame) -> DataFrame:
    """Summaries in each folder, folders below it not counted: (folder, n_files); a folder with other files only has 0."""
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    return files.where(F.col("path").isNotNull()).groupBy(folder.alias("folder")).agg(F.count_if(_is_summary()).alias("n_files"))


def merged_summaries(files: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """Summaries in files (path, text) by path, and the files that are no JSON with a reason."""
    records, rejects = notes.consolidated(files.where(_is_summary()), schema)
    return records.orderBy("path"), rejects


def data_dependencies(programs: DataFrame) -> DataFrame:
    """What each program does with which data, once each: (filename, target, operation); programs (filename, data_interactions array of struct).

    A null target or operation is a value like any other; programs without interactions give no rows.
    """
    return programs.select("filename", F.inline("data_interactions")).select("filename", "target", "operation").distinct()


def hot_modules(modules: DataFrame, summaries: DataFrame) -> DataFrame:
    """Heavily used modules with their area: (name, area, profile); modules (name), summaries (filename, n, functional_category).

    The first summary by n of a file counts; a module may have none, a summary no category.
    """
    told = F.coalesce("functional_category", F.lit(WITHOUT_CATEGORY))
    first = summaries.groupBy(F.col("filename").alias("name")).agg(F.min_by(told, F.struct("n", told)).alias("area"))
    return modules.select("name").join(first, "name", "left").select("name", F.coalesce("area", F.lit(WITHOUT_SUMMARY)).alias("area"), F.lit(PROFILE).alias("profile"))


def file_list(summaries: DataFrame) -> DataFrame:
    """Files with a summary and their types: (filename, file_type)."""
    return summaries.select("filename", "file_type")
