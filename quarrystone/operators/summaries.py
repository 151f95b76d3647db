"""Documents from the summaries of files: Markdown by type, recovery and error handling, rules by module, state of a run.

Summaries have a filename, a purpose and lists of texts; a list that is null, empty
or not among the columns gives no lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The lists of a summary by kind of section, with their titles.
SECTION_LISTS = {
    "program": {"register_usage": "Register Usage", "functionalities": "Functionalities", "key_operations": "Key Operations", "notes": "Notes"},
    "dclgen": {"notes": "Notes"},
    "copybook": {"key_fields": "Key Fields"},
    "ca7": {"workload_identity": "Workload Identity", "dependencies_triggers": "Dependencies & Triggers", "operational_rules": "Operational Rules", "notes": "Notes"},
    "parmlib": {"configuration_areas": "Configuration Areas", "key_parameters": "Key Parameters", "notes": "Notes"},
}
# Words in the notes of a program that show handling of errors.
ERROR_WORDS = ("ABEND", "SQLCODE", "INVALID KEY", "ERROR-LOG")


def _texts(*parts: Column | str) -> Column:
    return F.array(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _none() -> Column:
    return F.array().cast("array<string>")


def _if_any(items: Column, head: list[str], line) -> Column:
    return F.when(F.size(items) > 0, F.concat(_texts(*head), F.transform(items, line), _texts(""))).otherwise(_none())


def _structure_row(text: Column) -> Column:
    """A column of a table declared as ``name | type | nullable``; anything else stays whole in the first cell."""
    parts = F.transform(F.split(text, r"\|"), lambda p: F.btrim(p))
    cells = F.when(F.size(parts) == 3, F.array_join(parts, " | ")).otherwise(F.concat(text, F.lit(" | - | -")))
    return F.concat(F.lit("| "), cells, F.lit(" |"))


def section_lines(summaries: DataFrame, kind: str) -> DataFrame:
    """The lines of a section, in the order of filename and n: (filename, n, line).

    One summary a filename. Rows without a filename are left out; an empty table gives no lines.
    """
    have = set(summaries.columns)
    items = lambda name: F.filter(F.col(name), lambda x: x.isNotNull()) if name in have else _none()
    or_else = lambda name, default: F.coalesce(F.col(name), F.lit(default)) if name in have else F.lit(default)
    quoted = lambda title, c: F.concat(F.lit(f"**{title}**: `"), c, F.lit("`"))
    purpose = F.concat(F.lit("**Purpose**: "), or_else("purpose", "N/A"))
    entity = or_else("entity", "")
    parts = [_texts(F.concat(F.lit("### "), "filename"))]
    if kind == "dclgen":
        head = ["| Column Name | DB2 Type | Nullable? |", "| :--- | :--- | :--- |"]
        parts += [_texts(quoted("Table", or_else("table_name", "UNKNOWN")), quoted("Host Structure", or_else("host_structure", "N/A")), purpose, ""), _if_any(items("table_structure"), head, _structure_row)]
    elif kind == "copybook":
        parts += [_texts(purpose), F.when(entity != "", _texts(F.concat(F.lit("**Entity**: "), entity))).otherwise(_none()), _texts("")]
    else:
        parts += [_texts(purpose, "")]
    parts += [_if_any(items(name), [f"**{title}**:"], lambda x: F.concat(F.lit("- "), x)) for name, title in SECTION_LISTS[kind].items()]
    return summaries.where(F.col("filename").isNotNull()).select("filename", F.posexplode(F.concat(*parts, _texts("---", ""))).alias("n", "line"))


def recovery(jobs: DataFrame) -> DataFrame:
    """How a job is restarted, for jobs of more than one step or with a way of their own: (filename, strategy); jobs (filename, analysis, steps)."""
    text = F.upper(F.coalesce("analysis", F.lit("")))
    has = lambda word: F.contains(text, F.lit(word))
    strategy = F.when(has("RESTART="), "Explicit Point Restart").when(has("GDG") | has("(+"), "Data-Level Rollback (GDG)").otherwise("Standard Step Restart")
    return jobs.select("filename", strategy.alias("strategy"), F.coalesce("steps", F.lit(0)).alias("__steps")).where("__steps > 1 OR strategy <> 'Standard Step Restart'").drop("__steps")


def error_handling(jobs: DataFrame, programs: DataFrame) -> DataFrame:
    """Distinct components whose notes show handling of errors: (component, handling, level); both tables have (filename, notes)."""
    text = F.upper(F.coalesce("notes", F.lit("")))
    conditional = jobs.where(F.contains(text, F.lit("COND"))).select(F.col("filename").alias("component"), F.lit("Conditional Step Execution").alias("handling"), F.lit("Batch Control").alias("level"))
    own = F.exists(_texts(*ERROR_WORDS), lambda w: F.contains(text, w))
    internal = programs.where(own).select(F.col("filename").alias("component"), F.lit("Internal Exception Logic").alias("handling"), F.lit("Programmatic").alias("level"))
    return conditional.unionByName(internal).distinct()


def rules_by_module(modules: DataFrame) -> DataFrame:
    """Modules with a description, the longest first, and each rule in its place: (filename, n_chars, n, rule); modules (filename, description, rules).

    A module without rules has one row with null in n and rule.
    """
    told = modules.where(F.length("description") > 0).select("filename", F.length("description").alias("n_chars"), F.posexplode_outer("rules").alias("n", "rule"))
    return told.orderBy(F.desc("n_chars"), "filename", "n")


def updated_status(old: DataFrame, new: DataFrame) -> DataFrame:
    """The state of each project after an update: (project, status, total_files, current_file, error, started_at, updated_at).

    total_files stays where the update has none, started_at is the first one known;
    a project that isn't updated stays as it is. One row a project in either table.
    """
    o, n = F.col("o"), F.col("n")
    both = old.select("project", F.struct(*old.columns).alias("o")).join(new.select("project", F.struct(*new.columns).alias("n")), "project", "full")
    taken = lambda c: F.when(n.isNull(), o[c]).otherwise(n[c]).alias(c)
    return both.select("project", taken("status"), F.coalesce(n["total_files"], o["total_files"]).alias("total_files"), taken("current_file"), taken("error"), F.coalesce(o["started_at"], n["updated_at"]).alias("started_at"), taken("updated_at"))
