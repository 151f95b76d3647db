"""Tables of notes that a review of an estate appends to, and the joined results of parsers.

A kind of notes is a folder of Parquet files; a note gets the time when it is written.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# The columns of a note by kind.
NOTES = {
    "catalog": "domain string, functionality_id string, name string, description string, implemented_by array<string>",
    "job_chains": "chain string, steps array<struct<job: string, description: string>>, trigger string, purpose string",
    "gaps": "component string, gap_type string, reason string, remediation string",
    "overview": "section string, content string",
    "inventory": "name string, component_type string, status string, notes string",
    "data_flows": "source string, target string, data_description string, direction string",
    "status": "component string, status string, notes string",
    "issues": "component string, issue_type string, description string",
    "unknown_utilities": "utility string, found_in string, context string",
}


def append_notes(notes: DataFrame, root: str, kind: str) -> None:
    """Adds rows to the notes of a kind; only its columns are taken, by name."""
    columns = StructType.fromDDL(NOTES[kind])
    stamped = notes.select(*(F.col(c.name).cast(c.dataType) for c in columns), F.current_timestamp().alias("noted_at"))
    stamped.write.mode("append").parquet(f"{root}/{kind}")


def start_notes(spark: SparkSession, root: str) -> None:
    """An empty table for each kind; tables that are there already stay as they are."""
    for kind, columns in NOTES.items():
        append_notes(spark.createDataFrame([], columns), root, kind)


def read_notes(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """All notes of a kind, with the time of each."""
    return spark.read.schema(f"{NOTES[kind]}, noted_at timestamp").parquet(f"{root}/{kind}")


def guide(spark: SparkSession, root: str, name: str, missing: str, title: str = "", empty: str | None = None) -> DataFrame:
    """The text of a guide in a folder, under its title: one row (content).

    Without such a file the row says what is ``missing``; a blank file says ``empty``, if that is given.
    """
    file = spark.read.format("binaryFile").option("pathGlobFilter", name).load(root)
    if not file.inputFiles():  # files without bytes are listed, but give no row
        return spark.range(1).select(F.lit(missing).alias("content"))
    content = F.coalesce(F.max(F.decode("content", "UTF-8")), F.lit("")).alias("content")
    told = F.concat(F.lit(f"=== {title} ===\n\n" if title else ""), "content")
    if empty is not None:
        told = F.when(F.btrim("content", F.lit(" \t\r\n")) == "", F.lit(empty)).otherwise(told)
    return file.agg(content).select(told.alias("content"))


def chain_steps(chains: DataFrame) -> DataFrame:
    """The steps of job chains, numbered from 1: (chain, n, job, description); a step without a job is Unknown."""
    one = chains.select("chain", F.posexplode("steps").alias("at", "s"))
    return one.select("chain", (F.col("at") + 1).alias("n"), F.coalesce("s.job", F.lit("Unknown")).alias("job"), F.coalesce("s.description", F.lit("")).alias("description"))


def latest_status(status: DataFrame) -> DataFrame:
    """The newest row of each component; of rows of one time the greatest by status and notes."""
    return status.groupBy("component").agg(F.max(F.struct("noted_at", "status", "notes")).alias("s")).select("component", "s.status", "s.notes", "s.noted_at")


def of_parsed_type(files: DataFrame, kinds: Sequence[str], name: str = "_consolidated.json") -> DataFrame:
    """Joined results whose folder is a known type, with the type in upper case: (path, text, file_type)."""
    folder = F.upper(F.try_element_at(F.split("path", "/"), F.lit(-2)))
    return files.where(F.endswith("path", F.lit("/" + name))).withColumn("file_type", folder).where(F.col("file_type").isin(*(k.upper() for k in kinds)))


def consolidated(files: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """Records and rejects of JSON texts (path, text): a list gives its objects, an object itself, another value none.

    Records carry their path beside the columns of the schema; rejects are (path,
    reason) for texts that are null or no JSON.
    """
    text = F.btrim("text", F.lit(" \t\r\n"))
    kind = F.when(F.startswith(text, F.lit("[")), "list").when(F.startswith(text, F.lit("{")), "object")
    valid = F.expr("try_parse_json(text)").isNotNull()
    records = files.where(kind.isNotNull() & valid).select("path", F.explode(F.from_json(text, f"array<struct<{schema}>>")).alias("r")).where(F.col("r").isNotNull()).select("path", "r.*")
    rejects = files.where(~F.coalesce(valid, F.lit(False))).select("path", F.lit("no JSON").alias("reason"))
    return records, rejects
