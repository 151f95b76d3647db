"""Queries of the operators of summaries, notes, operands, joined results and recursive chunks.

Made-up rows are written once for each supplier, as in the queries over made-up sources.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.operators import chunks, mainframe, summaries
from quarrystone.plans.catalogue import query, table
from quarrystone.plans.source_tables import _values
from quarrystone.sources import notes

_SUMMARY = """filename string, purpose string, entity string, table_name string, host_structure string, table_structure array<string>, register_usage array<string>,
    functionalities array<string>, key_operations array<string>, notes array<string>, key_fields array<string>, workload_identity array<string>,
    dependencies_triggers array<string>, operational_rules array<string>, configuration_areas array<string>, key_parameters array<string>"""


def _each(spark: SparkSession, d: str, schema: str, *rows: dict) -> DataFrame:
    """The rows for each supplier, the sign § of their JSON replaced by its key."""
    import json

    texts = F.array(*(F.lit(json.dumps(r)) for r in rows))
    key = F.col("s_suppkey").cast("string")
    made = table(spark, d, "supplier").select(F.explode(F.transform(texts, lambda t: F.replace(F.replace(t, F.lit("\\u00a7"), key), F.lit("§"), key))).alias("j"))
    return made.select(F.from_json("j", schema).alias("r")).select("r.*")


def _section(kind: str, row: dict, expected: Sequence[str]) -> None:
    lines = [("f§", i, line) for i, line in enumerate([*expected, "---", ""])]

    @query(f"summary_section_{kind}", _values(["filename", "n", "line"], lines))
    def run(spark: SparkSession, d: str) -> DataFrame:
        found = summaries.section_lines(_each(spark, d, _SUMMARY, {"filename": "f§", **row}), kind)
        return found.select("filename", F.col("n").cast("long").alias("n"), "line")


_section(
    "program",
    {"purpose": "pays §", "functionalities": ["a", None, "b§"], "register_usage": ["R1 base"], "notes": []},
    ["### f§", "**Purpose**: pays §", "", "**Register Usage**:", "- R1 base", "", "**Functionalities**:", "- a", "- b§", ""],
)
_section(
    "dclgen",
    {"host_structure": "DCLEMP", "table_structure": ["ID|CHAR(5) | NO", "ODD § row", " A | B | C "], "notes": ["n§"]},
    ["### f§", "**Table**: `UNKNOWN`", "**Host Structure**: `DCLEMP`", "**Purpose**: N/A", "", "| Column Name | DB2 Type | Nullable? |", "| :--- | :--- | :--- |", "| ID | CHAR(5) | NO |", "| ODD § row | - | - |", "| A | B | C |", "", "**Notes**:", "- n§", ""],
)
_section("copybook", {"purpose": "p", "entity": "Customer §", "key_fields": ["K1", "K2"]}, ["### f§", "**Purpose**: p", "**Entity**: Customer §", "", "**Key Fields**:", "- K1", "- K2", ""])
_section(
    "ca7",
    {"purpose": "p", "workload_identity": ["JOB§"], "dependencies_triggers": ["after A"], "operational_rules": ["r"]},
    ["### f§", "**Purpose**: p", "", "**Workload Identity**:", "- JOB§", "", "**Dependencies & Triggers**:", "- after A", "", "**Operational Rules**:", "- r", ""],
)
_section("parmlib", {"configuration_areas": ["SORT"], "key_parameters": ["K=§"]}, ["### f§", "**Purpose**: N/A", "", "**Configuration Areas**:", "- SORT", "", "**Key Parameters**:", "- K=§", ""])


@query(
    "job_recovery",
    """WITH j AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'a restart=STEP2 and GDG' WHEN 1 THEN 'writes A.B(+1)' WHEN 2 THEN 'plain' END AS t, p_partkey % 3 AS steps FROM part),
    s AS (SELECT 'J' || p_partkey AS filename, steps, CASE WHEN contains(upper(t), 'RESTART=') THEN 'Explicit Point Restart' WHEN contains(upper(t), 'GDG') OR contains(upper(t), '(+') THEN 'Data-Level Rollback (GDG)' ELSE 'Standard Step Restart' END AS strategy FROM j)
    SELECT filename, strategy FROM s WHERE steps > 1 OR strategy <> 'Standard Step Restart'""",
)
def job_recovery(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("p_partkey")
    analysis = F.when(key % 4 == 0, "a restart=STEP2 and GDG").when(key % 4 == 1, "writes A.B(+1)").when(key % 4 == 2, "plain")
    return summaries.recovery(table(spark, d, "part").select(F.concat(F.lit("J"), key).alias("filename"), analysis.alias("analysis"), (key % 3).alias("steps")))


@query(
    "error_handling",
    """SELECT DISTINCT 'P' || p_partkey AS component, 'Internal Exception Logic' AS handling, 'Programmatic' AS level FROM part WHERE p_partkey % 3 = 0
    UNION SELECT DISTINCT 'J' || (p_partkey % 50), 'Conditional Step Execution', 'Batch Control' FROM part WHERE p_partkey % 5 = 1""",
)
def error_handling(spark: SparkSession, d: str) -> DataFrame:
    key, part = F.col("p_partkey"), table(spark, d, "part")
    jobs = part.select(F.concat(F.lit("J"), key % 50).alias("filename"), F.when(key % 5 == 1, "cond=(4,LT)").otherwise("none").alias("notes"))
    programs = part.select(F.concat(F.lit("P"), key).alias("filename"), F.when(key % 3 == 0, "tests sqlcode").when(key % 3 == 1, "plain").alias("notes"))
    return summaries.error_handling(jobs, programs)


@query(
    "rules_by_module",
    r"""WITH m AS (SELECT 'd' || doc_id AS filename, length(text)::BIGINT AS n_chars, regexp_extract_all(text, '(?m)^[A-Z][a-z]+ [a-z]+') AS rules FROM documents WHERE length(text) > 0)
    SELECT filename, n_chars, unnest(generate_series(0, len(rules) - 1))::BIGINT AS n, unnest(rules) AS rule FROM m WHERE len(rules) > 0
    UNION ALL SELECT filename, n_chars, NULL, NULL FROM m WHERE len(rules) = 0""",
)
def rules_by_module(spark: SparkSession, d: str) -> DataFrame:
    modules = table(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("filename"), F.col("text").alias("description"), F.regexp_extract_all("text", F.lit(r"(?m)^[A-Z][a-z]+ [a-z]+"), F.lit(0)).alias("rules"))
    return summaries.rules_by_module(modules).withColumns({"n_chars": F.col("n_chars").cast("long"), "n": F.col("n").cast("long")})


@query(
    "run_status_update",
    """SELECT coalesce(o.k, n.k) AS project, CASE WHEN n.k IS NULL THEN 'running' ELSE 'done' END AS status, coalesce(n.total, o.total) AS total_files,
    CASE WHEN n.k IS NULL THEN 'f' || o.k END AS current_file, NULL::VARCHAR AS error, CASE WHEN o.k IS NULL THEN 'later' ELSE 'first' END AS started_at, CASE WHEN n.k IS NULL THEN 'first' ELSE 'later' END AS updated_at
    FROM (SELECT c_custkey AS k, c_custkey * 2 AS total FROM customer WHERE c_custkey % 2 = 0) o
    FULL JOIN (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN 7 END AS total FROM customer WHERE c_custkey % 3 = 0) n ON o.k = n.k""",
)
def run_status_update(spark: SparkSession, d: str) -> DataFrame:
    k, customer = F.col("c_custkey").cast("long"), table(spark, d, "customer")
    null = F.lit(None).cast("string")
    state = lambda status, total, file, at: [k.alias("project"), F.lit(status).alias("status"), total.cast("long").alias("total_files"), file.alias("current_file"), null.alias("error"), F.lit(at).alias("updated_at")]
    old = customer.where(k % 2 == 0).select(*state("running", k * 2, F.concat(F.lit("f"), k), "first"), F.lit("first").alias("started_at"))
    return summaries.updated_status(old, customer.where(k % 3 == 0).select(*state("done", F.when(k % 4 == 0, 7), null, "later")))


@query(
    "assembler_operands",
    _values(["raw", "tokens"], [("R§", "R§"), ("=F'1'", "=F'1'"), ("12(R3)", "12 ( R3 )"), ("A+4", "A + 4")]),
)
def assembler_operands(spark: SparkSession, d: str) -> DataFrame:
    made = _each(spark, d, "text string", {"text": "R§ , =F'1',,12(R3) ,A+4"}, {"text": None}, {"text": " , "})
    return made.select(F.explode(mainframe.operands("text")).alias("o")).select("o.raw", F.array_join("o.tokens", " ").alias("tokens"))


_JSON = {"list": '[{"name": "A§", "n": 1}, {"name": "B§"}]', "dict": '{"name": "C§", "n": 3}', "scalar": "42", "broken": '[{"name": ', "empty": "[]"}


def _joined(spark: SparkSession, d: str) -> DataFrame:
    made = _each(spark, d, "path string, text string", *({"path": f"out§/cobol/{k}/_consolidated.json", "text": t} for k, t in _JSON.items()))
    return made


@query("consolidated_records", _values(["path", "name", "n"], [("out§/cobol/list/_consolidated.json", "A§", 1), ("out§/cobol/list/_consolidated.json", "B§", None), ("out§/cobol/dict/_consolidated.json", "C§", 3)]))
def consolidated_records(spark: SparkSession, d: str) -> DataFrame:
    return notes.consolidated(_joined(spark, d), "name string, n long")[0]


@query("consolidated_rejects", _values(["path", "reason"], [("out§/cobol/broken/_consolidated.json", "no JSON")]))
def consolidated_rejects(spark: SparkSession, d: str) -> DataFrame:
    return notes.consolidated(_joined(spark, d), "name string, n long")[1]


@query("parsed_types", _values(["path", "file_type"], [("out§/cobol/_consolidated.json", "COBOL"), ("out§/Jcl/_consolidated.json", "JCL")]))
def parsed_types(spark: SparkSession, d: str) -> DataFrame:
    paths = ("out§/cobol/_consolidated.json", "out§/Jcl/_consolidated.json", "out§/other/_consolidated.json", "out§/jcl/a.json")
    return notes.of_parsed_type(_each(spark, d, "path string, text string", *({"path": p} for p in paths)), ["cobol", "jcl"]).select("path", "file_type")


@query("chain_steps", _values(["chain", "n", "job", "description"], [("c§", 1, "J1", "reads"), ("c§", 2, "Unknown", "sorts §"), ("c§", 3, "J3", "")]))
def chain_steps(spark: SparkSession, d: str) -> DataFrame:
    made = _each(spark, d, notes.NOTES["job_chains"], {"chain": "c§", "steps": [{"job": "J1", "description": "reads"}, {"description": "sorts §"}, {"job": "J3"}]}, {"chain": "none", "steps": []})
    return notes.chain_steps(made).withColumn("n", F.col("n").cast("long"))


@query(
    "component_status",
    """SELECT o_custkey AS component, arg_max(o_orderstatus, (o_orderdate, o_orderstatus, o_orderpriority)) AS status, arg_max(o_orderpriority, (o_orderdate, o_orderstatus, o_orderpriority)) AS notes, max(o_orderdate) AS noted_at
    FROM orders GROUP BY o_custkey""",
)
def component_status(spark: SparkSession, d: str) -> DataFrame:
    return notes.latest_status(table(spark, d, "orders").selectExpr("o_custkey AS component", "o_orderstatus AS status", "o_orderpriority AS notes", "o_orderdate AS noted_at"))


@query("recursive_chunks")
def recursive_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunks.recursive(table(spark, d, "documents"), "doc_id")
