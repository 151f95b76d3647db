"""Queries of diagnostics of PL/I, members and scripts, and of introductions, over texts that Spark writes from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.operators import diagnostics, harvest
from quarrystone.plans.catalogue import query, table
from quarrystone.plans.generated_tables import _filled, scripts
from quarrystone.plans.written_tables import pli_programs


def _run(spark: SparkSession, d: str) -> DataFrame:
    """PL/I programs with or without a statement of no kind and an open comment, members, scripts and blank files."""
    k = F.regexp_replace("filename", "^L", "").cast("long")
    filled = lambda t: F.replace(F.lit(t), F.lit("{k}"), k.cast("string"))
    tail = F.when(k % 3 == 0, filled(" FROB{k} THE\n  /* ; */ THING(';'); A.B(1, F(2)) -> C += 1; ;\n lbl(2): ODD WORDS;\n")).when(k % 3 == 1, filled(" DCL X CHAR(2) INIT('/*');\n/* open {k}\n ;\n")).otherwise(F.lit(" Y = 'it''s';\n X = 'open\n"))
    pli = pli_programs(spark, d).select("filename", F.lit("pli").alias("file_type"), F.concat("text", tail).alias("text"))
    own = lambda t: _filled(t, k="s_suppkey", nation="s_nationkey")
    plain = F.when(F.col("s_acctbal") > 0, own("USE &HLQ{nation}\n")).otherwise(own("plain words {k}\n\n  more, of them\n"))
    members = table(spark, d, "supplier").select(F.concat(F.lit("M"), "s_suppkey").alias("filename"), F.lit("ctl").alias("file_type"), F.concat(own(" * plain\nREGION={k}M\n"), plain, own("  sort fields=(1,2)\n  copy from A.B{k}\n")).alias("text"))
    blank = table(spark, d, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("filename"), F.get(F.array(*(F.lit(t) for t in ("copybook", "jcl", "dclgen", "cobol"))), (F.col("c_custkey") % 4).cast("int")).alias("file_type"), F.lit(" \n").alias("text"))
    return pli.unionByName(members).unionByName(scripts(spark, d).withColumn("file_type", F.lit("rexx"))).unionByName(blank)


_MORE = """WITH m AS (SELECT 'L' || p_partkey AS filename, p_partkey AS k, 10 + CASE WHEN p_size % 2 = 0 THEN 4 ELSE 2 END + CASE WHEN p_size > 25 THEN 5 ELSE 1 END AS n FROM part),
s AS (SELECT 'M' || s_suppkey AS filename, s_suppkey AS k, s_acctbal > 0 AS good FROM supplier),
c AS (SELECT 'C' || c_custkey AS filename, ['copybook', 'jcl', 'dclgen', 'cobol'][1 + c_custkey % 4] AS file_type FROM customer),
e AS (
  SELECT filename, 'pli' AS file_type, 'unrecognized' AS error_type, 'No statement recognised' AS message, n + 1 AS line, 'FROB' || k || ' THE' AS content FROM m WHERE k % 3 = 0
  UNION ALL SELECT filename, 'pli', 'unrecognized', 'No statement recognised', n + 3, 'lbl(2): ODD WORDS;' FROM m WHERE k % 3 = 0
  UNION ALL SELECT filename, 'pli', 'warning', 'comment without an end', n + 2, NULL FROM m WHERE k % 3 = 1
  UNION ALL SELECT filename, 'pli', 'unrecognized', 'No statement recognised', n + 2, 'X = ''open' FROM m WHERE k % 3 = 2
  UNION ALL SELECT filename, 'pli', 'warning', 'string without an end', n + 2, NULL FROM m WHERE k % 3 = 2
  UNION ALL SELECT filename, 'ctl', 'unrecognized', 'Nothing recognised', 3, 'plain words ' || k FROM s WHERE NOT good
  UNION ALL SELECT filename, 'ctl', 'unrecognized', 'Nothing recognised', 5, 'more, of them' FROM s WHERE NOT good
  UNION ALL SELECT filename, file_type, 'warning', 'File is empty', NULL, NULL FROM c WHERE file_type = 'copybook'
  UNION ALL SELECT filename, file_type, 'fatal', 'empty file', NULL, NULL FROM c WHERE file_type = 'cobol'),
files AS (SELECT filename, 'pli' AS file_type FROM m UNION ALL SELECT filename, 'ctl' FROM s UNION ALL SELECT 'R' || k, 'rexx' FROM s UNION ALL SELECT filename, file_type FROM c)
"""


@query("parse_errors_more", _MORE + "SELECT filename, file_type, error_type, message, line::BIGINT AS line, content FROM e")
def parse_errors_more(spark: SparkSession, d: str) -> DataFrame:
    return diagnostics.parse_errors(_run(spark, d)).withColumn("line", F.col("line").cast("long"))


@query(
    "parse_summary_more",
    _MORE + """
    SELECT file_type, count(DISTINCT filename) AS total_files, count(DISTINCT filename) - count(DISTINCT CASE WHEN error_type = 'fatal' THEN filename END) AS successful,
           count(DISTINCT CASE WHEN error_type = 'fatal' THEN filename END) AS failed, count(DISTINCT CASE WHEN error_type IS NOT NULL THEN filename END) AS files_with_errors,
           count(*) FILTER (error_type = 'fatal') AS fatal, count(*) FILTER (error_type = 'warning') AS warning, count(*) FILTER (error_type = 'unrecognized') AS unrecognized
    FROM files LEFT JOIN e USING (filename, file_type) GROUP BY file_type
    """,
)
def parse_summary_more(spark: SparkSession, d: str) -> DataFrame:
    files = _run(spark, d)
    return diagnostics.summary_of(files, diagnostics.parse_errors(files))


@query(
    "introduction",
    """
    WITH c AS (SELECT c_custkey AS k, c_mktsegment AS seg, c_nationkey AS nation, c_custkey % 4 AS kind FROM customer),
    n AS (SELECT k, seg, nation, kind, count(o_orderkey) AS n FROM c LEFT JOIN orders ON o_custkey = k GROUP BY ALL)
    SELECT k AS project, section, position::BIGINT AS position, heading, text FROM (
      SELECT k, 'overview' AS section, 1 AS position, NULL AS heading, CASE kind WHEN 0 THEN 'First of ' || k WHEN 3 THEN 'Overview unavailable.' ELSE 'For ' || seg END AS text FROM n
      UNION ALL SELECT k, 'overview', 2, NULL, 'Second' FROM n WHERE kind = 0
      UNION ALL SELECT k, 'purpose', 1, NULL, CASE kind WHEN 3 THEN 'The system facilitates core data processing.' ELSE 'For ' || seg END FROM n
      UNION ALL SELECT k, 'processes', 1, NULL, CASE WHEN kind < 2 THEN 'The system encompasses the following core business processes:' ELSE 'The system is comprised of ' || n || ' processing modules handling batch transactions.' END FROM n
      UNION ALL SELECT k, 'processes', 2, 'Serve ' || nation, 'all of it' FROM n WHERE kind < 2
      UNION ALL SELECT k, 'processes', 3, 'Process', '' FROM n WHERE kind < 2
      UNION ALL SELECT k, 'glossary', 1, CASE kind WHEN 0 THEN 'A' || nation ELSE 'T' || nation END, CASE kind WHEN 0 THEN 'short' ELSE '' END FROM n WHERE kind < 2)
    """,
)
def introduction(spark: SparkSession, d: str) -> DataFrame:
    """A system of each customer, its modules being the orders."""
    kind = F.col("c_custkey") % 4
    own = lambda t: _filled(t, k="c_custkey", seg="c_mktsegment", nation="c_nationkey")
    processes = '"business_purpose": "For {seg}", "key_business_processes": ["no object", {"process_name": "Serve {nation}", "description": "all of it"}, {"other": 1}], "glossary": [{"term": "T{nation}"}, 7]'
    body = (
        F.when(kind == 0, own('{"executive_narrative": "First of {k}\\n \\n  Second ", ' + processes + ', "harvested_acronyms": [{"term": "A{nation}", "definition": "short"}]}'))
        .when(kind == 1, own('{"executive_narrative": "", ' + processes + ', "harvested_acronyms": []}'))
        .when(kind == 2, own('{"business_purpose": "For {seg}", "key_business_processes": "none", "executive_narrative": null}'))
        .otherwise(F.lit("no JSON"))
    )
    modules = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n_modules"))
    systems = table(spark, d, "customer").join(modules, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.col("c_custkey").alias("project"), body.alias("body"), F.coalesce("n_modules", F.lit(0)).alias("n_modules"))
    return harvest.introduction(systems).withColumn("position", F.col("position").cast("long"))
