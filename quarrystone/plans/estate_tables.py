"""Registered queries of the estate, project and chunk operators on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.operators import estate, source_chunks
from quarrystone.plans.catalogue import query, table
from quarrystone.sources import files, projects


def _reports(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("name"), "text")


@query(
    "bullets_under_heading",
    """WITH l AS (SELECT doc_id, generate_subscripts(s, 1) AS n, unnest(s) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)),
    m AS (SELECT *, contains(t, 'the') AS o FROM l),
    s AS (SELECT *, last_value(CASE WHEN o THEN 1 WHEN starts_with(t, '**') OR starts_with(t, '##') THEN 0 END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n) AS open FROM m)
    SELECT doc_id AS name, count(*) FILTER (open = 1 AND starts_with(t, '- ') AND NOT o) AS bullets FROM s GROUP BY doc_id""",
)
def bullets_under_heading(spark: SparkSession, d: str) -> DataFrame:
    return estate.bullets_under(_reports(spark, d), "the")


_SUMMARIES = """s AS (SELECT CASE p_partkey % 6 WHEN 0 THEN 'COBOL' WHEN 1 THEN 'JCL' WHEN 2 THEN 'PARMLIB' WHEN 3 THEN 'DCLGEN' WHEN 4 THEN 'REXX' ELSE 'TEXT' END AS kind,
    CASE p_partkey % 5 WHEN 0 THEN 'uses vsam and CICS' WHEN 1 THEN 'a DFSORT run' WHEN 2 THEN 'DL/I with MQ' WHEN 3 THEN 'parses XML' END AS analysis FROM part)"""


def _summaries(spark: SparkSession, d: str) -> DataFrame:
    """Parts as files of six types with five kinds of analysis."""
    nth = lambda n, *names: F.get(F.array(*map(F.lit, names)), (F.col("p_partkey") % n).cast("int"))
    return table(spark, d, "part").select(F.col("p_name").alias("filename"), nth(6, "COBOL", "JCL", "PARMLIB", "DCLGEN", "REXX", "TEXT").alias("file_type"), nth(5, "uses vsam and CICS", "a DFSORT run", "DL/I with MQ", "parses XML").alias("analysis"))


@query("layer_scope", f"WITH {_SUMMARIES} SELECT kind AS file_type, count(*) AS files, CASE kind WHEN 'COBOL' THEN 'code' WHEN 'REXX' THEN 'code' WHEN 'JCL' THEN 'jcl' WHEN 'PARMLIB' THEN 'config' WHEN 'DCLGEN' THEN 'data' ELSE 'other' END AS layer FROM s GROUP BY kind")
def layer_scope(spark: SparkSession, d: str) -> DataFrame:
    return estate.scope(_summaries(spark, d))


@query(
    "system_landscape",
    f"""WITH {_SUMMARIES}, c AS (SELECT *, kind IN ('COBOL', 'REXX') AS code FROM s),
    n AS (SELECT count(*) FILTER (code AND contains(analysis, 'vsam')) AS vsam, count(*) FILTER (code AND contains(analysis, 'DL/I')) AS ims, count(*) FILTER (kind = 'JCL') AS jobs, count(*) FILTER (kind = 'REXX') AS scripts FROM c)
    SELECT 'Operating System' AS layer, 'IBM z/OS (Confirmed via Utility Control Cards)' AS components UNION ALL SELECT 'Programming Languages', 'COBOL, JCL, REXX'
    UNION ALL SELECT 'Data Persistence', 'IBM DB2 (Relational), VSAM (KSDS/ESDS, ' || vsam || ' modules)' FROM n
    UNION ALL SELECT 'Execution Environment', 'CICS Transaction Server (' || vsam || ' modules), IMS Transaction Manager (' || ims || ' modules), Batch Processing (JES, ' || jobs || ' jobs), TSO/E Interactive (' || scripts || ' scripts)' FROM n
    UNION ALL SELECT 'Integration & Middleware', 'IBM MQ, XML Parsing'""",
)
def system_landscape(spark: SparkSession, d: str) -> DataFrame:
    return estate.landscape(_summaries(spark, d))


@query("coverage_one_row", "SELECT count(*) AS expected, count(l.doc_id) AS covered, round(100.0 * count(l.doc_id) / count(*), 1) AS percent FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def coverage_one_row(spark: SparkSession, d: str) -> DataFrame:
    return estate.coverage(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")


@query(
    "session_state",
    """WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events WHERE event_type = 'click'),
    c AS (SELECT user_id, string_agg(event_id, ',' ORDER BY event_id) AS converted FROM r WHERE n <= 15 GROUP BY user_id)
    SELECT user_id AS session, converted, count(DISTINCT CASE WHEN event_type = 'view' THEN event_id END) AS files, count(*) FILTER (event_type = 'error') AS errors FROM events LEFT JOIN c USING (user_id) GROUP BY ALL""",
)
def session_state(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "converted").when(F.col("event_type") == "view", "file").otherwise(F.col("event_type"))
    log = table(spark, d, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), kind.alias("event"), F.col("event_id").cast("string").alias("detail"))
    return estate.session_state(log).withColumn("converted", F.array_join("converted", ","))


@query("session_snippets", "SELECT conv_id AS session, turn AS seq, left(text, 500) AS snippet FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE contains(upper(text), 'A')) WHERE n <= 3")
def session_snippets(spark: SparkSession, d: str) -> DataFrame:
    return estate.snippets(table(spark, d, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("seq"), "text"), "a")


@query("downstream_feeds", "SELECT DISTINCT p_name AS dataset, l_suppkey AS job FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'R' ORDER BY 1, 2 LIMIT 15")
def downstream_feeds(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return estate.feeds(joined.select(F.col("p_name").alias("dataset"), F.col("l_suppkey").alias("job"), F.col("l_returnflag").alias("usage")), "R")


@query("functional_groups", "SELECT CASE WHEN regexp_matches(upper(p_name || ' ' || p_type), 'PROMO|BOLT') THEN 'METAL' WHEN contains(upper(p_name || ' ' || p_type), 'SMALL') THEN 'ALLOY' ELSE 'OTHER' END AS category, count(*) AS programs FROM part GROUP BY 1")
def functional_groups(spark: SparkSession, d: str) -> DataFrame:
    return estate.functional_groups(table(spark, d, "part").select(F.col("p_name").alias("name"), F.col("p_type").alias("description")), {"METAL": ("PROMO", "BOLT"), "ALLOY": ("SMALL",)})


@query("project_progress", "SELECT o_custkey AS project_id, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS done, round(100.0 * count(*) FILTER (o_orderstatus = 'F') / count(*), 1) AS percent FROM orders GROUP BY o_custkey")
def project_progress(spark: SparkSession, d: str) -> DataFrame:
    return projects.progress(table(spark, d, "orders").select(F.col("o_custkey").alias("project_id"), (F.col("o_orderstatus") == "F").alias("done")))


@query("project_delete_cascade", "SELECT o_custkey AS project_id, count(*) AS files FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) GROUP BY o_custkey")
def project_delete_cascade(spark: SparkSession, d: str) -> DataFrame:
    everyone = table(spark, d, "customer").select(F.col("c_custkey").alias("project_id"), "c_acctbal")
    owned = table(spark, d, "orders").select(F.col("o_custkey").alias("project_id"), "o_orderkey")
    _, left = projects.deleted(everyone, owned, everyone.where("c_acctbal < 0"))
    return left.groupBy("project_id").agg(F.count("*").alias("files"))


@query("upload_batches", "SELECT o_custkey AS project_id, o_orderkey AS batch, count(*) AS files FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL HAVING max(l_quantity) <= 40")
def upload_batches(spark: SparkSession, d: str) -> DataFrame:
    """Orders are batches and their lines files: a quantity of over 40 stands for a file over its limit."""
    uploads = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    size = (F.col("l_quantity") / 40 * 2 * 1024 * 1024).cast("long")
    ok = projects.accepted(uploads.select(F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("batch"), F.lit("jcl").alias("file_type"), F.col("l_linenumber").cast("string").alias("filename"), size.alias("size")), ("jcl",))
    return ok.groupBy("project_id", "batch").agg(F.count("*").alias("files"))


@query("summary_passes", "SELECT doc_id AS filename, CASE WHEN len(string_split(text, chr(10))) < 200 THEN 'single' ELSE 'rolling' END AS passes FROM documents")
def summary_passes(spark: SparkSession, d: str) -> DataFrame:
    return source_chunks.summary_passes(table(spark, d, "documents").select(F.col("doc_id").alias("filename"), "text"), F.lit("assembly"))


@query("ebcdic_round_trip", "SELECT n_nationkey, n_name AS text FROM nation")
def ebcdic_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Names as EBCDIC bytes (page 037; plain letters, so the same in every page) and decoded again."""
    latin = "".join(map(chr, range(32, 127)))
    raw = F.encode(F.translate("n_name", latin, latin.encode("cp037").decode("latin-1")), "ISO-8859-1")
    return table(spark, d, "nation").select("n_nationkey", files.ebcdic(raw, "cp037").alias("text"))
