"""Queries of parsers over sources that Spark writes from the columns of the given tables.

Every order is a program and a job, every part an assembler module, every supplier a
script; which clauses a source has, and so the lines on which they stand, follows from its
rows.  The SQL counterparts derive the expected rows from the same columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrystone.functions import text as T
from quarrystone.operators import diagnostics, layouts, mainframe
from quarrystone.plans.catalogue import query, table


def _filled(template: str, **values: str) -> Column:
    """The template with columns in the place of their names in braces."""
    out: Column = F.lit(template)
    for name, column in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.col(column).cast("string"))
    return out


def _of_orders(spark: SparkSession, d: str, head: Column, block: Column, tail: Column) -> DataFrame:
    """(filename, text): a source of each order, with a block for each of its items, which are numbered anew: line numbers recur."""
    within = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    items = table(spark, d, "lineitem").withColumn("l_linenumber", F.row_number().over(within)).select("l_orderkey", "l_linenumber", block.alias("b"))
    body = items.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "b"))), lambda x: x["b"]), "").alias("body"))
    joined = table(spark, d, "orders").join(body, F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.select(F.concat(F.lit("O"), "o_orderkey").alias("filename"), F.concat(head, "body", tail).alias("text"))


# ---- Programs --------------------------------------------------------------


def programs(spark: SparkSession, d: str) -> DataFrame:
    values = {"n": "l_linenumber", "part": "l_partkey", "supp": "l_suppkey"}
    block = (
        F.when(F.col("l_returnflag") == "A", F.concat(_filled("      * CALL 'NOTE{n}'.\n           CALL 'S{supp}' USING WS-B WS-A.\n", **values), F.when(F.col("l_quantity") > 25, F.lit("\n")).otherwise(F.lit(""))))
        .when(F.col("l_returnflag") == "R", _filled("           CALL 'LONG\n      -    'NAME{part}'.\n", **values))
        .when(F.col("l_quantity") > 25, _filled("           EXEC SQL SELECT A\n             FROM T{part} END-EXEC.\n", **values))
        .otherwise(_filled("           MOVE 'D{supp}' TO WS-V{n}.\n           CALL WS-V{n}.\n", **values))
    )
    head = F.concat(_filled("       IDENTIFICATION DIVISION.\n       PROGRAM-ID. PG{key}.\n", key="o_orderkey"), F.when(F.col("o_orderstatus") == "F", F.lit("      / page\n       01 WS-V1 PIC X(8) VALUE 'ALT'.\n")).otherwise(F.lit("")), F.lit("       PROCEDURE DIVISION.\n"))
    tail = F.when(F.col("o_orderstatus") == "P", _filled("           FROBNICATE {key} TIMES.\n           CALL WS-NONE.\n", key="o_orderkey")).otherwise(F.lit("       END PROGRAM.\n"))
    return _of_orders(spark, d, head, block, tail)


_ITEMS = "WITH i AS (SELECT * REPLACE (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS l_linenumber) FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"
_BLOCKS = _ITEMS + """,
b AS (
  SELECT o_orderkey, o_orderstatus AS st, l_linenumber AS n, l_returnflag AS f, l_quantity AS q, l_partkey AS part, l_suppkey AS supp,
         (CASE WHEN l_returnflag = 'A' AND l_quantity > 25 THEN 3 ELSE 2 END) AS size, (CASE WHEN o_orderstatus = 'F' THEN 5 ELSE 3 END) AS head
  FROM i),
p AS (SELECT *, head + 1 + coalesce(sum(size) OVER (PARTITION BY o_orderkey ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS line FROM b),
t AS (SELECT o_orderkey, any_value(st) AS st, (any_value(head) + sum(size))::BIGINT AS last FROM b GROUP BY o_orderkey)
"""


@query(
    "generated_cobol_calls",
    _BLOCKS + """
    SELECT 'PG' || o_orderkey AS program, CASE WHEN f = 'A' THEN 'S' || supp ELSE 'LONGNAME' || part END AS target, 'static' AS call_type, NULL::VARCHAR AS variable, line + (f = 'A')::INT AS line FROM p WHERE f IN ('A', 'R')
    UNION ALL SELECT 'PG' || o_orderkey, 'D' || supp, 'dynamic', 'WS-V' || n, line + 1 FROM p WHERE f NOT IN ('A', 'R') AND q <= 25
    UNION ALL SELECT 'PG' || o_orderkey, 'ALT', 'dynamic', 'WS-V1', line + 1 FROM p WHERE f NOT IN ('A', 'R') AND q <= 25 AND st = 'F' AND n = 1
    """,
)
def generated_cobol_calls(spark: SparkSession, d: str) -> DataFrame:
    return mainframe.cobol(programs(spark, d))["program_calls"].select("program", "target", "call_type", "variable", F.col("line").cast("long").alias("line"))


@query("generated_cobol_unresolved", _BLOCKS + "SELECT 'PG' || o_orderkey AS program, 'WS-NONE' AS variable, last + 2 AS line FROM t WHERE st = 'P'")
def generated_cobol_unresolved(spark: SparkSession, d: str) -> DataFrame:
    return mainframe.cobol(programs(spark, d))["unresolved_calls"].select("program", "variable", F.col("line").cast("long").alias("line"))


@query("generated_cobol_sql", _BLOCKS + "SELECT 'PG' || o_orderkey AS program, 'SELECT' AS type, 'SELECT A FROM T' || part AS statement, line FROM p WHERE f NOT IN ('A', 'R') AND q > 25")
def generated_cobol_sql(spark: SparkSession, d: str) -> DataFrame:
    return mainframe.cobol(programs(spark, d))["sql_blocks"].select("program", "type", "statement", F.col("line").cast("long").alias("line"))


@query("generated_cobol_tables", _BLOCKS + "SELECT 'PG' || o_orderkey AS program, 'T' || part AS \"table\", 'READ' AS operation, min(line) AS line FROM p WHERE f NOT IN ('A', 'R') AND q > 25 GROUP BY o_orderkey, part")
def generated_cobol_tables(spark: SparkSession, d: str) -> DataFrame:
    return mainframe.cobol(programs(spark, d))["sql_tables"].select("program", "table", "operation", F.col("line").cast("long").alias("line"))


# ---- Jobs ------------------------------------------------------------------


def jobs(spark: SparkSession, d: str) -> DataFrame:
    values = {"n": "l_linenumber", "part": "l_partkey", "supp": "l_suppkey"}
    step = F.when(F.col("l_returnflag") == "A", _filled("//S{n} EXEC PGM=P{supp},REGION=0M\n", **values)).otherwise(_filled("//S{n} EXEC PROC{supp}\n", **values))
    new = F.when(F.col("l_returnflag") == "R", F.lit(",\n//             DISP=(NEW,CATLG)\n")).otherwise(F.lit("\n"))
    block = F.concat(step, _filled("//INC{n} INCLUDE MEMBER=M{part}\n//I{n} IF RC = 0 THEN\n//* note\n//D{n} DD DSN=A.B{part}", **values), new, F.when(F.col("l_quantity") > 25, F.lit("//X XQZT THIS\nplain data\n")).otherwise(F.lit("")))
    head = F.concat(_filled("//J{key} JOB 1,\n//             'NAME'\n", key="o_orderkey"), F.when(F.col("o_orderstatus") == "F", F.lit("//EARLY DD DSN=LOST.ONE\n")).otherwise(F.lit("")))
    return _of_orders(spark, d, head, block, F.lit("//\n"))


@query("generated_jcl_datasets", _ITEMS + " SELECT 'J' || l_orderkey AS job, 'S' || l_linenumber AS step, 'D' || l_linenumber AS ddname, 'A.B' || l_partkey AS dataset, CASE WHEN l_returnflag = 'R' THEN 'NEW' ELSE 'SHR' END AS disp FROM i")
def generated_jcl_datasets(spark: SparkSession, d: str) -> DataFrame:
    """Statements that are neither steps nor data definitions, of which every step has two or three, are none of the rows."""
    return mainframe.jcl(jobs(spark, d))["dds"]


@query("generated_jcl_includes", _ITEMS + " SELECT 'J' || l_orderkey AS job, 'S' || l_linenumber AS step, 'M' || l_partkey AS member FROM i")
def generated_jcl_includes(spark: SparkSession, d: str) -> DataFrame:
    return mainframe.jcl(jobs(spark, d))["include_groups"].select("job", "step", "member")


@query("generated_jcl_calls", _ITEMS + " SELECT 'J' || l_orderkey AS job, 'S' || l_linenumber AS step, CASE WHEN l_returnflag = 'A' THEN 'P' || l_suppkey END AS program, CASE WHEN l_returnflag <> 'A' THEN 'PROC' || l_suppkey END AS proc FROM i")
def generated_jcl_calls(spark: SparkSession, d: str) -> DataFrame:
    return mainframe.jcl(jobs(spark, d))["calls"]


# ---- Assembler modules -----------------------------------------------------


def _card(text: Column, mark: str = "X") -> Column:
    """A line with a mark in column 72."""
    return F.concat(F.rpad(text, 71, " "), F.lit(mark + "\n"))


def modules(spark: SparkSession, d: str) -> DataFrame:
    values = {"k": "p_partkey", "size": "p_size"}
    own = lambda t: _filled(t, **values)
    ghost = F.when(F.col("p_size") % 2 == 0, F.concat(_card(F.lit("* a comment that goes on")), F.lit("         EXTRN GHOST\n"))).otherwise(F.lit("* a comment\n"))
    lists = F.concat(_card(own("         EXTRN A{k},B{k},")), _card(own("               C{k},"), "*"), own("               D{k}\n"))
    db2 = F.when(F.col("p_size") > 25, F.lit("         call  'DSNHLI'\n")).otherwise(F.lit(""))
    text = F.concat(ghost, own("M{k} CSECT\n"), lists, own("         copy  MAC{size}\n         OPEN  (FILE{size},INPUT)\n         CHECK ECB{size}\n         POINT\n"), db2, own("         L     15,=V(SUB{size})\n"))
    return table(spark, d, "part").select(F.concat(F.lit("A"), "p_partkey").alias("filename"), text.alias("text"))


_MODULES = "WITH m AS (SELECT p_partkey AS k, p_size AS size, (CASE WHEN p_size % 2 = 0 THEN 4 ELSE 3 END)::BIGINT AS first FROM part) "


@query("generated_assembler_externals", _MODULES + "SELECT 'A' || k AS filename, x || k AS name, 'EXTRN' AS kind, first AS line FROM m, (VALUES ('A'), ('B'), ('C'), ('D')) v(x)")
def generated_assembler_externals(spark: SparkSession, d: str) -> DataFrame:
    return mainframe.assembler(modules(spark, d))["externals"].select("filename", "name", "kind", F.col("line").cast("long").alias("line"))


@query("generated_assembler_files", _MODULES + "SELECT 'A' || k AS filename, 'FILE' || size AS file, 'OPEN' AS operation, first + 4 AS line FROM m UNION ALL SELECT 'A' || k, 'ECB' || size, 'CHECK', first + 5 FROM m UNION ALL SELECT 'A' || k, 'UNKNOWN', 'POINT', first + 6 FROM m")
def generated_assembler_files(spark: SparkSession, d: str) -> DataFrame:
    return mainframe.assembler(modules(spark, d))["file_io"].select("filename", "file", "operation", F.col("line").cast("long").alias("line"))


@query("generated_assembler_calls", _MODULES + "SELECT 'A' || k AS filename, 'SUB' || size AS target, first + 7 + (size > 25)::INT AS line FROM m")
def generated_assembler_calls(spark: SparkSession, d: str) -> DataFrame:
    return mainframe.assembler(modules(spark, d))["program_calls"].select("filename", "target", F.col("line").cast("long").alias("line"))


@query("generated_assembler_db2", _MODULES + "SELECT 'A' || k AS filename, 'CALL DSNHLI' AS type, first + 7 AS line FROM m WHERE size > 25")
def generated_assembler_db2(spark: SparkSession, d: str) -> DataFrame:
    return mainframe.assembler(modules(spark, d))["db2_access"].select("filename", "type", F.col("line").cast("long").alias("line"))


# ---- Scripts ---------------------------------------------------------------


def scripts(spark: SparkSession, d: str) -> DataFrame:
    own = lambda t: _filled(t, k="s_suppkey", nation="s_nationkey")
    rest = F.when(F.col("s_acctbal") > 0, own("say sysuid\n\"LISTDS 'Q.R{nation}'\"\n")).otherwise(F.lit(""))
    text = F.concat(own("/* CALL 'NONE' */\nADDRESS LINK 'L{k}'\nADDRESS LINKMVS \"M{k}\"\ncall SUB{nation}\n\"ALLOC DA('A.B{k}(MEM)') SHR\"\nx = VALUE('V{nation}')\n"), rest)
    return table(spark, d, "supplier").select(F.concat(F.lit("R"), "s_suppkey").alias("filename"), text.alias("text"))


@query("generated_rexx_calls", "SELECT 'R' || s_suppkey AS filename, unnest(['L' || s_suppkey, 'M' || s_suppkey, 'SUB' || s_nationkey]) AS program FROM supplier")
def generated_rexx_calls(spark: SparkSession, d: str) -> DataFrame:
    return mainframe.rexx(scripts(spark, d))["calls"]


@query("generated_rexx_datasets", "SELECT 'R' || s_suppkey AS filename, 'A.B' || s_suppkey || '.MEM' AS dataset FROM supplier UNION ALL SELECT 'R' || s_suppkey, 'Q.R' || s_nationkey FROM supplier WHERE s_acctbal > 0")
def generated_rexx_datasets(spark: SparkSession, d: str) -> DataFrame:
    return mainframe.rexx(scripts(spark, d))["datasets"]


@query("generated_rexx_variables", "SELECT 'R' || s_suppkey AS filename, 'V' || s_nationkey AS variable FROM supplier UNION ALL SELECT 'R' || s_suppkey, 'SYSUID' FROM supplier WHERE s_acctbal > 0")
def generated_rexx_variables(spark: SparkSession, d: str) -> DataFrame:
    return mainframe.rexx(scripts(spark, d))["environment"]


# ---- Diagnostics of a run --------------------------------------------------


def _run(spark: SparkSession, d: str) -> DataFrame:
    """Programs, jobs and modules, and files that can't be parsed: empty ones, programs without a name, a type without a parser."""
    typed = lambda df, kind: df.select("filename", F.lit(kind).alias("file_type"), "text")
    bad = table(spark, d, "customer").where("c_custkey % 3 < 2").select(F.concat(F.lit("C"), "c_custkey").alias("filename"), F.when(F.col("c_custkey") % 3 == 0, "cobol").otherwise("fortran").alias("file_type"), F.when(F.col("c_custkey") % 2 == 0, F.lit(" \n")).otherwise(F.lit("       MOVE A TO B.")).alias("text"))
    return typed(programs(spark, d), "cobol").unionByName(typed(jobs(spark, d), "jcl")).unionByName(typed(modules(spark, d), "assembly")).unionByName(bad)


_ERRORS = _BLOCKS + """,
j AS (SELECT o_orderkey, n, q, (CASE WHEN f = 'R' THEN 6 ELSE 5 END) + 2 * (q > 25)::INT AS size, (CASE WHEN st = 'F' THEN 3 ELSE 2 END) AS head FROM b),
jl AS (SELECT *, head + coalesce(sum(size) OVER (PARTITION BY o_orderkey ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)::BIGINT - 1 AS line FROM j),
bad AS (SELECT 'C' || c_custkey AS filename, CASE WHEN c_custkey % 3 = 0 THEN 'cobol' ELSE 'fortran' END AS file_type, CASE WHEN c_custkey % 3 = 1 THEN 'no parser for fortran' WHEN c_custkey % 2 = 0 THEN 'empty file' ELSE 'no PROGRAM-ID' END AS message FROM customer WHERE c_custkey % 3 < 2),
e AS (
  SELECT 'O' || o_orderkey AS filename, 'cobol' AS file_type, 'unrecognized' AS error_type, 'No statement recognised' AS message, last + 1 AS line, 'FROBNICATE ' || o_orderkey || ' TIMES.' AS content FROM t WHERE st = 'P'
  UNION ALL SELECT 'O' || o_orderkey, 'jcl', 'unrecognized', 'Unknown operation', line, '//X XQZT THIS' FROM jl WHERE q > 25
  UNION ALL SELECT 'O' || o_orderkey, 'jcl', 'warning', 'DD statement before any EXEC: EARLY', 3, NULL FROM t WHERE st = 'F'
  UNION ALL SELECT filename, file_type, 'fatal', message, NULL, NULL FROM bad),
files AS (SELECT 'O' || o_orderkey AS filename, 'cobol' AS file_type FROM t UNION ALL SELECT 'O' || o_orderkey, 'jcl' FROM t UNION ALL SELECT 'A' || p_partkey, 'assembly' FROM part UNION ALL SELECT filename, file_type FROM bad)
"""


@query("parse_errors", _ERRORS + "SELECT filename, file_type, error_type, message, line::BIGINT AS line, content FROM e")
def parse_errors(spark: SparkSession, d: str) -> DataFrame:
    return diagnostics.parse_errors(_run(spark, d)).withColumn("line", F.col("line").cast("long"))


@query("parse_results", _ERRORS + "SELECT filename, file_type, message IS NULL AS success, message AS error FROM files LEFT JOIN (SELECT * FROM e WHERE error_type = 'fatal') x USING (filename, file_type)")
def parse_results(spark: SparkSession, d: str) -> DataFrame:
    files = _run(spark, d)
    return diagnostics.parse_results(files, diagnostics.parse_errors(files))


@query(
    "parse_summary",
    _ERRORS + """
    SELECT file_type, count(DISTINCT filename) AS total_files, count(DISTINCT filename) - count(DISTINCT CASE WHEN error_type = 'fatal' THEN filename END) AS successful,
           count(DISTINCT CASE WHEN error_type = 'fatal' THEN filename END) AS failed, count(DISTINCT CASE WHEN error_type IS NOT NULL THEN filename END) AS files_with_errors,
           count(*) FILTER (error_type = 'fatal') AS fatal, count(*) FILTER (error_type = 'warning') AS warning, count(*) FILTER (error_type = 'unrecognized') AS unrecognized
    FROM files LEFT JOIN e USING (filename, file_type) GROUP BY file_type
    """,
)
def parse_summary(spark: SparkSession, d: str) -> DataFrame:
    files = _run(spark, d)
    return diagnostics.summary_of(files, diagnostics.parse_errors(files))


# ---- Trees and ordered sets ------------------------------------------------


@query(
    "record_trees",
    """
    WITH RECURSIVE f AS (SELECT p_brand AS brand, p_partkey AS k, p_size AS l, nullif(p_type, 'SMALL') AS t FROM part WHERE p_size < 50),
    p AS (SELECT c.brand, c.k, c.l, c.t, max(o.k) AS parent FROM f c LEFT JOIN f o ON o.brand = c.brand AND o.k < c.k AND o.l < c.l GROUP BY ALL),
    d AS (SELECT brand, k, 0 AS depth FROM p WHERE parent IS NULL UNION ALL SELECT p.brand, p.k, d.depth + 1 FROM p JOIN d ON d.brand = p.brand AND d.k = p.parent),
    n AS (SELECT p.*, d.depth, lead(d.depth) OVER (PARTITION BY p.brand ORDER BY p.k) AS following FROM p JOIN d USING (brand, k)),
    s AS (SELECT brand, k, '{"position":' || k || ',"level":' || l || CASE WHEN t IS NULL THEN '' ELSE ',"type":"' || t || '"' END
      || CASE WHEN following > depth THEN ',"children":[' ELSE '}' || repeat(']}', (depth - coalesce(following, 0))::BIGINT) || CASE WHEN following IS NULL THEN '' ELSE ',' END END AS piece FROM n)
    SELECT brand, '[' || string_agg(piece, '' ORDER BY k) || ']' AS tree FROM s GROUP BY brand
    """,
)
def record_trees(spark: SparkSession, d: str) -> DataFrame:
    fields = table(spark, d, "part").where("p_size < 50").select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("position"), F.col("p_size").alias("level"), F.nullif("p_type", F.lit("SMALL")).alias("type"))
    return layouts.nested_json(fields, ["position", "level", "type"], key="brand")


@query(
    "operations_first_seen",
    """
    WITH o AS (SELECT l_suppkey, l_returnflag, l_linestatus || l_linenumber AS op, min(l_orderkey * 10 + l_linenumber) AS first FROM lineitem GROUP BY ALL)
    SELECT l_suppkey, l_returnflag, string_agg(op, ' ' ORDER BY first) AS operations FROM o GROUP BY ALL
    """,
)
def operations_first_seen(spark: SparkSession, d: str) -> DataFrame:
    """What each supplier does under each flag, in the order of first sight."""
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_returnflag", F.concat("l_linestatus", "l_linenumber").alias("op"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"))
    return T.first_seen(rows, ["l_suppkey", "l_returnflag"], "op", "at", "operations").withColumn("operations", F.when(F.size("operations") > 0, F.array_join("operations", " ")))

