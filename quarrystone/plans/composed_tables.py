"""Queries over statements, copybooks, register calls, chunks and encoded files that Spark composes from the given tables.

Which lines a text has follows from its rows, and the SQL counterparts derive the expected rows from the same columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.operators import source_chunks, statements
from quarrystone.plans.catalogue import query, table
from quarrystone.plans.generated_tables import _ITEMS, _filled, _of_orders
from quarrystone.plans.written_tables import schedules
from quarrystone.sources import files

_VALUES = {"n": "l_linenumber", "part": "l_partkey", "supp": "l_suppkey"}


# ---- Further statements of programs ----------------------------------------


def programs(spark: SparkSession, d: str) -> DataFrame:
    block = (
        F.when(F.col("l_returnflag") == "A", _filled("           exec CICS link\n             PROGRAM('P{part}') END-EXEC.\n", **_VALUES))
        .when(F.col("l_returnflag") == "R", _filled("           XML PARSE DOC{supp}\n             PROCESSING PROCEDURE h{part} END-XML.\n", **_VALUES))
        .when(F.col("l_quantity") > 25, _filled("           INVOKE OBJ{n} \"m{part}\".\n           JSON GENERATE J{n} FROM R{supp}.\n", **_VALUES))
        .otherwise(_filled("           EVALUATE V{n}\n             WHEN 1 ADD 1 TO A\n      *      WHEN 9\n             WHEN 2 ADD 2 TO A\n           END-EVALUATE.\n", **_VALUES))
    )
    head = F.concat(_filled("       IDENTIFICATION DIVISION.\n       PROGRAM-ID. PG{key}.\n       PROCEDURE DIVISION.\n", key="o_orderkey"), F.when(F.col("o_orderstatus") == "F", _filled("       DECLARATIVES.\n           USE AFTER ERROR PROCEDURE ON F{key}.\n       END DECLARATIVES.\n", key="o_orderkey")).otherwise(F.lit("")))
    tail = F.when(F.col("o_orderstatus") == "P", _filled("       IDENTIFICATION DIVISION.\n       PROGRAM-ID. IN{key}.\n", key="o_orderkey")).otherwise(F.lit(""))
    return _of_orders(spark, d, head, block, tail)


_STATEMENTS = _ITEMS + """,
b AS (SELECT l_orderkey AS o, o_orderstatus AS st, l_linenumber AS n, l_partkey AS part, l_suppkey AS supp, CASE WHEN l_returnflag IN ('A', 'R') THEN l_returnflag WHEN l_quantity > 25 THEN 'J' ELSE 'E' END AS kind FROM i),
c AS (SELECT *, CASE WHEN kind = 'E' THEN 5 ELSE 2 END AS size, CASE WHEN st = 'F' THEN 6 ELSE 3 END AS head FROM b),
p AS (SELECT *, 'O' || o AS filename, head + 1 + coalesce(sum(size) OVER (PARTITION BY o ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS line FROM c)
"""


def _stated(spark: SparkSession, d: str, kind: str) -> DataFrame:
    out = statements.cobol_statements(programs(spark, d))[kind].drop("seq")
    return out.withColumn("line", F.col("line").cast("long")) if "line" in out.columns else out


@query("composed_cics", _STATEMENTS + "SELECT filename, 'LINK' AS command, 'EXEC CICS link PROGRAM(''P' || part || ''') END-EXEC' AS statement, line FROM p WHERE kind = 'A'")
def composed_cics(spark: SparkSession, d: str) -> DataFrame:
    return _stated(spark, d, "cics")


@query("composed_xml", _STATEMENTS + "SELECT filename, 'DOC' || supp AS document, 'H' || part AS procedure, line FROM p WHERE kind = 'R'")
def composed_xml(spark: SparkSession, d: str) -> DataFrame:
    return _stated(spark, d, "xml_parse")


@query("composed_json", _STATEMENTS + "SELECT filename, 'GENERATE' AS type, 'R' || supp AS source, 'J' || n AS target, line + 1 AS line FROM p WHERE kind = 'J'")
def composed_json(spark: SparkSession, d: str) -> DataFrame:
    return _stated(spark, d, "json")


@query("composed_invoke", _STATEMENTS + "SELECT filename, 'OBJ' || n AS object, 'm' || part AS method, line FROM p WHERE kind = 'J'")
def composed_invoke(spark: SparkSession, d: str) -> DataFrame:
    return _stated(spark, d, "invoke")


@query("composed_evaluate", _STATEMENTS + "SELECT filename, 'V' || n AS subject, 1::BIGINT AS when_count, line FROM p WHERE kind = 'E'")
def composed_evaluate(spark: SparkSession, d: str) -> DataFrame:
    """The last branch, after which no other comes, isn't counted, nor one in a comment."""
    return _stated(spark, d, "evaluate").withColumn("when_count", F.col("when_count").cast("long"))


@query("composed_nested", _STATEMENTS + "SELECT filename, 'IN' || o AS program, max(line + size) AS line FROM p WHERE st = 'P' GROUP BY ALL")
def composed_nested(spark: SparkSession, d: str) -> DataFrame:
    return _stated(spark, d, "nested_programs")


@query("composed_declaratives", "SELECT 'O' || o_orderkey AS filename, 'F' || o_orderkey AS on_file FROM orders WHERE o_orderstatus = 'F' AND o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def composed_declaratives(spark: SparkSession, d: str) -> DataFrame:
    return _stated(spark, d, "declaratives")


# ---- Copybooks and register calls ------------------------------------------


def copybooks(spark: SparkSession, d: str) -> DataFrame:
    own = lambda t: _filled(t, k="p_partkey", size="p_size")
    tail = F.when(F.col("p_size") > 25, own("           05 OPEN{k} PIC X\n")).otherwise(F.lit(""))
    text = F.concat(own("       01 REC{k}.\n      * COPY GHOST.\n           COPY C{size} OF LIB{size}\n              REPLACING ==A== BY ==B{k}==.\n           COPY D{k}.\n           05 F PIC X(20) VALUE 'COPY NO. Yes'.\n"), tail)
    return table(spark, d, "part").select(F.concat(F.lit("K"), "p_partkey").alias("filename"), text.alias("text"))


@query(
    "composed_copybooks",
    "SELECT 'K' || p_partkey AS filename, 3::BIGINT AS line_no, 'C' || p_size AS copybook, 'LIB' || p_size AS library, '==A== BY ==B' || p_partkey || '==' AS replacing FROM part UNION ALL SELECT 'K' || p_partkey, 5, 'D' || p_partkey, NULL, NULL FROM part",
)
def composed_copybooks(spark: SparkSession, d: str) -> DataFrame:
    return statements.copybooks(copybooks(spark, d))["references"].withColumn("line_no", F.col("line_no").cast("long"))


@query("composed_copybook_warnings", "SELECT 'K' || p_partkey AS filename, 7::BIGINT AS line_no, 'Unterminated statement at line 7' AS warning FROM part WHERE p_size > 25")
def composed_copybook_warnings(spark: SparkSession, d: str) -> DataFrame:
    return statements.copybooks(copybooks(spark, d))["warnings"].withColumn("line_no", F.col("line_no").cast("long"))


def branches(spark: SparkSession, d: str) -> DataFrame:
    own = lambda t: _filled(t, k="p_partkey", size="p_size")
    cut = F.when(F.col("p_size") > 25, own("D{k} DSECT\n")).otherwise(F.lit("* BALR 14,9\n"))
    text = F.concat(own("M{k} CSECT\n         L     15,=V(SUB{size})\n         BALR  14,15\n         L     10,ADDR{k}\n"), cut, own("         BASR  14,10\n         BALR  14,11\n         L     10,=V(OVER{size})\n         BASR  14,10\n"))
    return table(spark, d, "part").select(F.concat(F.lit("B"), "p_partkey").alias("filename"), text.alias("text"))


@query(
    "composed_register_calls",
    """
    WITH m AS (SELECT 'B' || p_partkey AS filename, p_partkey AS k, p_size AS size FROM part)
    SELECT filename, 'SUB' || size AS target, '15' AS via_register, 'V-constant' AS load_type, 2::BIGINT AS load_line, 3::BIGINT AS call_line FROM m
    UNION ALL SELECT filename, 'ADDR' || k, '10', 'direct-symbol', 4, 6 FROM m WHERE size <= 25 UNION ALL SELECT filename, 'OVER' || size, '10', 'V-constant', 8, 9 FROM m
    """,
)
def composed_register_calls(spark: SparkSession, d: str) -> DataFrame:
    """A section begins anew: what registers held before it is unknown in it."""
    out = statements.register_calls(branches(spark, d))
    return out.withColumn("load_line", F.col("load_line").cast("long")).withColumn("call_line", F.col("call_line").cast("long"))


# ---- Chunks ----------------------------------------------------------------


def _numbered(chunks: DataFrame) -> DataFrame:
    return chunks.select("filename", F.col("chunk").cast("long").alias("chunk"), "kind", "name", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), "text")


def _chunk_sql(lines: str) -> str:
    """Chunks of a table l (filename, pos, text, kind, name) of cleaned lines in order."""
    return (
        lines + """,
    z AS (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY pos) AS no, count(kind) OVER (PARTITION BY filename ORDER BY pos) AS chunk FROM l)
    SELECT filename, chunk, max(kind) AS kind, max(name) AS name, min(no) AS start_line, max(no) AS end_line, string_agg(text, chr(10) ORDER BY pos) AS text FROM z GROUP BY filename, chunk
    """
    )


def paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """A program of each order with sequence numbers, whose items are paragraphs, comments and statements."""
    block = (
        F.when(F.col("l_returnflag") == "A", _filled("000100 PARA-{n}.\n000200     DISPLAY {part}.\n", **_VALUES))
        .when(F.col("l_returnflag") == "R", _filled("000300* note {supp}\n000400     GOBACK.\n", **_VALUES))
        .otherwise(_filled("000500     ADD {n} TO X.\n", **_VALUES))
    )
    return _of_orders(spark, d, F.lit("000001 IDENTIFICATION DIVISION.\n000002 PROGRAM-ID. X.\n000003 PROCEDURE DIVISION.\n"), block, F.lit("000009     STOP RUN."))


_PARAGRAPHS = _chunk_sql(_ITEMS + """,
    l AS (
      SELECT 'O' || l_orderkey AS filename, l_linenumber * 10::BIGINT AS pos, CASE WHEN l_returnflag = 'A' THEN ' PARA-' || l_linenumber || '.' WHEN l_returnflag = 'R' THEN '     GOBACK.' ELSE '     ADD ' || l_linenumber || ' TO X.' END AS text,
             CASE WHEN l_returnflag = 'A' THEN 'paragraph' END AS kind, CASE WHEN l_returnflag = 'A' THEN 'PARA-' || l_linenumber END AS name FROM i
      UNION ALL SELECT 'O' || l_orderkey, l_linenumber * 10 + 1, '     DISPLAY ' || l_partkey || '.', NULL, NULL FROM i WHERE l_returnflag = 'A'
      UNION ALL SELECT DISTINCT 'O' || l_orderkey, h.pos, h.text, h.kind, h.name FROM lineitem, (VALUES (1, ' IDENTIFICATION DIVISION.', 'division', 'IDENTIFICATION'), (2, ' PROGRAM-ID. X.', NULL, NULL), (3, ' PROCEDURE DIVISION.', 'division_header', 'PROCEDURE'), (1000000, '     STOP RUN.', NULL, NULL)) h(pos, text, kind, name))
    """)


@query("composed_cobol_chunks", _PARAGRAPHS)
def composed_cobol_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _numbered(source_chunks.cobol(paragraphs(spark, d)))


_JOB_LINES = """
    WITH b AS (
      SELECT 'N' || c_nationkey AS filename, c_custkey * 100 AS pos, unnest([
        struct_pack(s := 0, t := 'JOB: JB' || c_custkey || '  ENTRY', k := 'job_definition', m := 'JB' || c_custkey), struct_pack(s := 1, t := '  SYSTEM: S' || c_mktsegment || ' SCHID: ' || c_nationkey, k := NULL, m := NULL),
        struct_pack(s := 2, t := CASE WHEN c_custkey > 1 THEN '   DEP-JOB: JB' || (c_custkey - 1) END, k := NULL, m := NULL), struct_pack(s := 3, t := CASE WHEN c_custkey > 1 THEN '   DEP-JOB: JB' || (c_custkey - 1) END, k := NULL, m := NULL),
        struct_pack(s := 4, t := '  DSN: D.S' || c_nationkey, k := NULL, m := NULL), struct_pack(s := 5, t := CASE WHEN c_acctbal > 0 THEN '  USR-REQ: OPER' END, k := NULL, m := NULL),
        struct_pack(s := 6, t := CASE WHEN c_acctbal <= 0 THEN 'JOB: WILD*' END, k := CASE WHEN c_acctbal <= 0 THEN 'job_definition' END, m := CASE WHEN c_acctbal <= 0 THEN 'WILD*' END),
        struct_pack(s := 7, t := CASE WHEN c_acctbal <= 0 THEN '   DEP-JOB: NEVER' END, k := NULL, m := NULL)]) AS x FROM customer),
    l AS (SELECT filename, pos + x.s AS pos, x.t AS text, x.k AS kind, x.m AS name FROM b WHERE x.t IS NOT NULL UNION ALL SELECT DISTINCT filename, 1000000000000, '', NULL, NULL FROM b)
    """


@query("composed_schedule_chunks", f"SELECT * FROM ({_chunk_sql(_JOB_LINES)}) WHERE name <> 'WILD*'")
def composed_schedule_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _numbered(source_chunks.schedule(schedules(spark, d)))


def parameter_sections(spark: SparkSession, d: str) -> DataFrame:
    block = F.when(F.col("l_returnflag") == "A", _filled("* System {part} of a name that is long enough to be cut somewhere\nA{n}=1\n", **_VALUES)).when(F.col("l_returnflag") == "R", _filled("***\n*\nB{n}={supp}  \n", **_VALUES)).otherwise(_filled("C{n}=2\n", **_VALUES))
    return _of_orders(spark, d, F.lit("* CATALOG\n"), block, F.lit("END=1"))


_PARAMETERS = _chunk_sql(_ITEMS + """,
    j AS (SELECT *, '* System ' || l_partkey || ' of a name that is long enough to be cut somewhere' AS head FROM i),
    b AS (
      SELECT 'O' || l_orderkey AS filename, l_linenumber * 10::BIGINT AS pos, unnest(CASE WHEN l_returnflag = 'A' THEN [struct_pack(s := 0, t := head, k := 'parameter_group', m := CASE WHEN length(head) - 2 > 50 THEN head[3:49] || '...' ELSE head[3:] END), struct_pack(s := 1, t := 'A' || l_linenumber || '=1', k := NULL, m := NULL)]
        WHEN l_returnflag = 'R' THEN [struct_pack(s := 0, t := '***', k := 'parameter_group', m := 'Parameter Group'), struct_pack(s := 1, t := '*', k := NULL, m := NULL), struct_pack(s := 2, t := 'B' || l_linenumber || '=' || l_suppkey, k := NULL, m := NULL)]
        ELSE [struct_pack(s := 0, t := 'C' || l_linenumber || '=2', k := NULL, m := NULL)] END) AS x FROM j),
    l AS (SELECT filename, pos + x.s AS pos, x.t AS text, x.k AS kind, x.m AS name FROM b UNION ALL SELECT DISTINCT filename, 1, '* CATALOG', 'parameter_group', 'CATALOG' FROM b UNION ALL SELECT DISTINCT filename, 1000000, 'END=1', NULL, NULL FROM b)
    """)


@query("composed_parameter_chunks", _PARAMETERS)
def composed_parameter_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _numbered(source_chunks.parameters(parameter_sections(spark, d)))


def procedures(spark: SparkSession, d: str) -> DataFrame:
    block = (
        F.when(F.col("l_returnflag") == "A", _filled("P{n}: PROC(X);\n  /* Q{n}: PROC; */\n  A = {part};\n", **_VALUES))
        .when(F.col("l_returnflag") == "R", _filled("l{n}: B = {supp};\n\n\n", **_VALUES))
        .otherwise(_filled("  C = {n};\n", **_VALUES))
    )
    return _of_orders(spark, d, F.lit("\n%INCLUDE X;\n"), block, F.lit("END;\n"))


_PROCEDURES = _chunk_sql(_ITEMS + """,
    b AS (
      SELECT 'O' || l_orderkey AS filename, l_linenumber * 10::BIGINT AS pos, unnest(CASE WHEN l_returnflag = 'A' THEN [struct_pack(s := 0, t := 'P' || l_linenumber || ': PROC(X);', k := 'procedure', m := 'P' || l_linenumber), struct_pack(s := 1, t := '  A = ' || l_partkey || ';', k := NULL, m := NULL)]
        WHEN l_returnflag = 'R' THEN [struct_pack(s := 0, t := 'l' || l_linenumber || ': B = ' || l_suppkey || ';', k := 'label', m := 'L' || l_linenumber)] ELSE [struct_pack(s := 0, t := '  C = ' || l_linenumber || ';', k := NULL, m := NULL)] END) AS x FROM i),
    l AS (SELECT filename, pos + x.s AS pos, x.t AS text, x.k AS kind, x.m AS name FROM b UNION ALL SELECT DISTINCT filename, 1, '%INCLUDE X;', NULL, NULL FROM b UNION ALL SELECT DISTINCT filename, 1000000, 'END;', NULL, NULL FROM b)
    """)


@query("composed_pli_chunks", f"SELECT * REPLACE (coalesce(kind, 'header') AS kind, coalesce(name, 'HEADER') AS name) FROM ({_PROCEDURES})")
def composed_pli_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _numbered(source_chunks.pli(procedures(spark, d)))


@query(
    "composed_whole_chunks",
    """
    SELECT 'c' || p_partkey || x.e AS filename, 0::BIGINT AS chunk, x.k AS kind, 'c' || p_partkey || x.e AS name, 1::BIGINT AS start_line, x.n::BIGINT AS end_line, replace(x.t, '#', p_partkey::VARCHAR) AS text
    FROM part, (VALUES ('.cpy', 'copybook', 2, ' 01 A#.' || chr(10) || '  05 B PIC X.'), ('.jcl', 'job', 2, '//J# JOB' || chr(10) || '//S EXEC PGM=A'), ('.rexx', 'script', 2, 'say #' || chr(10) || '/* kept */'), ('.inc', 'include', 1, '000100 DCL A#   CHAR;')) x(e, k, n, t)
    """,
)
def composed_whole_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Copybooks, jobs, scripts and included members, each cut as its extension says: one chunk of what is left when it has been cleaned."""
    texts = {
        ".cpy": "000100 01 A#.\n000200* note\n      *note\n000300  05 B PIC X.",
        ".jcl": "//J# JOB\nplain\n//* note\n//S EXEC PGM=A",
        ".rexx": "00010000say #\n        /* kept */",
        ".inc": "/* note */\n\n000100 DCL A# /* a\n note */ CHAR;\n",
    }
    own = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("k"))
    parts = [own.select(F.concat(F.lit("c"), "k", F.lit(e)).alias("filename"), F.replace(F.lit(t), F.lit("#"), F.col("k")).alias("text")) for e, t in texts.items()]
    return _numbered(source_chunks.chunk(reduce(DataFrame.unionByName, parts)))


# ---- Encoded files ---------------------------------------------------------

_BY_KIND = {
    "cobol": "PROCEDURE DIVISION.\n MOVE A TO B#.\n",
    "copybook": " 01 F# PIC X\n OCCURS 2.\n",
    "assembly": "M# CSECT\n",
    "pli": "P#: PROC;\n DCL A;\n",
    "rexx": "say #\n",
    "parmlib": "A=#\nNAME=LONG\n",
    "ca7": "JOB: J#\n",
    "dclgen": "EXEC SQL DECLARE T# TABLE\n",
}


def _encoded(text: Column, page: str) -> Column:
    """The bytes of a plain text in a code page, with the next-line character at the ends of lines."""
    codes = files._page(page)
    plain = "".join(map(chr, range(32, 127)))
    into = "".join(chr(codes.index(c)) for c in plain) + chr(codes.index("\x85"))
    return F.encode(F.translate(text, plain + "\n", into), "ISO-8859-1")


@query(
    "decoded_by_kind",
    "SELECT x.kind || p_partkey AS filename, CASE WHEN p_partkey % 3 = 0 THEN 'utf-8' ELSE 'cp1047' END AS encoding, md5(replace(x.t, '#', p_partkey::VARCHAR)) AS digest FROM part, (VALUES "
    + ", ".join("('{}', '{}')".format(kind, text.replace("\n", "' || chr(10) || '")) for kind, text in _BY_KIND.items())
    + ") x(kind, t)",
)
def decoded_by_kind(spark: SparkSession, d: str) -> DataFrame:
    """Files of every type in UTF-8 and in two code pages that agree in what these texts have; the first page that fits is named."""
    own = table(spark, d, "part").select("p_partkey")
    parts = []
    for kind, text in _BY_KIND.items():
        t = F.replace(F.lit(text), F.lit("#"), F.col("p_partkey").cast("string"))
        raw = F.when(F.col("p_partkey") % 3 == 0, F.encode(F.replace(t, F.lit("\n"), F.lit("\r\n")), "UTF-8")).when(F.col("p_partkey") % 3 == 1, _encoded(t, "cp1047")).otherwise(_encoded(t, "cp037"))
        parts.append(files.decoded_as(own.select(F.concat(F.lit(kind), "p_partkey").alias("filename"), raw.alias("content")), kind).select("filename", "encoding", F.md5("text").alias("digest")))
    return reduce(DataFrame.unionByName, parts)
