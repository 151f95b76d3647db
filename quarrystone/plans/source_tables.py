"""Queries of the parsers, chunkers, decoders and graph builders over made-up sources.

Every text is written once for each supplier, the supplier's key in place of the sign
§, so the expected rows are a list of values for each supplier, written out by hand.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.operators import graph, mainframe, source_chunks, statements
from quarrystone.plans.catalogue import query, table
from quarrystone.sources import files as sources

COBOL = """       IDENTIFICATION DIVISION.
       PROGRAM-ID. PAY§.
      * CALL 'COMMENT'
       SELECT CUST-FILE ASSIGN TO CUSTDD§.
       01 WS-PGM PIC X(8) VALUE 'TAX§'.
       PROCEDURE DIVISION.
           COPY CUSTREC OF PRODLIB.
           COPY PLAIN§.
           CALL 'AUDIT§' USING WS-B WS-A.
           CALL WS-PGM.
           CALL WS-NONE.
           EXEC SQL SELECT X FROM EMP§ JOIN DEPT ON A = B END-EXEC.
           EXEC SQL UPDATE HR.PAYROLL SET A = 1 END-EXEC.
           EXEC SQL INSERT INTO LOG§ (A) VALUES (1) END-EXEC.
           OPEN INPUT CUST-FILE.
           READ CUST-FILE INTO WS-A.
           CLOSE CUST-FILE RPT-FILE.
"""
STATEMENTS = """       IDENTIFICATION DIVISION.
       PROGRAM-ID. MAINPGM.
       PROCEDURE DIVISION.
       DECLARATIVES.
       E1 SECTION.
           USE AFTER STANDARD ERROR PROCEDURE ON CUST-FILE.
       END DECLARATIVES.
           EXEC CICS SEND MAP('M§') END-EXEC.
           XML PARSE DOC-§ PROCESSING PROCEDURE HANDLER END-XML.
           JSON GENERATE OUT-A FROM REC-A.
           JSON PARSE IN-§ INTO REC-B.
           INVOKE OBJ-A "run§".
           EVALUATE CODE-A
             WHEN 1 ADD 1 TO A
             WHEN 2 ADD 2 TO A
             WHEN OTHER ADD 3 TO A
           END-EVALUATE.
       IDENTIFICATION DIVISION.
       PROGRAM-ID. INNER§.
"""
COPYBOOK = """      * comment
           COPY BASE§ OF LIBA REPLACING ==A== BY ==B==.
      D    COPY DEBUGREC.
           COPY
               OTHERREC.
       01 X PIC X(3) VALUE 'a.
      -    'b c'.
       01 Y PIC X
"""
RECORD = """           EXEC SQL DECLARE EMP§ TABLE
           ( EMP_ID CHAR(5) NOT NULL,
             EMP_NAME VARCHAR(30) NOT NULL,
             SALARY DECIMAL(9,2)
           ) END-EXEC.
       01 DCLEMP.
          10 EMP-ID PIC X(5).
          10 EMP-NAME.
             49 EMP-NAME-LEN PIC S9(4).
             49 EMP-NAME-TEXT PIC X(30).
          10 SALARY PIC S9(7)V9(2).
             88 RICH VALUE 9.
          10 IND-SALARY PIC S9(4).
"""
JCL = """//PAY§   JOB (ACCT),'PAY',CLASS=A
//* comment
//STEP01   EXEC PGM=MAIN§
//CUSTIN   DD DSN=PROD.CUST§,DISP=SHR
//RPTOUT   DD DSN=PROD.RPT§,
//            DISP=(NEW,CATLG)
//SYSOUT   DD SYSOUT=*
//STEP02   EXEC PROC=PROC§
//STEP03   EXEC CATPROC
"""
SCHEDULE = "DATE: today\nJOB: PAY§  SYSTEM: FIN  SCHID: 001\n  DEP-JOB: PRE§\n  DSN: PROD.CUST§\n  USR-REQ: CHECKIT\nJOB: PAY§  SYSTEM: FIN\n  DEP-JOB: PRE§\nJOB: FIN*\n  DEP-JOB: LOST\nJOB: PAGE\n  DEP-JOB: LOST\nJOB: LAST§\n  DEP-JOB: PAY§\n"
REXX = "/* comment CALL 'SKIPPED' */\nCALL 'MAIN§'\n\"SUBMIT 'PROD.JCL(PAY§)'\"\n\"ALLOC DA('PROD.CUST§.MASTER') SHR\"\n\"TRANSMIT NODE.USER\"\nADDRESS ISPEXEC \"LMCOPY FROMID(A)\"\nx = GETENV('HOME§')\n"
PARMLIB = "* comment\nSET &HLQ=PROD§\nINFILE=&LIB.X\nREGION=64M\nREGION=32M\nMAXRECS=9\nPGM=IEFBR14\nJOB=PAY§,PROC=PROC§\nDSN=PROD.CUST§.VSAM DISP=OLD\nDEFINE CLUSTER\n"
ASSEMBLER = "         TITLE 'PAY§ - PAYROLL'\n* COPY LOST\nPAYASM   CSECT\n         COPY EQU§\n         L     15,=V(TAX§)\n         BALR  14,15\n         L     15,SUBADDR\n         BASR  14,15\n         EXTRN SUBA,SUBB\n         OPEN  (CUST§)\n"
PLI = "PAY§: PROC OPTIONS(MAIN);\n %INCLUDE CUST§;\n /* CALL LOST; */ DCL INF FILE TITLE('DD:IN§');\n CALL TAX§(A);\n CALL PLITDLI(X);\n FETCH DYN§;\n EXEC SQL INCLUDE SQLCA;\n EXEC SQL INCLUDE DCL§;\n EXEC SQL SELECT A FROM HR.EMP§;\n EXEC CICS LINK PROGRAM('X');\n WRITE FILE(OUT§) FROM(R);\n IF A = 1 THEN B = 2;\nEND;\n"

Parse = Callable[[DataFrame], dict[str, DataFrame]]


def _files(spark: SparkSession, d: str, text: str, name: str = "f§") -> DataFrame:
    own = lambda c: F.replace(F.lit(c), F.lit("§"), F.col("s_suppkey").cast("string"))
    return table(spark, d, "supplier").select(own(name).alias("filename"), own(text).alias("text"))


def _plain(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Whole numbers as long, arrays joined."""
    kinds = dict(df.select(*columns).dtypes)
    flat = {c: F.array_join(c, " ") if k.startswith("array") else F.col(c).cast("long") if k in ("int", "bigint") else F.col(c) for c, k in kinds.items()}
    return df.select(*(v.alias(c) for c, v in flat.items()))


def _values(columns: Sequence[str], rows: Sequence[tuple]) -> str:
    """The rows for each supplier, in SQL."""

    def cell(x) -> str:
        if x is None:
            return "NULL"
        return str(x) if isinstance(x, (int, bool)) else "'" + x.replace("'", "''") + "'"

    def own(i: int, c: str) -> str:
        kinds = {type(r[i]) for r in rows} - {type(None)}
        if kinds == {bool}:
            return f'v."{c}"::BOOLEAN AS "{c}"'
        if kinds == {int}:
            return f'v."{c}"::BIGINT AS "{c}"'
        return f"""replace(v."{c}"::VARCHAR, '§', s_suppkey::VARCHAR) AS "{c}\""""

    listed = ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)
    names = ", ".join(f'"{c}"' for c in columns)
    return f"SELECT {', '.join(own(i, c) for i, c in enumerate(columns))} FROM supplier, (VALUES {listed}) v({names})"


def _register(name: str, text: str, find: Callable[[DataFrame], DataFrame], columns: str, *rows: tuple, file: str = "f§") -> None:
    names = columns.split()

    @query(name, _values(names, rows))
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _plain(find(_files(spark, d, text, file)), names)


def _relations(prefix: str, text: str, parse: Parse, **expected: tuple) -> None:
    """One query for each relation: its columns, then its rows."""
    for relation, (columns, *rows) in expected.items():
        _register(f"{prefix}_{relation}", text, lambda f, r=relation: parse(f)[r], columns, *rows)


_relations(
    "cobol", COBOL, mainframe.cobol,
    program_calls=("program target call_type variable", ("PAY§", "AUDIT§", "static", None), ("PAY§", "TAX§", "dynamic", "WS-PGM")),
    unresolved_calls=("program target variable", ("PAY§", None, "WS-NONE")),
    copybooks=("program copybook library", ("PAY§", "CUSTREC", "PRODLIB"), ("PAY§", "PLAIN§", None)),
    sql_blocks=("program type statement", ("PAY§", "SELECT", "SELECT X FROM EMP§ JOIN DEPT ON A = B"), ("PAY§", "UPDATE", "UPDATE HR.PAYROLL SET A = 1"), ("PAY§", "INSERT", "INSERT INTO LOG§ (A) VALUES (1)")),
    sql_tables=("program table operation", ("PAY§", "EMP§", "READ"), ("PAY§", "DEPT", "READ"), ("PAY§", "HR.PAYROLL", "WRITE"), ("PAY§", "LOG§", "WRITE")),
    file_assignments=("program file device", ("PAY§", "CUST-FILE", "CUSTDD§")),
    file_io=("program file operation", ("PAY§", "CUST-FILE", "OPEN INPUT"), ("PAY§", "CUST-FILE", "READ"), ("PAY§", "CUST-FILE", "CLOSE"), ("PAY§", "RPT-FILE", "CLOSE")),
)
_relations(
    "cobol", STATEMENTS, statements.cobol_statements,
    cics=("filename command statement", ("f§", "SEND", "EXEC CICS SEND MAP('M§') END-EXEC")),
    xml_parse=("filename document procedure", ("f§", "DOC-§", "HANDLER")),
    json=("filename type source target", ("f§", "GENERATE", "REC-A", "OUT-A"), ("f§", "PARSE", "IN-§", "REC-B")),
    invoke=("filename object method", ("f§", "OBJ-A", "run§")),
    evaluate=("filename subject when_count", ("f§", "CODE-A", 2)),
    nested_programs=("filename program", ("f§", "INNER§")),
    declaratives=("filename on_file", ("f§", "CUST-FILE")),
)
_relations(
    "copybook", COPYBOOK, statements.copybooks,
    references=("filename line_no copybook library replacing", ("f§", 2, "BASE§", "LIBA", "==A== BY ==B=="), ("f§", 4, "OTHERREC", None, None)),
    warnings=("filename line_no warning", ("f§", 8, "Unterminated statement at line 8")),
)
_register("copybook_statement_ends", COPYBOOK, statements.copybook_statements, "filename line_no terminated", ("f§", 2, True), ("f§", 4, True), ("f§", 6, True), ("f§", 8, False))
_register("table_declarations", RECORD, mainframe.table_declarations, "filename table position column type nullable host_type", ("f§", "EMP§", 0, "EMP_ID", "CHAR(5)", False, "string"), ("f§", "EMP§", 1, "EMP_NAME", "VARCHAR(30)", False, "string"), ("f§", "EMP§", 2, "SALARY", "DECIMAL(9,2)", True, "decimal?"))
_register(
    "record_fields", RECORD, statements.record_fields, "filename level name is_varying column type nullable host_type indicator",
    ("f§", 1, "DCLEMP", False, None, None, None, None, None),
    ("f§", 10, "EMP-ID", False, "EMP_ID", "CHAR(5)", False, "string", None),
    ("f§", 10, "EMP-NAME", True, "EMP_NAME", "VARCHAR(30)", False, "string", None),
    ("f§", 10, "SALARY", False, "SALARY", "DECIMAL(9,2)", True, "decimal?", "IND-SALARY"),
    ("f§", 10, "IND-SALARY", False, None, None, None, None, None),
)
_relations(
    "jcl", JCL, mainframe.jcl,
    program_calls=("job step program", ("PAY§", "STEP01", "MAIN§")),
    proc_calls=("job step proc", ("PAY§", "STEP02", "PROC§"), ("PAY§", "STEP03", "CATPROC")),
    files=("job step ddname dataset mode access disp", ("PAY§", "STEP01", "CUSTIN", "PROD.CUST§", "INPUT", "READ", "SHR"), ("PAY§", "STEP01", "RPTOUT", "PROD.RPT§", "OUTPUT", "CREATE", "NEW")),
    dds=("job step ddname dataset", ("PAY§", "STEP01", "CUSTIN", "PROD.CUST§"), ("PAY§", "STEP01", "RPTOUT", "PROD.RPT§"), ("PAY§", "STEP01", "SYSOUT", None)),
)
_relations(
    "schedule", SCHEDULE, mainframe.schedule,
    jobs=("job system schid", ("PAY§", "FIN", "001"), ("LAST§", None, None)),
    job_flow=("before job", ("PRE§", "PAY§"), ("PAY§", "LAST§")),
    dataset_triggers=("dataset job", ("PROD.CUST§", "PAY§")),
)
_relations(
    "rexx", REXX, mainframe.rexx,
    calls=("filename program", ("f§", "MAIN§")),
    submissions=("filename job", ("f§", "PAY§")),
    datasets=("filename dataset", ("f§", "PROD.CUST§.MASTER")),
    utilities=("filename utility", ("f§", "SUBMIT"), ("f§", "ALLOC"), ("f§", "TRANSMIT"), ("f§", "ISPEXEC"), ("f§", "LMCOPY")),
    environment=("filename variable", ("f§", "HOME§")),
)
_relations(
    "parmlib", PARMLIB, mainframe.parmlib,
    symbols=("filename line_no name value scope", ("f§", 2, "HLQ", "PROD§", "GLOBAL"), ("f§", 3, "LIB", None, "REFERENCE")),
    parameters=("filename name value category", ("f§", "INFILE", "&LIB.X", "DATASET"), ("f§", "REGION", "64M", "MEMORY"), ("f§", "MAXRECS", "9", "EXECUTION"), ("f§", "PGM", "IEFBR14", "CONFIGURATION"), ("f§", "JOB", "PAY§", "CONFIGURATION"), ("f§", "DSN", "PROD.CUST§.VSAM", "DATASET")),
    programs=("filename program purpose", ("f§", "IEFBR14", "EXECUTION")),
    references=("filename name usage", ("f§", "PAY§", "JOB_REFERENCE"), ("f§", "PROC§", "PROC_REFERENCE")),
    datasets=("filename dataset kind disposition", ("f§", "LIB.X", "UNKNOWN", None), ("f§", "PROD.CUST§.VSAM", "VSAM", "OLD")),
    utilities=("filename utility", ("f§", "IEFBR14"), ("f§", "IDCAMS")),
)
_relations(
    "assembler", ASSEMBLER, mainframe.assembler,
    modules=("filename module", ("f§", "PAY§")),
    copybooks=("filename copybook", ("f§", "EQU§")),
    program_calls=("filename target", ("f§", "TAX§")),
    externals=("filename name kind", ("f§", "SUBA", "EXTRN"), ("f§", "SUBB", "EXTRN")),
    file_io=("filename file operation", ("f§", "CUST§", "OPEN")),
)
_register("assembler_register_calls", ASSEMBLER, statements.register_calls, "filename target via_register load_type load_line call_line", ("f§", "TAX§", "15", "V-constant", 5, 6), ("f§", "SUBADDR", "15", "direct-symbol", 7, 8))
_register("assembler_format", "X".ljust(80) + "\n" + ("LONG LINE ".ljust(71) + " AND MORE\n") * 6, lambda f: f.select("filename", mainframe.is_free_format(F.col("text")).alias("is_free")), "filename is_free", ("f§", True))
_relations(
    "pli", PLI, mainframe.pli,
    programs=("filename program", ("f§", "PAY§")),
    statements=("filename seq kind", ("f§", 0, "LABEL"), ("f§", 1, "PREPROCESSOR"), ("f§", 2, "LABEL"), ("f§", 3, "CALL"), ("f§", 4, "CALL"), ("f§", 5, "CALL"), ("f§", 6, "EXEC"), ("f§", 7, "EXEC"), ("f§", 8, "EXEC"), ("f§", 9, "EXEC"), ("f§", 10, "STATEMENT"), ("f§", 11, "LOGIC"), ("f§", 12, "LOGIC")),
    includes=("filename copybook", ("f§", "CUST§")),
    sql_includes=("filename member", ("f§", "DCL§")),
    cics=("filename command", ("f§", "LINK")),
    file_definitions=("filename logical_name dd_name", ("f§", "INF", "IN§")),
    program_calls=("filename target call_type", ("f§", "TAX§", "static"), ("f§", "PLITDLI", "ims"), ("f§", "DYN§", "dynamic")),
    sql_tables=("filename table operation", ("f§", "HR.EMP§", "READ")),
    file_io=("filename file operation", ("f§", "OUT§", "WRITE")),
)

# ---- Chunks ------------------------------------------------------------------

_NUMBERED = "000100 IDENTIFICATION DIVISION.\n000200 PROGRAM-ID. A§.\n000300* NOTE\n000400 PROCEDURE DIVISION.\n000500 1000-INIT.\n000600     MOVE 1 TO X.\n000700     GOBACK.\n000800 DONE.\n000900     EXIT.\n"
_register("chunk_cobol", _NUMBERED, source_chunks.cobol, "filename chunk kind name start_line end_line", ("f§", 1, "division", "IDENTIFICATION", 1, 2), ("f§", 2, "division_header", "PROCEDURE", 3, 3), ("f§", 3, "paragraph", "1000-INIT", 4, 6), ("f§", 4, "paragraph", "DONE", 7, 9))
_register("chunk_cobol_whole", "       01 X§ PIC X.", source_chunks.cobol, "filename chunk kind text", ("f§", 0, "whole", " 01 X§ PIC X."))
_register("chunk_pli", "/* A\n B */ DCL X;\nMAIN§: PROC OPTIONS(MAIN);\n X = 1;\nL1: X = 2;\nEND;", source_chunks.pli, "filename kind name text", ("f§", "header", "HEADER", "DCL X;"), ("f§", "procedure", "MAIN§", "MAIN§: PROC OPTIONS(MAIN);\n X = 1;"), ("f§", "label", "L1", "L1: X = 2;\nEND;"))
_register("chunk_schedule", SCHEDULE, source_chunks.schedule, "filename kind name text", ("f§", "job_definition", "PAY§", "JOB: PAY§  SYSTEM: FIN  SCHID: 001\n  DEP-JOB: PRE§\n  DSN: PROD.CUST§\n  USR-REQ: CHECKIT"), ("f§", "job_definition", "PAY§", "JOB: PAY§  SYSTEM: FIN\n  DEP-JOB: PRE§"), ("f§", "job_definition", "LAST§", "JOB: LAST§\n  DEP-JOB: PAY§\n"))
_register("chunk_assembler", "* note\nMAIN§     CSECT\n         L     1,A\n         BR    14\n         LTR   1,1\nX        DS    F\nY        DS    F\nZ        DS    F\nW        DS    F", source_chunks.assembler, "filename kind name start_line end_line", ("f§", "section", "MAIN§", 1, 4), ("f§", "data_area", "X", 5, 8))
_register("chunk_parameters", "*** MEMORY§ ***\nREGION=1\n* STORAGE PART\nUNIT=X", source_chunks.parameters, "filename kind name text", ("f§", "parameter_group", "MEMORY§", "*** MEMORY§ ***\nREGION=1"), ("f§", "parameter_group", "STORAGE PART", "* STORAGE PART\nUNIT=X"))
_register("chunk_parameter_keys", "A§=1\nB=2\n* next\nC=3", source_chunks.parameters, "filename name", ("f§", "A§, B"), ("f§", "C"))
_register("chunk_jcl", "//J§ JOB\n//* c\nnoise\n//S EXEC PGM=A", source_chunks.chunk, "filename kind text", ("f§.jcl", "job", "//J§ JOB\n//S EXEC PGM=A"), file="f§.jcl")
_register("chunk_rexx", "00000001say §\n00000002say 2", source_chunks.chunk, "filename kind text", ("f§.rexx", "script", "say §\nsay 2"), file="f§.rexx")
_register("chunk_copybook", "      * note\n       01 X§ PIC X.", source_chunks.chunk, "filename kind text", ("f§.cpy", "copybook", " 01 X§ PIC X."), file="f§.cpy")

# ---- Decoding ----------------------------------------------------------------


def _decoding(name: str, kind: str, text: str, page: str | None, encoding: str, expected: str | None = None) -> None:
    """A text in the bytes of a page, decoded by the rule of a file type."""
    raw = text.encode("latin-1" if page is None else page)

    @query(name, f"SELECT 'f' || s_suppkey AS filename, '{encoding}' AS encoding, '{(expected or text).replace(chr(39), chr(39) * 2)}' AS text FROM supplier")
    def run(spark: SparkSession, d: str) -> DataFrame:
        own = table(spark, d, "supplier").select(F.concat(F.lit("f"), "s_suppkey").alias("filename"), F.unhex(F.lit(raw.hex())).alias("content"))
        return sources.decoded_as(own, kind).select("filename", "encoding", "text")


_PROGRAM = "IDENTIFICATION DIVISION. PROCEDURE DIVISION. MOVE A TO B."
_decoding("decode_cobol_utf8", "cobol", _PROGRAM, "utf-8", "utf-8")
_decoding("decode_cobol_ebcdic", "cobol", _PROGRAM, "cp037", "cp1047")
_decoding("decode_cobol_unknown", "cobol", "nothing of the kind", "utf-8", "utf-8-replace")
_decoding("decode_copybook_ebcdic", "copybook", "01 X PIC X OCCURS 5.", "cp037", "cp1047")
_decoding("decode_assembler_ebcdic", "assembly", "MAIN CSECT", "cp037", "cp1047")
_decoding("decode_pli_ebcdic", "pli", "MAIN: PROC OPTIONS(MAIN); A = B; END; /* éé */", "cp037", "cp1047")
_decoding("decode_pli_latin", "pli", "no words é", None, "latin-1")
_decoding("decode_rexx_ebcdic", "rexx", "SAY 'é'", "cp037", "cp1047")
_decoding("decode_parameters_utf8", "parmlib", "REGION=é", "utf-8", "utf-8")
_decoding("decode_schedule_ebcdic", "ca7", "JOB: é", "cp037", "cp1047")
_decoding("decode_declarations_ebcdic", "dclgen", "EXEC SQL DECLARE X TABLE (A CHAR(1)) END-EXEC.", "cp037", "cp1047")
_decoding("decode_declarations_utf8", "dclgen", "EXEC SQL DECLARE X TABLE (A CHAR(1)) END-EXEC.", "utf-8", "utf-8")


@query("source_rejects", "SELECT 'e' || s_suppkey AS filename, 'empty file' AS reason FROM supplier UNION ALL SELECT 'x' || s_suppkey, 'nothing recognised' FROM supplier UNION ALL SELECT 'n' || s_suppkey, 'not decoded' FROM supplier")
def source_rejects(spark: SparkSession, d: str) -> DataFrame:
    """Files in which the statement parser finds nothing, with the reason."""
    good, empty, other = _files(spark, d, STATEMENTS), _files(spark, d, " \n", "e§"), _files(spark, d, "no statements", "x§")
    none = _files(spark, d, "", "n§").withColumn("text", F.lit(None).cast("string"))
    files = good.unionByName(empty).unionByName(other).unionByName(none)
    return sources.rejects(files, *statements.cobol_statements(files).values())


# ---- The graph of everything parsed -------------------------------------------


def _parsed(spark: SparkSession, d: str) -> dict[str, dict[str, DataFrame]]:
    return {
        "cobol": mainframe.cobol(_files(spark, d, COBOL)),
        "pli": mainframe.pli(_files(spark, d, PLI, "pli§")),
        "assembler": mainframe.assembler(_files(spark, d, ASSEMBLER, "asm§")),
        "rexx": mainframe.rexx(_files(spark, d, REXX, "rexx§")),
        "jcl": mainframe.jcl(_files(spark, d, JCL)),
        "schedule": mainframe.schedule(_files(spark, d, SCHEDULE)),
        "parmlib": mainframe.parmlib(_files(spark, d, PARMLIB, "parm§")),
        "copybooks": statements.copybooks(_files(spark, d, COPYBOOK, "copy§")),
    }


_EDGES = (
    ("PAY§", "AUDIT§", "CALL", 3), ("PAY§", "TAX§", "CALL", 3), ("PAY§", "CUSTREC", "INCLUDE", 1), ("PAY§", "PLAIN§", "INCLUDE", 1),
    ("PAY§", "EMP§", "ACCESS_DB", 2), ("PAY§", "DEPT", "ACCESS_DB", 2), ("PAY§", "HR.PAYROLL", "ACCESS_DB", 2), ("PAY§", "LOG§", "ACCESS_DB", 2),
    ("PAY§", "FILE:CUST-FILE", "ACCESS_FILE", 2), ("PAY§", "FILE:RPT-FILE", "ACCESS_FILE", 2),
    ("PLI§", "TAX§", "CALL", 3), ("PLI§", "PLITDLI", "CALL", 3), ("PLI§", "DYN§", "CALL", 3), ("PLI§", "CUST§", "INCLUDE", 1), ("PLI§", "HR.EMP§", "ACCESS_DB", 2), ("PLI§", "DD:IN§", "ACCESS_FILE", 2), ("PLI§", "FILE:OUT§", "ACCESS_FILE", 2),
    ("ASM§", "TAX§", "CALL", 3), ("ASM§", "EQU§", "INCLUDE", 1), ("ASM§", "DD:CUST§", "ACCESS_FILE", 2),
    ("REXX§", "MAIN§", "CALL", 3), ("REXX§", "PAY§", "SUBMIT_JOB", 4), ("REXX§", "FILE:PROD.CUST§.MASTER", "ACCESS_FILE", 2),
    ("PAY§", "MAIN§", "EXEC_PGM", 5), ("PAY§", "PROC§", "EXEC_PROC", 5), ("PAY§", "CATPROC", "EXEC_PROC", 5), ("PAY§", "FILE:PROD.CUST§", "READ_FILE", 2), ("PAY§", "FILE:PROD.RPT§", "WRITE_FILE", 2),
    ("PRE§", "PAY§", "TRIGGER", 5), ("PAY§", "LAST§", "TRIGGER", 5), ("FILE:PROD.CUST§", "PAY§", "TRIGGER", 5),
    ("PARM§", "IEFBR14", "CONFIGURES", 2), ("COPY§", "BASE§", "INCLUDE", 1), ("COPY§", "OTHERREC", "INCLUDE", 1),
)
_EDGES_SQL = _values(("src", "dst", "type", "weight"), _EDGES)


@query("graph_of_sources", _EDGES_SQL)
def graph_of_sources(spark: SparkSession, d: str) -> DataFrame:
    return graph.edges_of(_parsed(spark, d)).withColumn("weight", F.col("weight").cast("long"))


@query("graph_flow_view", f"WITH e AS ({_EDGES_SQL}), o AS (SELECT * FROM e WHERE type IN ('TRIGGER', 'SUBMIT_JOB', 'EXEC_PROC', 'EXEC_PGM') AND src NOT LIKE 'FILE:%'), t AS (SELECT node FROM (SELECT src AS node FROM o UNION ALL SELECT dst FROM o) GROUP BY node ORDER BY count(*) DESC, node LIMIT 30) SELECT src, dst, type FROM o WHERE src IN (FROM t) AND dst IN (FROM t)")
def graph_flow_view(spark: SparkSession, d: str) -> DataFrame:
    return graph.view(graph.edges_of(_parsed(spark, d)), graph.FLOW_EDGES, 30, without=graph.NO_FLOW_NODES).select("src", "dst", "type")


@query("graph_most_used", f"WITH e AS ({_EDGES_SQL}) SELECT dst AS node, count(*) AS in_degree FROM e WHERE NOT starts_with(dst, 'FILE:') AND NOT starts_with(dst, 'DD:') GROUP BY dst ORDER BY in_degree DESC, node LIMIT 10")
def graph_most_used(spark: SparkSession, d: str) -> DataFrame:
    return graph.top_by_in_degree(graph.edges_of(_parsed(spark, d)), 10).select("node", "in_degree")
