from quarrystone.operators import statements
from quarrystone.plans import reports

COBOL = """       IDENTIFICATION DIVISION.
       PROGRAM-ID. MAINPGM.
       PROCEDURE DIVISION.
       DECLARATIVES.
       E1 SECTION.
           USE AFTER STANDARD ERROR PROCEDURE ON CUST-FILE.
       END DECLARATIVES.
           EXEC CICS SEND MAP('M1') END-EXEC.
           XML PARSE DOC-A PROCESSING PROCEDURE HANDLER END-XML.
           JSON GENERATE OUT-A FROM REC-A.
           JSON PARSE IN-A INTO REC-B.
           INVOKE OBJ-A "run".
           EVALUATE CODE-A
             WHEN 1 ADD 1 TO A
             WHEN 2 ADD 2 TO A
             WHEN OTHER ADD 3 TO A
           END-EVALUATE.
       IDENTIFICATION DIVISION.
       PROGRAM-ID. INNER.
"""
COPYBOOK = """      * comment
           COPY BASEREC OF LIBA REPLACING ==A== BY ==B==.
      D    COPY DEBUGREC.
           COPY
               OTHERREC.
       01 X PIC X(3) VALUE 'a.
      -    'b c'.
       01 Y PIC X
"""
RECORD = """           EXEC SQL DECLARE EMP TABLE
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
ASSEMBLER = """MAIN     CSECT
         L     15,=V(TAXCALC)
         BALR  14,15
         L     15,SUBADDR
         BASR  14,15
OTHER    CSECT
         BALR  14,15
"""


def _files(spark, text):
    return spark.createDataFrame([("f", text), ("empty", "")], "filename string, text string")


def _set(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


def test_cobol_statements(spark):
    out = statements.cobol_statements(_files(spark, COBOL))
    assert _set(out["cics"], "command", "statement") == {("SEND", "EXEC CICS SEND MAP('M1') END-EXEC")}
    assert _set(out["xml_parse"], "document", "procedure") == {("DOC-A", "HANDLER")}
    assert _set(out["json"], "type", "source", "target") == {("GENERATE", "REC-A", "OUT-A"), ("PARSE", "IN-A", "REC-B")}
    assert _set(out["invoke"], "object", "method") == {("OBJ-A", "run")}
    assert _set(out["evaluate"], "subject", "when_count") == {("CODE-A", 2)}
    assert _set(out["nested_programs"], "program") == {("INNER",)}
    assert _set(out["declaratives"], "on_file") == {("CUST-FILE",)}


def test_copybooks(spark):
    files = _files(spark, COPYBOOK)
    out = statements.copybooks(files)
    assert _set(out["references"], "line_no", "copybook", "library", "replacing") == {(2, "BASEREC", "LIBA", "==A== BY ==B=="), (4, "OTHERREC", None, None)}
    assert _set(out["warnings"], "filename", "warning") == {("f", "Unterminated statement at line 8")}
    text = {r.line_no: r.text for r in statements.copybook_statements(files).collect()}
    assert text[6].endswith("VALUE 'a.b c'.")


def test_record_fields(spark):
    out = statements.record_fields(_files(spark, RECORD))
    rows = {r.name: r for r in out.collect()}
    assert set(rows) == {"DCLEMP", "EMP-ID", "EMP-NAME", "SALARY", "IND-SALARY"}
    assert all(rows[n].parent == rows["DCLEMP"].position for n in rows if n != "DCLEMP") and rows["DCLEMP"].parent is None
    assert (rows["EMP-ID"].column, rows["EMP-ID"].type) == ("EMP_ID", "CHAR(5)")
    assert rows["EMP-NAME"].is_varying and rows["EMP-NAME"].type == "VARCHAR(30)"
    assert (rows["SALARY"].host_type, rows["SALARY"].indicator, rows["SALARY"].nullable) == ("decimal?", "IND-SALARY", True)
    assert rows["IND-SALARY"].type is None


def test_register_calls(spark):
    out = statements.register_calls(_files(spark, ASSEMBLER))
    assert _set(out, "target", "via_register", "load_type", "load_line", "call_line") == {("TAXCALC", "15", "V-constant", 2, 3), ("SUBADDR", "15", "direct-symbol", 4, 5)}


def test_reports(spark, tmp_path):
    calls = spark.createDataFrame([("B", "C|D"), ("A", None)], "program string, target string")
    report = reports.dependency_report(spark, "P1", {"calls": calls, "none": calls.limit(0)}, ["jcl"])
    got = [r.line for r in report.orderBy("section", "part", "at").collect()]
    assert got[:4] == ["# Dependency Graph", "", "> Project: P1", ""]
    at = got.index("## calls")
    assert got[at : at + 8] == ["## calls", "", "Entries: 2", "", "| program | target |", "|-|-|", "| A | - |", "| B | C\\|D |"]
    assert "No entries." in got and got[-1] == "- jcl"
    reports.write_report(report, str(tmp_path / "report"))
    written = [r.value for r in spark.read.text(str(tmp_path / "report")).collect()]
    assert sorted(written) == sorted(got)
    files = spark.createDataFrame([("cobol", "b.cbl", "Pays", ["x", "y"]), ("cobol", "a.cbl", None, None)], "file_type string, filename string, purpose string, functions array<string>")
    lines = [r.line for r in reports.summary_report(files, {"cobol": "COBOL Programs", "jcl": "JCL"}).orderBy("section", "part", "at").collect()]
    assert lines == ["# File Summaries", "", "## COBOL Programs", "### a.cbl", "**Purpose**: N/A", "", "### b.cbl", "**Purpose**: Pays", "- x", "- y", ""]
