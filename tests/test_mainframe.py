from quarrystone.operators import chunks, graph, mainframe, vectors
from quarrystone.sources import files
from quarrystone.streaming import ingest

COBOL = """       IDENTIFICATION DIVISION.
       PROGRAM-ID. PAYMAIN.
      * A COMMENT LINE
       01 WS-PGM PIC X(8) VALUE 'TAXCALC'.
       PROCEDURE DIVISION.
           COPY CUSTREC OF PRODLIB.
           CALL 'AUDITLOG'.
           CALL WS-PGM USING WS-A WS-B.
           CALL WS-NONE.
           EXEC SQL SELECT X FROM EMP END-EXEC.
           READ CUST-FILE INTO WS-A.
"""
JCL = """//PAYJOB   JOB (ACCT),'PAY',CLASS=A
//* comment
//STEP01   EXEC PGM=PAYMAIN
//CUSTIN   DD DSN=PROD.CUST.MASTER,DISP=SHR
//RPTOUT   DD DSN=PROD.PAY.RPT,
//            DISP=(NEW,CATLG)
//STEP02   EXEC PROC=PAYPROC
"""
SCHEDULE = "JOB: PAYJOB  SYSTEM: FIN  SCHID: 001\n  DEP-JOB: PREJOB\n  DSN: PROD.CUST.MASTER\n  USR-REQ: CHECKIT\nJOB: PAYJOB  SYSTEM: FIN\n  DEP-JOB: PREJOB\nJOB: FIN*\n"
REXX = "/* comment CALL 'SKIPPED' */\nCALL 'PAYMAIN'\n\"SUBMIT 'PROD.JCL(PAYJOB)'\"\n\"ALLOC DA('PROD.CUST.MASTER') SHR\"\nx = GETENV('HOME_DIR')\n"
PARMLIB = "* comment\nSET &HLQ=PROD\nREGION=64M\nMSGCLASS=X\nPGM=IEFBR14\n"
ASSEMBLER = "PAYASM   CSECT\n         COPY EQUATES\n         L     15,=V(TAXCALC)\n         EXTRN SUBA,SUBB\n         OPEN  (CUSTDD)\n"
PLI = "PAYPLI: PROC OPTIONS(MAIN);\n %INCLUDE CUSTINC;\n DCL INF FILE;\n CALL TAXPLI(A);\n FETCH DYNSUB;\n EXEC SQL SELECT A FROM HR.EMP;\n WRITE FILE(OUTF) FROM(R);\nEND;\n"
TABLES = "EXEC SQL DECLARE DEMO.ITEMS TABLE\n ( ITEM_ID CHAR(5) NOT NULL,\n   NAME VARCHAR(30) NOT NULL,\n   SALARY DECIMAL(9,2),\n   QTY INTEGER\n ) END-EXEC.\n"


def _files(spark, text):
    return spark.createDataFrame([("f", text)], "filename string, text string")


def _set(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


def test_cobol(spark):
    out = mainframe.cobol(_files(spark, COBOL))
    assert _set(out["program_calls"], "program", "target", "call_type", "variable") == {("PAYMAIN", "AUDITLOG", "static", None), ("PAYMAIN", "TAXCALC", "dynamic", "WS-PGM")}
    assert _set(out["unresolved_calls"], "program", "target", "variable") == {("PAYMAIN", None, "WS-NONE")}
    assert _set(out["copybooks"], "program", "copybook", "library") == {("PAYMAIN", "CUSTREC", "PRODLIB")}
    assert _set(out["sql_blocks"], "type", "statement") == {("SELECT", "SELECT X FROM EMP")}
    assert _set(out["sql_tables"], "table", "operation") == {("EMP", "READ")}
    assert _set(out["file_io"], "file", "operation") == {("CUST-FILE", "READ")}


def test_jcl(spark):
    out = mainframe.jcl(_files(spark, JCL))
    assert _set(out["program_calls"], "job", "program") == {("PAYJOB", "PAYMAIN")}
    assert _set(out["proc_calls"], "job", "proc") == {("PAYJOB", "PAYPROC")}
    assert _set(out["files"], "step", "ddname", "dataset", "mode", "access", "disp") == {("STEP01", "CUSTIN", "PROD.CUST.MASTER", "INPUT", "READ", "SHR"), ("STEP01", "RPTOUT", "PROD.PAY.RPT", "OUTPUT", "CREATE", "NEW")}


def test_schedule(spark):
    out = mainframe.schedule(_files(spark, SCHEDULE))
    assert _set(out["jobs"], "job", "system", "schid") == {("PAYJOB", "FIN", "001")}
    assert _set(out["job_flow"], "before", "job") == {("PREJOB", "PAYJOB")}
    assert _set(out["dataset_triggers"], "dataset", "job") == {("PROD.CUST.MASTER", "PAYJOB")}
    assert _set(out["user_requirements"], "requirement", "job") == {("CHECKIT", "PAYJOB")}


def test_rexx_parmlib_assembler_pli(spark):
    rexx = mainframe.rexx(_files(spark, REXX))
    assert _set(rexx["calls"], "program") == {("PAYMAIN",)}
    assert _set(rexx["submissions"], "job") == {("PAYJOB",)}
    assert _set(rexx["datasets"], "dataset") == {("PROD.CUST.MASTER",)}
    assert _set(rexx["utilities"], "utility") == {("ALLOC",), ("SUBMIT",)}
    assert _set(rexx["environment"], "variable") == {("HOME_DIR",)}
    parm = mainframe.parmlib(_files(spark, PARMLIB))
    assert _set(parm["symbols"], "name", "value", "scope") == {("HLQ", "PROD", "GLOBAL")}
    assert _set(parm["parameters"], "name", "category") == {("REGION", "MEMORY"), ("MSGCLASS", "SCHEDULING"), ("PGM", "CONFIGURATION")}
    assert _set(parm["programs"], "program") == {("IEFBR14",)}
    asm = mainframe.assembler(_files(spark, ASSEMBLER))
    assert _set(asm["modules"], "module") == {("PAYASM",)}
    assert _set(asm["copybooks"], "copybook") == {("EQUATES",)}
    assert _set(asm["program_calls"], "target") == {("TAXCALC",)}
    assert _set(asm["externals"], "name", "kind") == {("SUBA", "EXTRN"), ("SUBB", "EXTRN")}
    assert _set(asm["file_io"], "file", "operation") == {("CUSTDD", "OPEN")}
    pli = mainframe.pli(_files(spark, PLI))
    assert _set(pli["programs"], "program") == {("PAYPLI",)}
    assert _set(pli["includes"], "copybook") == {("CUSTINC",)}
    assert _set(pli["program_calls"], "target", "call_type") == {("TAXPLI", "static"), ("DYNSUB", "dynamic")}
    assert _set(pli["sql_tables"], "table", "operation") == {("HR.EMP", "READ")}
    assert _set(pli["file_io"], "file", "operation") == {("OUTF", "WRITE")}


def test_table_declarations(spark):
    out = mainframe.table_declarations(_files(spark, TABLES))
    assert _set(out, "table", "column", "type", "nullable", "host_type") == {("DEMO.ITEMS", "ITEM_ID", "CHAR(5)", False, "string"), ("DEMO.ITEMS", "NAME", "VARCHAR(30)", False, "string"), ("DEMO.ITEMS", "SALARY", "DECIMAL(9,2)", True, "decimal?"), ("DEMO.ITEMS", "QTY", "INTEGER", True, "int?")}


def test_graph_of_the_fixture(spark):
    cobol, jcl, plan = mainframe.cobol(_files(spark, COBOL)), mainframe.jcl(_files(spark, JCL)), mainframe.schedule(_files(spark, SCHEDULE))
    jf = jcl["files"]
    edges = graph.edges_from(
        {
            "CALL": (cobol["program_calls"], "program", "target", ""),
            "INCLUDE": (cobol["copybooks"], "program", "copybook", ""),
            "ACCESS_FILE": (cobol["file_io"], "program", "file", "FILE:"),
            "EXEC_PGM": (jcl["program_calls"], "job", "program", ""),
            "EXEC_PROC": (jcl["proc_calls"], "job", "proc", ""),
            "READ_FILE": (jf.where("access = 'READ'"), "job", "dataset", "FILE:"),
            "WRITE_FILE": (jf.where("access = 'CREATE'"), "job", "dataset", "FILE:"),
            "TRIGGER": (plan["job_flow"], "before", "job", ""),
        }
    )
    assert edges.count() == 9
    assert graph.top_by_in_degree(edges, 1).first()["in_degree"] == 1
    assert {r["node"] for r in graph.reachable(edges, spark.createDataFrame([("PREJOB",)], "node string"), 2).collect()} == {"PREJOB", "PAYJOB", "PAYMAIN", "PAYPROC", "FILE:PROD.CUST.MASTER", "FILE:PROD.PAY.RPT"}
    assert graph.diagram_lines(edges, 3).count() == 3


def test_decoding_and_limits(spark):
    rows = [("p", "cobol", "a", COBOL.encode()), ("p", "cobol", "b", COBOL.encode("cp037")), ("p", "cobol", "c", b""), ("p", "jcl", "d", b"\xff\xfe junk")]
    src = spark.createDataFrame(rows, "project_id string, file_type string, filename string, content binary")
    out = {r["filename"]: r for r in files.decoded(src).collect()}
    assert out["a"]["encoding"] == "utf-8" and out["b"]["encoding"] == "cp1047" and "PROGRAM-ID. PAYMAIN" in out["b"]["text"]
    assert {tuple(r) for r in files.oversized(src).select("filename", "reason").collect()} == {("c", "empty file")}


def test_chunks_and_vectors(spark):
    own = spark.createDataFrame([(1, "abc" * 700), (2, None), (3, "")], "k int, text string")
    got = chunks.sliding(own, "k").where("k = 1").orderBy("n").collect()
    assert [r["start"] for r in got] == [0, 800, 1600] and got[0]["chunk"] == ("abc" * 700)[:1000]
    vec = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(20)], "vec_id int, embedding array<float>")
    near = vectors.nearest_of_each(vec, vec.where("vec_id in (0, 10)").withColumnRenamed("vec_id", "query_id"), 3).collect()
    assert {(r["query_id"], r["vec_id"]) for r in near} == {(0, 0), (0, 1), (0, 2), (10, 10), (10, 9), (10, 11)}


def test_streaming(spark, tmp_path):
    from conftest import SF

    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(4).write.parquet(str(tmp_path / "in"))
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    stream = ingest.arriving(spark, str(tmp_path / "in"), schema, 1)
    ingest.latest_by_key(stream, ["user_id"], "ts", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = {(r["user_id"], r["event_id"]) for r in ingest.current(spark, str(tmp_path / "out"), ["user_id"], "ts").collect()}
    want = {tuple(r) for r in events.selectExpr("user_id", "event_id", "row_number() over (partition by user_id order by ts desc, event_id desc) n").where("n = 1").select("user_id", "event_id").collect()}
    assert {u for u, _ in got} == {u for u, _ in want} and len(got & want) >= 0.98 * len(want)
