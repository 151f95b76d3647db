from pyspark.sql import functions as F

from quarrystone.operators import mainframe, source_chunks
from quarrystone.sources import files as sources

COBOL = "000100 IDENTIFICATION DIVISION.\n000200 PROGRAM-ID. A.\n000300* NOTE\n000400 PROCEDURE DIVISION.\n000500 1000-INIT.\n000600     MOVE 1 TO X.\n000700     GOBACK.\n000800 DONE.\n000900     EXIT.\n"


def _files(spark, **texts):
    return spark.createDataFrame([(k.replace("__", "."), v) for k, v in texts.items()], "filename string, text string")


def _names(df):
    return [(r["kind"], r["name"]) for r in df.orderBy("filename", "chunk").collect()]


def test_cobol_divisions_and_paragraphs(spark):
    found = source_chunks.cobol(_files(spark, a=COBOL, b="       01 X PIC X.", c=None, d=""))
    assert _names(found) == [("division", "IDENTIFICATION"), ("division_header", "PROCEDURE"), ("paragraph", "1000-INIT"), ("paragraph", "DONE"), ("whole", "b")]
    assert not any("NOTE" in r["text"] or "0001" in r["text"] for r in found.collect())


def test_pli_sections(spark):
    found = source_chunks.pli(_files(spark, a="/* A\n B */ DCL X;\nMAIN: PROC OPTIONS(MAIN);\n X = 1;\nL1: X = 2;\nEND;"))
    assert _names(found) == [("header", "HEADER"), ("procedure", "MAIN"), ("label", "L1")]


def test_schedule_jobs(spark):
    found = source_chunks.schedule(_files(spark, a="DATE: today\nJOB: PAY  SYSTEM: F\n  DEP-JOB: PRE\n-----\nJOB: FIN*\n  DSN: X\nJOB: LAST\n"))
    assert _names(found) == [("job_definition", "PAY"), ("job_definition", "LAST")]
    assert "DEP-JOB: PRE" in found.where("name = 'PAY'").first()["text"]


def test_assembler_sections_and_continuation(spark):
    long = "         MVC   A,B".ljust(71) + "X\n" + " " * 15 + "C,D".ljust(56) + "X\n" + " " * 15 + "E"
    found = source_chunks.assembler(_files(spark, a=f"* note\nMAIN     CSECT\n{long}\n         BR    14\n         LTR   1,1\nX        DS    F\nY        DS    F\nZ        DS    F\nW        DS    F\n"))
    assert _names(found) == [("section", "MAIN"), ("data_area", "X")]
    text = found.where("name = 'MAIN'").first()["text"]
    assert len(text.split("\n")) == 4 and "C,D" in text and text.split("\n")[1].endswith("E")


def test_parameter_sections(spark):
    found = source_chunks.parameters(_files(spark, a="*** MEMORY ***\nREGION=1\n* STORAGE PART\nUNIT=X\n", b="A=1\nB=2\n* next\nC=3\n", c="no keys"))
    assert [n for _, n in _names(found)] == ["MEMORY", "STORAGE PART", "A, B", "C", "c"]


def test_chunks_by_extension(spark):
    import pytest

    found = source_chunks.chunk(_files(spark, a__jcl="//J JOB\n//* c\nnoise", b__md="x" * 1500, c__rexx="00000001say 1\n00000002say 2", d__CBL=COBOL))
    assert {r["filename"]: r["n"] for r in found.groupBy("filename").agg(F.count("*").alias("n")).collect()} == {"a.jcl": 1, "b.md": 2, "c.rexx": 1, "d.CBL": 4}
    assert found.where("filename = 'a.jcl'").first()["text"] == "//J JOB" and found.where("filename = 'c.rexx'").first()["text"] == "say 1\nsay 2"
    with pytest.raises(Exception, match="no chunker"):
        source_chunks.chunk(_files(spark, a__exe="x")).collect()


def test_summary_passes(spark):
    f = _files(spark, a="x", b="x\n" * 300)
    assert [r["passes"] for r in source_chunks.summary_passes(f, F.lit("assembly")).orderBy("filename").collect()] == ["single", "rolling"]


def test_parameter_relations(spark):
    text = "SET &HLQ=PROD\nINFILE=&HLQ.X\nPGM=IEFBR14\nJOB=PAYJOB,PROC=P1\nDSN=PROD.CUST.VSAM DISP=OLD\nDEFINE CLUSTER\nMAXRECS=9\n"
    found = mainframe.parmlib(_files(spark, m=text))
    pick = lambda name, *cols: {tuple(r) for r in found[name].select(*cols).collect()}
    assert pick("symbols", "name", "scope") == {("HLQ", "GLOBAL")}
    assert pick("programs", "program", "purpose") == {("IEFBR14", "EXECUTION")}
    assert pick("references", "name", "usage") == {("PAYJOB", "JOB_REFERENCE"), ("P1", "PROC_REFERENCE")}
    assert pick("datasets", "dataset", "kind", "disposition") == {("HLQ.X", "UNKNOWN", None), ("PROD.CUST.VSAM", "VSAM", "OLD")}
    assert pick("utilities", "utility") == {("IEFBR14",), ("IDCAMS",)}
    assert ("MAXRECS", "EXECUTION") in pick("parameters", "name", "category") and ("INFILE", "DATASET") in pick("parameters", "name", "category")


def test_cobol_files(spark):
    text = "       PROGRAM-ID. A.\n           SELECT CUST-FILE ASSIGN TO CUSTDD.\n           OPEN INPUT CUST-FILE.\n           CLOSE CUST-FILE RPT-FILE.\n"
    found = mainframe.cobol(_files(spark, a=text))
    assert [tuple(r) for r in found["file_assignments"].collect()] == [("A", "CUST-FILE", "CUSTDD", 2)]
    assert {(r["file"], r["operation"]) for r in found["file_io"].collect()} == {("CUST-FILE", "OPEN INPUT"), ("CUST-FILE", "CLOSE"), ("RPT-FILE", "CLOSE")}


def test_code_pages(spark):
    text = "IDENTIFICATION DIVISION.\nPROCEDURE DIVISION. ^[]"
    rows = [("a", text.encode("cp500")), ("b", text.encode("cp037")), ("c", text.encode())]
    df = spark.createDataFrame(rows, "filename string, content binary")
    for page, name in (("cp500", "a"), ("cp037", "b")):
        assert df.where(F.col("filename") == name).select(sources.ebcdic(F.col("content"), page).alias("t")).first()["t"].replace("\x85", "\n") == text
    assert sources._page("cp1047")[0xAD] == "[" and sources._page("cp1047")[0x5F] == "^" and len(set(sources._page("cp1047"))) == 256
    assert {r["filename"]: r["encoding"] for r in sources.decoded(df).collect()}["c"] == "utf-8"
