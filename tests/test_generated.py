"""Line numbers, the assembler reader, diagnostics, trees and ordered sets on texts that say what is tried."""

import json
import random

import duckdb
import pytest
from conftest import assert_same
from pyspark.sql import functions as F

from quarrystone.functions import text as T
from quarrystone.operators import diagnostics, layouts, mainframe, search, statements
from quarrystone.plans import generated_tables
from quarrystone.plans.catalogue import ORACLES

COBOL = """       IDENTIFICATION DIVISION.
      * a note
       PROGRAM-ID. A.
      / page

       PROCEDURE DIVISION.
       100-MAIN.
           MOVE 'ONE' TO WS-P. MOVE 'TWO' TO WS-P.
           CALL WS-P USING B A.
           DISPLAY 'CALL 1.5
      *    a note between
      -    ' END. OF IT'.
           CALL 'STATIC'
             USING C
             END-CALL.
           WOBBLE THE THING.
           EXEC SQL
             SELECT A
             FROM T END-EXEC
           CALL NOBODY. CALL 'LAST'.
"""


def _files(spark, *texts, kind=None):
    rows = [(f"f{i}", *([kind] if kind else []), t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "filename string, " + "file_type string, " * bool(kind) + "text string")


def test_lines_of_programs(spark):
    out = mainframe.cobol(_files(spark, COBOL))
    got = {(r["target"], r["line"]) for r in out["program_calls"].collect()}
    assert got == {("ONE", 9), ("TWO", 9), ("STATIC", 13), ("LAST", 20)}
    several = out["program_calls"].where("variable = 'WS-P'").collect()
    assert all(r["candidates"] == ["ONE", "TWO"] and r["parameters"] == ["A", "B"] for r in several)
    assert [(r["variable"], r["line"], r["candidates"]) for r in out["unresolved_calls"].collect()] == [("NOBODY", 20, None)]
    assert [(r["statement"], r["line"]) for r in out["sql_blocks"].collect()] == [("SELECT A FROM T", 17)]
    bodies = "       PROGRAM-ID. B.\n      * c\n       EVALUATE X\n         WHEN 1 ADD 1 TO A\n         WHEN 2 ADD 2 TO A\n       END-EVALUATE.\n       INVOKE O \"m\".\n"
    told = statements.cobol_statements(_files(spark, bodies))
    assert [(r["when_count"], r["line"]) for r in told["evaluate"].collect()] == [(1, 3)] and told["invoke"].first()["line"] == 7


def test_located_in_joined_lines(spark):
    df = spark.createDataFrame([("a x\nb\nx x c x\nd x\ny", [1, 4, 5, 9, 10]), ("", [1]), (None, None)], "s string, n array<int>")
    got = df.select(T.located("s", "n", r"(x)(?:\nb)?", "g").alias("m")).collect()
    assert [(m["line"], m["last_line"]) for m in got[0]["m"]] == [(1, 4), (5, 8), (5, 8), (5, 8), (9, 9)]
    assert not got[1]["m"] and not got[2]["m"]


def test_assembler_reader(spark):
    mark = lambda t, c="X": t.ljust(71) + c + "SEQ00001"
    fixed = "\n".join([
        "* note", mark("* a note goes on"), "         EXTRN GHOST", "M1       CSECT", mark("         EXTRN A , B,"), mark("               C,", "-"), "               D,", "         wxtrn e * remark",
        "         OPEN  INFILE", "LBL      OPEN  (NOTSEEN)", "         CHECK", "         POINT (RPL1)", '         CALL "DSNHLI"', "         L     15,= V( sub1 )", ".* macro note", "         COPY  M@C", mark("         COPY  LAST"),
    ])
    out = mainframe.assembler(_files(spark, fixed))
    rows = lambda n, *c: sorted(tuple(r[x] for x in c) for r in out[n].collect())
    assert rows("externals", "name", "kind", "line") == [("A", "EXTRN", 5), ("B", "EXTRN", 5), ("C", "EXTRN", 5), ("D", "EXTRN", 5), ("E", "WXTRN", 8)]
    assert rows("file_io", "operation", "file", "line") == [("CHECK", "UNKNOWN", 11), ("OPEN", "INFILE", 9), ("POINT", "RPL1", 12)]
    assert rows("db2_access", "type", "line") == [("CALL DSNHLI", 13)] and rows("program_calls", "target", "line") == [("SUB1", 14)]
    assert rows("copybooks", "copybook", "line") == [("LAST", 17), ("M@C", 16)]
    free = "\n".join([f"         EXTRN {f'N{j}'.ljust(55, 'X')}, TAIL{j}" for j in range(8)])  # past column 72, which is blank
    assert mainframe.assembler(_files(spark, free))["externals"].select("name").distinct().count() == 16


def test_jcl_and_rexx(spark):
    jcl = "//J JOB\n//S1 EXEC PGM=A\n//INC INCLUDE MEMBER=X\n//S3 IF RC=0\n//ODD THING DSN=A.B\n//D DD *\n//P PROC\n"
    out = mainframe.jcl(_files(spark, jcl))
    assert sorted((r["ddname"], r["dataset"]) for r in out["dds"].collect()) == [("", "A.B"), ("D", None)]
    assert [tuple(r)[:3] for r in out["include_groups"].collect()] == [("J", "S1", "X")]
    rexx = "ADDRESS LINK 'PGM1'\naddress linkmvs \"PGM2\"\n\"ALLOC DA('A.B(MEM)') SHR\"\n\"FREE DA(NOT.SEEN)\"\n\"DELETE 'REC.X' DSN(NODOT)\"\nif sysuid = getenv( 'H1' )\n"
    out = mainframe.rexx(_files(spark, rexx))
    assert {r["program"] for r in out["calls"].collect()} == {"PGM1", "PGM2"}
    assert {r["dataset"] for r in out["datasets"].collect()} == {"A.B.MEM"}
    assert {r["variable"] for r in out["environment"].collect()} == {"SYSUID", "H1"}


def test_diagnostics(spark):
    files = _files(spark, COBOL, "", None, "       MOVE A TO B.", kind="cobol").unionByName(spark.createDataFrame([("j", "jcl", "//J JOB\n//X NOPE\n//  DD A\n//S EXEC A"), ("p", "pascal", "x"), ("n", None, "x"), ("c", "copybook", "       01 X PIC X")], "filename string, file_type string, text string"))
    errors = sorted(((r["filename"], r["error_type"], r["message"], r["line"], r["content"]) for r in diagnostics.parse_errors(files).collect()), key=str)
    assert errors == sorted([
        ("f0", "unrecognized", "No statement recognised", 16, "WOBBLE THE THING."), ("f1", "fatal", "empty file", None, None), ("f2", "fatal", "not decoded", None, None), ("f3", "fatal", "no PROGRAM-ID", None, None),
        ("j", "unrecognized", "Unknown operation", 2, "//X NOPE"), ("j", "warning", "DD statement before any EXEC: ", 3, None), ("p", "fatal", "no parser for pascal", None, None), ("n", "fatal", "no parser for an unnamed type", None, None),
        ("c", "warning", "Unterminated statement at line 1", 1, None),
    ], key=str)
    results = diagnostics.parse_results(files, diagnostics.parse_errors(files))
    assert {r["filename"] for r in results.where("success").collect()} == {"f0", "j", "c"} and results.count() == files.count()
    assert diagnostics.parse_errors(files.where("false")).count() == 0


def test_a_broken_parser_costs_its_own_files_only(spark):
    files = _files(spark, COBOL, kind="cobol").unionByName(spark.createDataFrame([("j", "jcl", "//X NOPE")], "filename string, file_type string, text string"))
    broken = diagnostics.Language(lambda f: f.select("no_such_column"), diagnostics.LANGUAGES["jcl"].spans, "")
    got = {(r["filename"], r["error_type"]): r["message"] for r in diagnostics.parse_errors(files, {**diagnostics.LANGUAGES, "cobol": broken}).collect()}
    assert set(got) == {("f0", "fatal"), ("j", "unrecognized")} and got["f0", "fatal"].startswith("parser failed")


def test_unmatched_lines_of_nested_spans(spark):
    code = spark.createDataFrame([("a", i, str(i)) for i in range(1, 11)] + [("b", 1, "x")], "filename string, line int, content string")
    spans = spark.createDataFrame([("a", 2, 6), ("a", 3, 4), ("a", 8, 8), ("a", 6, 7)], "filename string, line int, last_line int")
    assert sorted((r["filename"], r["line"]) for r in diagnostics.unmatched(code, spans).collect()) == [("a", 1), ("a", 9), ("a", 10), ("b", 1)]


@pytest.mark.parametrize("seed", range(3))
def test_trees_by_recursion(spark, seed):
    rng = random.Random(seed)
    rows = [(f"f{f}", i, rng.choice([1, 2, 3, 5, 5, 10, 49, 77]), rng.choice(["x", 'q"u', None])) for f in range(4) for i in range(rng.choice([1, 2, 60]))]

    def tree(own):
        out, stack = [], []
        for _, position, level, name in own:
            node = {"position": position, "level": level, **({"name": name} if name is not None else {})}
            while stack and stack[-1][0] >= level:
                stack.pop()
            (stack[-1][1].setdefault("children", []) if stack else out).append(node)
            stack.append((level, node))
        return out

    df = spark.createDataFrame(rows, "filename string, position int, level int, name string").repartition(3)
    got = {r["filename"]: json.loads(r["tree"]) for r in layouts.nested_json(df, ["position", "level", "name"]).collect()}
    assert got == {f: tree([r for r in rows if r[0] == f]) for f in {r[0] for r in rows}}
    assert layouts.nested_json(df.where("false"), ["position"]).count() == 0


def test_first_seen_is_stable(spark):
    rows = [(k % 3, f"v{(k * k) % 7}", k) for k in range(200)] + [(1, None, -1)]
    df = spark.createDataFrame(rows, "key long, value string, at long")
    want = {}
    for key, value, _ in rows[:200]:
        want.setdefault(key, {}).setdefault(value)
    for n in (1, 5):
        got = T.first_seen(df.repartition(n), ["key"], "value", "at", "seen").collect()
        assert {r["key"]: r["seen"] for r in got} == {k: list(v) for k, v in want.items()}


def test_operations_without_a_place_or_a_name(spark, tmp_path):
    rows = [(5, 1, 1, "A", "O"), (None, 1, 2, "A", "F"), (4, 1, 3, "A", None), (None, 1, 1, "A", "O"), (7, 2, 1, "R", None), (8, 2, None, "R", "O"), (9, None, 1, None, "O"), (3, None, 2, None, "F")]
    schema = "l_orderkey long, l_suppkey long, l_linenumber int, l_returnflag string, l_linestatus string"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    got = generated_tables.operations_first_seen(spark, str(tmp_path))
    assert {tuple(r) for r in got.collect()} == {(1, "A", "O1 F2"), (2, "R", None), (None, None, "F2 O1")}
    assert_same(got, con.sql(ORACLES["operations_first_seen"]))


def test_items_and_texts_without_an_id(spark):
    items = spark.createDataFrame([(1, "some longer item here"), (None, "another quite long item"), (2, "short")], "i long, text string")
    texts = spark.createDataFrame([(None, "x some longer item here y"), (7, "another quite long item and short"), (8, "nothing")], "t long, text string")
    got = {tuple(r) for r in search.containing(items, texts, "i", "t").collect()}
    assert got == {(1, None), (None, 7), (2, 7)}
    assert T.node_name(F.lit("a-b/1 é")) is not None
    assert spark.range(1).select(T.node_name(F.lit("a-b/1 é"))).first()[0] == "nodeab1"
