"""Diagnostics of PL/I and members, and introductions, on whole tables and on odd texts."""

import pytest
from conftest import SF, assert_same

from quarrystone.operators import diagnostics, harvest
from quarrystone.plans import catalogue
from quarrystone.plans import diagnosed_tables as D
from quarrystone.sources import notes


@pytest.mark.parametrize("name", [n for n, f in catalogue.QUERIES.items() if f.__module__ == D.__name__])
def test_diagnosed_queries(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    assert df.count() > 0
    assert_same(df, duck.sql(catalogue.ORACLES[name]))


def _errors(spark, text, kind="pli"):
    files = spark.createDataFrame([("f", kind, text)], "filename string, file_type string, text string")
    return [(r["error_type"], r["message"], r["line"], r["content"]) for r in diagnostics.parse_errors(files, kinds=[kind]).orderBy("line").collect()]


def test_statements_of_pli(spark):
    assert _errors(spark, "*PROCESS X;\nP: PROC OPTIONS(MAIN);\n %DCL A; A(I, F(G(1))).B = 1; P -> Q, R ||= 'a;b';\n a: b: if x then do; end;\nEND;") == []
    said = ("unrecognized", "No statement recognised")
    assert _errors(spark, "A = 1;\nWHAT 'X = 1;'\n /* c;\n d */ IS\n\nTHIS;\nB = 2; DECLARED X;") == [(*said, 2, "WHAT 'X = 1;'"), (*said, 4, "d */ IS"), (*said, 6, "THIS;")]
    assert _errors(spark, "CALL A") == [(*said, 1, "CALL A")]
    assert _errors(spark, "X = 'a/*b'; /**/ /*/ Y;") == [("warning", "comment without an end", 1, None)]
    assert _errors(spark, "") == _errors(spark, " \n\t") == _errors(spark, "/* only */") == []
    assert _errors(spark, None) == [("fatal", "not decoded", None, None)]
    assert _errors(spark, "WORD " * 100 + ";") == [(*said, 1, ("WORD " * 100)[:100])]


def test_long_texts_of_pli(spark):
    long = "A = '" + "x;" * 200_000 + "';\n" + "B" * 300_000 + " = C" + "(1)" * 3 + ";\n" + "X = Y + 'q' + /* c */ 1\n" * 20_000 + ";\nODD ONE;\n"
    assert _errors(spark, long) == [("unrecognized", "No statement recognised", 20_004, "ODD ONE;")]


def test_types_with_a_status_only(spark):
    for kind in ("inc", "dclgen", "rexx", "ca7"):
        assert _errors(spark, "anything ;", kind) == _errors(spark, "", kind) == []
        assert _errors(spark, None, kind) == [("fatal", "not decoded", None, None)]
    assert _errors(spark, " ", "copybook") == [("warning", "File is empty", None, None)]
    assert _errors(spark, "", "cobol") == [("fatal", "empty file", None, None)]
    assert _errors(spark, "x\r\n", "ctl") == [("unrecognized", "Nothing recognised", 1, "x")]


def test_introduction_of_odd_summaries(spark):
    rows = [(1, None, 3), (2, "[]", 0), (3, '{"executive_narrative": " \\n ", "business_purpose": "", "key_business_processes": [1]}', 2), (4, '{"glossary": [' + ",".join(f'{{"term": "t{i}"}}' for i in range(40)) + "]}", None)]
    out = harvest.introduction(spark.createDataFrame(rows, "project int, body string, n_modules int")).collect()
    got = {k: [(r["section"], r["position"], r["heading"], r["text"]) for r in out if r["project"] == k] for k in range(1, 5)}
    lacking = lambda n: [("overview", 1, None, harvest.NO_OVERVIEW), ("purpose", 1, None, harvest.NO_PURPOSE), ("processes", 1, None, str(n).join(harvest.NO_PROCESSES))]
    assert got[1] == lacking(3) and got[2] == lacking(0)
    assert got[3] == [("purpose", 1, None, ""), ("processes", 1, None, harvest.PROCESS_LEAD)]
    assert [r for r in got[4] if r[0] == "glossary"] == [("glossary", i + 1, f"t{i}", "") for i in range(30)]


def test_guides(spark, tmp_path):
    (tmp_path / "style.md").write_text("# Näme\nit\n", encoding="utf-8")
    (tmp_path / "blank.md").write_text("")
    read = lambda name, **more: [r["content"] for r in notes.guide(spark, str(tmp_path), name, "none", **more).collect()]
    assert read("style.md", title="Style") == ["=== Style ===\n\n# Näme\nit\n"] and read("style.md", empty="blank") == ["# Näme\nit\n"]
    assert read("blank.md", empty="blank") == ["blank"] and read("blank.md") == [""] and read("other.md", empty="blank") == ["none"]
