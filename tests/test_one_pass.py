"""Relations that are taken together are found in one pass over their texts, and links are composed once."""

from pyspark.sql import functions as F

from quarrystone.operators import diagnostics, graph, mainframe, source_chunks, statements


def _passes(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Range (")


def _files(spark, text):
    return spark.range(2).select(F.concat(F.lit("f"), "id").alias("filename"), F.lit(text).alias("text"))


def test_programs_are_read_once(spark):
    text = "       PROGRAM-ID. P.\n           MOVE 'A' TO V.\n           CALL V.\n           CALL W.\n           CALL 'X'.\n           EXEC SQL SELECT A FROM T JOIN U END-EXEC.\n           JSON PARSE S INTO R.\n"
    out = mainframe.cobol(_files(spark, text))
    assert _passes(out["program_calls"]) == _passes(out["unresolved_calls"]) == _passes(out["sql_tables"]) == 1
    assert sorted(tuple(r) for r in out["program_calls"].select("target", "call_type", "line").collect()) == [("A", "dynamic", 3)] * 2 + [("X", "static", 5)] * 2
    assert {tuple(r) for r in out["unresolved_calls"].select("variable", "line").collect()} == {("W", 4)}
    assert {tuple(r) for r in out["sql_tables"].select("table", "operation").collect()} == {("T", "READ"), ("U", "READ")}
    assert _passes(statements.cobol_statements(_files(spark, text))["json"]) == 1


def test_edges_need_one_aggregate(spark):
    rows = spark.range(3).select(F.lit("a").alias("s"), F.lit("b").alias("t"))
    edges = graph.edges_from({"CALL": (rows, "s", "t", ""), "INCLUDE": (rows, "s", "t", "")})
    assert {tuple(r) for r in edges.select("src", "dst", "type", "weight").collect()} == {("A", "B", "INCLUDE", 1)}
    plan = edges._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("Aggregate") == 1


def test_links_are_composed_once(spark):
    seen = spark.sparkContext.accumulator(0)
    told = F.udf(lambda x: seen.add(1) or x, "string")
    edges = spark.createDataFrame([(str(i), str(i + 1)) for i in range(6)], "src string, dst string").select("src", told("dst").alias("dst"))
    assert graph.reachable(edges, spark.createDataFrame([("0",)], "node string"), 6).count() == 7
    assert seen.value < 20


def test_jobs_are_read_once(spark):
    text = "//J JOB 1\n//S1 EXEC PGM=A,REGION=0M\n//S2 EXEC B\n//S3 EXEC\n"
    out = mainframe.jcl(_files(spark, text))["calls"]
    assert _passes(out) == 1
    assert {tuple(r) for r in out.collect()} == {("J", "S1", "A", None), ("J", "S2", None, "B")}


def test_edges_of_jobs_are_read_once(spark):
    text = "//J JOB 1\n//S1 EXEC PGM=A,\n//   REGION=0M\n//D DD DSN=X.Y,DISP=(NEW,\n// CATLG)\n//K JOB 2\n//E DD DSN=X.Z\n// EXEC B\n"
    jobs = mainframe.jcl(_files(spark, text))
    edges = graph.edges_of({"jcl": jobs})
    assert _passes(edges) == 1
    assert {tuple(r) for r in edges.select("src", "dst", "type").collect()} == {("J", "A", "EXEC_PGM"), ("J", "FILE:X.Y", "WRITE_FILE"), ("K", "FILE:X.Z", "READ_FILE"), ("K", "B", "EXEC_PROC")}
    plan = jobs["include_groups"]._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Aggregate" not in plan
    kept = mainframe.jcl_statements(_files(spark, text)).where("filename = 'f0'").orderBy("line_no").select("job", "step", "line_no").collect()
    assert [tuple(r) for r in kept] == [("J", None, 1), ("J", "S1", 2), ("J", "S1", 4), ("K", "S1", 6), ("K", "S1", 7), ("K", "S1", 8)]


def test_statements_of_modules_cut_a_text_once(spark):
    plan = mainframe.assembler_statements(_files(spark, "A CSECT\n").withColumn("text", F.concat("text", "filename")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(text") <= 4  # none of them within a line


def test_diagnostics_read_each_text_once(spark):
    texts = {"cobol": "       PROGRAM-ID. P.\n           WOBBLE IT.\n", "jcl": "//J JOB\n//X NOPE\n//D DD A\n", "assembly": "A CSECT\n 9+\n", "pli": " FROB IT;\n X = 'open\n", "ctl": "plain words\n"}
    for kind, text in texts.items():
        files = _files(spark, text).withColumn("file_type", F.lit(kind))
        errors = diagnostics.parse_errors(files, kinds=[kind])
        assert _passes(errors) == 1 and "Window" not in errors._jdf.queryExecution().optimizedPlan().toString()
        want = diagnostics.parse_summary(diagnostics.parse_results(files, errors), errors).collect()
        assert diagnostics.summary_of(files, errors).collect() == want and want[0]["unrecognized"] == 2 * (2 if kind == "pli" else 1)


def test_chunks_are_cut_in_one_pass(spark):
    cobol = "note\n IDENTIFICATION DIVISION.\n PROCEDURE DIVISION.\n GO.\n     STOP RUN.\n\n EXIT.\n"
    members = {"a": "x\n* CATALOG\nA=1\n", "b": "A=1\nB=2\n\n\nC=3\n", "c": "plain\n", "d": "  "}
    files = _files(spark, cobol)
    out = source_chunks.cobol(files)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert _passes(out) == 1 and "Window" not in plan and "Join" not in plan
    own = [tuple(r) for r in out.where("filename = 'f0'").orderBy("chunk").select("chunk", "kind", "name", "start_line", "end_line").collect()]
    assert own == [(0, "header", "HEADER", 1, 1), (1, "division", "IDENTIFICATION", 2, 2), (2, "division_header", "PROCEDURE", 3, 3), (3, "paragraph", "GO", 4, 8)]
    got = source_chunks.parameters(spark.createDataFrame(list(members.items()), "filename string, text string")).orderBy("filename", "chunk").select("filename", "chunk", "kind", "name", "start_line", "end_line").collect()
    assert [tuple(r) for r in got] == [("a", 0, "header", "HEADER", 1, 1), ("a", 1, "parameter_group", "CATALOG", 2, 4), ("b", 0, "parameter_group", "A, B", 1, 3), ("b", 1, "parameter_group", "C", 4, 6), ("c", 0, "whole", "c", 1, 2)]
