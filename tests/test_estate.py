from quarrystone.operators import estate, vectors
from quarrystone.sources import projects

REPORT = "# Title\n**Functionalities**:\n- a\n- b\n**Other**\n- c\n### F001: x\n### F02: y\n### PAY.cbl\n**Implemented By**: A, B ,A\n**Implemented By**: C\n"


def test_reports(spark):
    reports = spark.createDataFrame([("r", REPORT), ("n", None)], "name string, text string")
    assert {r["name"]: r["bullets"] for r in estate.bullets_under(reports, "**Functionalities**").collect()} == {"r": 2}
    assert {r["name"]: r["entries"] for r in estate.numbered_entries(reports).collect()} == {"r": 2, "n": 0}
    assert [r["filename"] for r in estate.files_in_headings(reports).collect()] == ["PAY.cbl"]
    assert {r["program"] for r in estate.implementers(reports).collect()} == {"A", "B", "C"}
    assert [r["level"] for r in estate.section_titles(reports).orderBy("line_no").collect()] == [1, 3, 3, 3]


def test_landscape(spark):
    rows = [("a", "COBOL", "reads VSAM, EXEC SQL, CICS"), ("b", "JCL", None), ("c", "PARMLIB", "idcams"), ("d", "REXX", "ftp")]
    found = {r["layer"]: r["components"] for r in estate.landscape(spark.createDataFrame(rows, "filename string, file_type string, analysis string")).collect()}
    assert found["Operating System"] == "IBM z/OS (Confirmed via Utility Control Cards)" and found["Programming Languages"] == "COBOL, JCL, REXX"
    assert found["Data Persistence"] == "IBM DB2 (Relational), VSAM (KSDS/ESDS, 1 modules)"
    assert found["Execution Environment"] == "CICS Transaction Server (1 modules), Batch Processing (JES, 1 jobs), TSO/E Interactive (1 scripts)"
    assert found["Integration & Middleware"] == "File Transfer (FTP/Connect:Direct)"
    empty = estate.landscape(spark.createDataFrame([], "filename string, file_type string, analysis string"))
    assert {r["components"] for r in empty.collect()} >= {"Unknown Environment", "Flat Files / Sequential"}


def test_coverage_of_nothing(spark):
    none = spark.createDataFrame([], "k string")
    assert tuple(estate.coverage(none, none, "k").first()) == (0, 0, 100.0)


def test_described(spark):
    steps = spark.createDataFrame([("J", "S2", "writes PROD.PAY.RPT"), ("J", "S1", "sorts prod.pay.rpt, then PROD.X.Y.")], "job string, step string, description string")
    sets = spark.createDataFrame([("PROD.PAY.RPT",), ("PROD.NONE",)], "dataset string")
    assert {r["dataset"]: r["step"] for r in estate.described(steps, sets).collect()} == {"PROD.PAY.RPT": "S1", "PROD.NONE": None}


def test_projects(spark):
    empty = spark.createDataFrame([], "project_id string, name string, description string, created_at timestamp, statuses map<string,string>")
    new = spark.createDataFrame([("p", "one", None), ("q", "two", "d")], "project_id string, name string, description string")
    made = projects.created(empty, new, ("parsing", "index"))
    assert projects.created(made, new).count() == 2
    changed = projects.updated(made, spark.createDataFrame([("p", None, "text"), ("x", "y", "z")], "project_id string, name string, description string"))
    assert {(r["name"], r["description"]) for r in changed.collect()} == {("one", "text"), ("two", "d")}
    done = projects.with_status(made, spark.createDataFrame([("p", "parsing", "done")], "project_id string, step string, status string"))
    assert {r["project_id"]: r["statuses"] for r in done.collect()} == {"p": {"parsing": "done", "index": "pending"}, "q": {"parsing": "pending", "index": "pending"}}
    files = spark.createDataFrame([("p", "jcl", "a"), ("q", "jcl", "b")], "project_id string, file_type string, filename string")
    left, rest = projects.deleted(made, files, new.where("project_id = 'p'"))
    assert [r["project_id"] for r in left.collect()] == ["q"] and [r["filename"] for r in rest.collect()] == ["b"]
    assert projects.without_files(files, files.where("filename = 'b'")).count() == 1


def test_accepted_batches(spark):
    rows = [("p", 1, "jcl", "a", 10), ("p", 1, "jcl", "b", 10), ("p", 2, "jcl", "a", 10), ("p", 2, "odd", "b", 10), ("p", 3, "jcl", "a", 3 << 20), ("p", 4, None, "a", 1)]
    uploads = spark.createDataFrame(rows, "project_id string, batch int, file_type string, filename string, size long")
    assert {r["batch"] for r in projects.accepted(uploads, ("jcl", "cobol")).collect()} == {1}


def test_index(spark, tmp_path):
    from pyspark.sql import functions as F

    rows = [(1, [0.0, 1.0], "x" * 300, "/d/cobol/a.cbl"), (2, [1.0, 0.0], "two", "/d/b.md"), (3, [0.0, 0.9], "three", "/else/c")]
    chunks = spark.createDataFrame(rows, "id long, embedding array<float>, text string, path string").withColumn("source_folder", vectors.source_folder(F.col("path"), "/d/"))
    path = str(tmp_path / "index")
    vectors.write_index(chunks.where("id < 3"), path)
    vectors.write_index(chunks.where("id = 3"), path, add=True)
    index = vectors.load_index(spark, path)
    assert {r["source_folder"]: r["chunks"] for r in vectors.index_status(index).collect()} == {"cobol": 1, "root": 1, "unknown": 1}
    assert [r["id"] for r in vectors.load_index(spark, path, "cobol").collect()] == [1]
    hits = vectors.nearest(index, F.array(F.lit(0.0), F.lit(1.0)), 2, key="id")
    one = vectors.contexts(hits).first()
    assert one["context"] == "x" * 300 + "\n\nthree" and one["previews"] == ["x" * 200, "three"]
