"""Queries over answers, PL/I programs, parameter members, schedules and declarations that Spark writes from the given tables.

Which clauses a text has follows from its row, and the SQL counterparts derive the expected rows from the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.operators import graph, mainframe, sections, vectors
from quarrystone.plans.catalogue import query, table
from quarrystone.plans.generated_tables import _ITEMS, _filled, _of_orders, jobs, modules
from quarrystone.sources import projects, results

# ---- Answers of a summariser -----------------------------------------------


def answers(spark: SparkSession, d: str) -> DataFrame:
    """An answer on each order: items, lists that open, and lines that go on where the purpose is still open."""
    values = {"n": "l_linenumber", "part": "l_partkey", "supp": "l_suppkey"}
    block = (
        F.when(F.col("l_returnflag") == "A", _filled("  - item {part}\n\n", **values))
        .when(F.col("l_returnflag") == "R", _filled("NOTES:\n- note {supp}\n", **values))
        .when(F.col("l_quantity") > 25, _filled("goes on {n}\nbut not:\n", **values))
        .otherwise(_filled("Table Name: T{n}\nKey Fields:\n\t- field {part}\nlost\n", **values))
    )
    head = F.concat(_filled("Lost line\n- lost item\nPurpose: Order {key}\n", key="o_orderkey"), F.when(F.col("o_orderstatus") == "F", F.lit("Functionalities:\n")).when(F.col("o_orderstatus") == "P", F.lit("Entity: ORDER: main\n")).otherwise(F.lit("")))
    return _of_orders(spark, d, head, block, F.lit(""))


_ANSWERS = _ITEMS + """,
k AS (
  SELECT l_orderkey AS o, o_orderstatus AS st, l_linenumber AS n, l_partkey AS part, l_suppkey AS supp,
         CASE WHEN l_returnflag IN ('A', 'R') THEN l_returnflag WHEN l_quantity > 25 THEN 'C' ELSE 'K' END AS kind FROM i),
s AS (
  SELECT *, coalesce(last_value(CASE kind WHEN 'R' THEN 'notes' WHEN 'K' THEN 'key_fields' END IGNORE NULLS) OVER (PARTITION BY o ORDER BY n),
                     CASE st WHEN 'F' THEN 'functionalities' WHEN 'P' THEN 'entity' ELSE 'purpose' END) AS open FROM k),
p AS (
  SELECT o, st, n, kind, CASE WHEN kind = 'A' AND open NOT IN ('purpose', 'entity') THEN open WHEN kind = 'R' THEN 'notes' WHEN kind = 'K' THEN 'key_fields' WHEN kind = 'C' AND open = 'purpose' THEN 'purpose' END AS field,
         CASE kind WHEN 'A' THEN 'item ' || part WHEN 'R' THEN 'note ' || supp WHEN 'K' THEN 'field ' || part ELSE ' goes on ' || n END AS part FROM s)
"""


@query(
    "summary_sections",
    _ANSWERS + """
    SELECT 'O' || o AS filename, 'Order ' || o || coalesce(string_agg(CASE WHEN field = 'purpose' THEN part END, '' ORDER BY n), '') AS purpose, CASE WHEN any_value(st) = 'P' THEN 'ORDER: main' ELSE '' END AS entity,
           coalesce('T' || max(CASE WHEN kind = 'K' THEN n END), '') AS table_name, coalesce(string_agg(CASE WHEN field = 'functionalities' THEN part END, '|' ORDER BY n), '') AS functionalities,
           coalesce(string_agg(CASE WHEN field = 'notes' THEN part END, '|' ORDER BY n), '') AS notes, coalesce(string_agg(CASE WHEN field = 'key_fields' THEN part END, '|' ORDER BY n), '') AS key_fields
    FROM p GROUP BY o
    """,
)
def summary_sections(spark: SparkSession, d: str) -> DataFrame:
    lists = ("functionalities", "notes", "key_fields")
    return sections.sections(answers(spark, d)).select("filename", "purpose", "entity", "table_name", *(F.array_join(c, "|").alias(c) for c in lists))


@query(
    "fenced_json",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS priority, CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey END AS customer, CASE WHEN o_orderkey % 5 = 0 THEN 'no JSON' END AS error FROM orders",
)
def fenced_json(spark: SparkSession, d: str) -> DataFrame:
    """Answers that are bare, fenced, of an open fence, with a language or without, or cut short."""
    body = _filled('{"priority": "{p}", "customer": {c}', p="o_orderpriority", c="o_custkey")
    kind = F.col("o_orderkey") % 5
    text = F.when(kind == 0, F.concat(F.lit("```json\n"), body)).when(kind == 1, F.concat(F.lit("```json\n"), body, F.lit("}\n```\n"))).when(kind == 2, F.concat(F.lit("```\n"), body, F.lit("}"))).when(kind == 3, F.concat(F.lit("\n ```json"), body, F.lit("}```"))).otherwise(F.concat(body, F.lit("}")))
    out = sections.fenced_json(table(spark, d, "orders").select("o_orderkey", text.alias("text")), "o_orderkey")
    get = lambda path, kind: F.try_variant_get("body", path, kind)
    return out.select("o_orderkey", get("$.priority", "string").alias("priority"), get("$.customer", "long").alias("customer"), "error")


# ---- PL/I ------------------------------------------------------------------


def pli_programs(spark: SparkSession, d: str) -> DataFrame:
    own = lambda t: _filled(t, k="p_partkey", size="p_size")
    even = F.when(F.col("p_size") % 2 == 0, own("lbl: FETCH F{k};\n DCL OUT{k} FILE RECORD\n  TITLE('DD:DD{size}');\n OPEN FILE (OUT{k});\n")).otherwise(own("declare in{k} file;\n READ FILE(IN{k}) INTO(X);\n"))
    sql = F.when(F.col("p_size") > 25, own(" EXEC SQL SELECT A INTO :B\n  FROM T{size};\n EXEC SQL INCLUDE DECL{size};\n EXEC SQL INCLUDE SQLCA;\n EXEC CICS LINK PROGRAM('X');\n")).otherwise(F.lit(" CALL PLITDLI (A);\n"))
    text = F.concat(own("SUB{k}: PROC;\n END;\n/* CALL GHOST; ; */\nP{k}: PROC OPTIONS (MAIN);\n %INCLUDE LIB(I{size});\n ++INCLUDE J{k};\n X = 'a; CALL NOBODY;';\n CALL S{k};\n call S{k}(1);\n"), even, sql, F.lit("END;\n"))
    return table(spark, d, "part").select(F.concat(F.lit("L"), "p_partkey").alias("filename"), text.alias("text"))


_PARTS = "WITH m AS (SELECT 'L' || p_partkey AS filename, p_partkey AS k, p_size AS size FROM part) "


@query("generated_pli_programs", _PARTS + "SELECT filename, 'P' || k AS program FROM m")
def generated_pli_programs(spark: SparkSession, d: str) -> DataFrame:
    return mainframe.pli(pli_programs(spark, d))["programs"]


@query("generated_pli_calls", _PARTS + "SELECT filename, 'S' || k AS target, 'static' AS call_type FROM m UNION ALL SELECT filename, 'F' || k, 'dynamic' FROM m WHERE size % 2 = 0 UNION ALL SELECT filename, 'PLITDLI', 'ims' FROM m WHERE size <= 25")
def generated_pli_calls(spark: SparkSession, d: str) -> DataFrame:
    return mainframe.pli(pli_programs(spark, d))["program_calls"]


@query("generated_pli_includes", _PARTS + "SELECT filename, 'I' || size AS copybook FROM m UNION ALL SELECT filename, 'J' || k FROM m")
def generated_pli_includes(spark: SparkSession, d: str) -> DataFrame:
    return mainframe.pli(pli_programs(spark, d))["includes"]


@query(
    "generated_pli_files",
    _PARTS + "SELECT filename, CASE WHEN size % 2 = 0 THEN 'OUT' ELSE 'IN' END || k AS file, CASE WHEN size % 2 = 0 THEN 'OPEN' ELSE 'READ' END AS operation, CASE WHEN size % 2 = 0 THEN 'DD' || size ELSE 'IN' || k END AS dd_name FROM m",
)
def generated_pli_files(spark: SparkSession, d: str) -> DataFrame:
    out = mainframe.pli(pli_programs(spark, d))
    return out["file_io"].join(out["file_definitions"].withColumnRenamed("logical_name", "file"), ["filename", "file"], "full")


@query("generated_pli_sql", _PARTS + "SELECT filename, 'table' AS kind, 'T' || size AS name, 'READ' AS operation FROM m WHERE size > 25 UNION ALL SELECT filename, 'include', 'DECL' || size, NULL FROM m WHERE size > 25 UNION ALL SELECT filename, 'cics', 'LINK', NULL FROM m WHERE size > 25")
def generated_pli_sql(spark: SparkSession, d: str) -> DataFrame:
    out = mainframe.pli(pli_programs(spark, d))
    rows = lambda df, kind, name, op: df.select("filename", F.lit(kind).alias("kind"), F.col(name).alias("name"), op.cast("string").alias("operation"))
    return rows(out["sql_tables"], "table", "table", F.col("operation")).unionByName(rows(out["sql_includes"], "include", "member", F.lit(None))).unionByName(rows(out["cics"], "cics", "command", F.lit(None)))


# ---- Parameter members -----------------------------------------------------


def members(spark: SparkSession, d: str) -> DataFrame:
    own = lambda t: _filled(t, k="s_suppkey", nation="s_nationkey")
    rest = F.when(F.col("s_acctbal") > 5000, own(" SORT FIELDS=COPY\n")).otherwise(own("DEFINE A.B{k} DISP=OLD\n"))
    text = F.concat(own("* PGM=GHOST\nSET &SYM{k}=V{nation}\nREGION={k}M,X\n\n unit=SYSDA\nRUN PGM=P{k} FOR &SYM{k} AND &OTHER{nation}\n"), rest, own("REGION=9M\nRUN JOBNAME=J{nation},PROC=Q{k}\n"))
    return table(spark, d, "supplier").select(F.concat(F.lit("B"), "s_suppkey").alias("filename"), text.alias("text"))


_MEMBERS = "WITH m AS (SELECT 'B' || s_suppkey AS filename, s_suppkey AS k, s_nationkey AS nation, s_acctbal > 5000 AS sorts FROM supplier) "
_LINE = "bigint(line_no) AS line_no"


@query("generated_parmlib_parameters", _MEMBERS + "SELECT filename, 3::BIGINT AS line_no, 'REGION' AS name, k || 'M' AS value, 'MEMORY' AS category FROM m UNION ALL SELECT filename, 5, 'UNIT', 'SYSDA', 'STORAGE' FROM m")
def generated_parmlib_parameters(spark: SparkSession, d: str) -> DataFrame:
    return mainframe.parmlib(members(spark, d))["parameters"].selectExpr("filename", _LINE, "name", "value", "category")


@query("generated_parmlib_symbols", _MEMBERS + "SELECT filename, 2::BIGINT AS line_no, 'SYM' || k AS name, 'V' || nation AS value, 'GLOBAL' AS scope FROM m UNION ALL SELECT filename, 6, 'OTHER' || nation, NULL, 'REFERENCE' FROM m")
def generated_parmlib_symbols(spark: SparkSession, d: str) -> DataFrame:
    return mainframe.parmlib(members(spark, d))["symbols"].selectExpr("filename", _LINE, "name", "value", "scope")


@query("generated_parmlib_programs", _MEMBERS + "SELECT filename, 6::BIGINT AS line_no, 'P' || k AS program, 'EXECUTION' AS purpose FROM m UNION ALL SELECT filename, 7, 'SORT', 'UTILITY' FROM m WHERE sorts")
def generated_parmlib_programs(spark: SparkSession, d: str) -> DataFrame:
    return mainframe.parmlib(members(spark, d))["programs"].selectExpr("filename", _LINE, "program", "purpose")


@query("generated_parmlib_datasets", _MEMBERS + "SELECT filename, 7::BIGINT AS line_no, 'A.B' || k AS dataset, 'UNKNOWN' AS kind, 'OLD' AS disposition FROM m WHERE NOT sorts")
def generated_parmlib_datasets(spark: SparkSession, d: str) -> DataFrame:
    return mainframe.parmlib(members(spark, d))["datasets"].selectExpr("filename", _LINE, "dataset", "kind", "disposition")


@query(
    "generated_parmlib_references",
    _MEMBERS + "SELECT filename, 'J' || nation AS name, 'JOB_REFERENCE' AS usage FROM m UNION ALL SELECT filename, 'Q' || k, 'PROC_REFERENCE' FROM m UNION ALL SELECT filename, CASE WHEN sorts THEN 'SORT' ELSE 'IDCAMS' END, 'UTILITY' FROM m",
)
def generated_parmlib_references(spark: SparkSession, d: str) -> DataFrame:
    out = mainframe.parmlib(members(spark, d))
    return out["references"].select("filename", "name", "usage").unionByName(out["utilities"].select("filename", F.col("utility").alias("name"), F.lit("UTILITY").alias("usage")))


# ---- Schedules -------------------------------------------------------------


def schedules(spark: SparkSession, d: str) -> DataFrame:
    """A schedule of each nation; its jobs are customers, some with a block of their own that names no job."""
    own = lambda t: _filled(t, k="c_custkey", nation="c_nationkey", segment="c_mktsegment")
    before = F.when(F.col("c_custkey") > 1, F.concat(F.lit("   DEP-JOB: JB"), (F.col("c_custkey") - 1).cast("string"), F.lit("\n   DEP-JOB: JB"), (F.col("c_custkey") - 1).cast("string"), F.lit("\n"))).otherwise(F.lit(""))
    block = F.concat(own(" JOB: JB{k}  ENTRY\n  SYSTEM: S{segment} SCHID: {nation}\n"), before, own("  DSN: D.S{nation}\n"), F.when(F.col("c_acctbal") > 0, F.lit("  USR-REQ: OPER\n")).otherwise(F.lit(" JOB: WILD*\n   DEP-JOB: NEVER\n")))
    body = table(spark, d, "customer").select("c_nationkey", "c_custkey", block.alias("b")).groupBy("c_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "b"))), lambda x: x["b"]), "").alias("text"))
    return body.select(F.concat(F.lit("N"), "c_nationkey").alias("filename"), "text")


@query("generated_schedule_jobs", "SELECT 'JB' || c_custkey AS job, 'S' || c_mktsegment AS system, c_nationkey::VARCHAR AS schid FROM customer")
def generated_schedule_jobs(spark: SparkSession, d: str) -> DataFrame:
    return mainframe.schedule(schedules(spark, d))["jobs"]


@query(
    "generated_schedule_triggers",
    "SELECT 'job' AS kind, 'JB' || (c_custkey - 1) AS source, 'JB' || c_custkey AS job FROM customer WHERE c_custkey > 1 UNION ALL SELECT 'dataset', 'D.S' || c_nationkey, 'JB' || c_custkey FROM customer UNION ALL SELECT 'user', 'OPER', 'JB' || c_custkey FROM customer WHERE c_acctbal > 0",
)
def generated_schedule_triggers(spark: SparkSession, d: str) -> DataFrame:
    out = mainframe.schedule(schedules(spark, d))
    rows = lambda name, kind, source: out[name].select(F.lit(kind).alias("kind"), F.col(source).alias("source"), "job")
    return rows("job_flow", "job", "before").unionByName(rows("dataset_triggers", "dataset", "dataset")).unionByName(rows("user_requirements", "user", "requirement"))


# ---- Table declarations ----------------------------------------------------


def declarations(spark: SparkSession, d: str) -> DataFrame:
    own = lambda t: _filled(t, k="p_partkey", size="p_size")
    price = F.when(F.col("p_size") % 2 == 0, own("  D DECIMAL(9, 2)\n")).otherwise(own("  D TIMESTAMP NOT NULL WITH DEFAULT\n"))
    text = F.concat(own("     EXEC SQL DECLARE S.T{k} TABLE\n     ( C{size} CHAR({size}) NOT NULL,\n  n INTEGER,\n"), price, F.lit("     ) END-EXEC.\n"))
    return table(spark, d, "part").select(F.concat(F.lit("D"), "p_partkey").alias("filename"), text.alias("text"))


@query(
    "generated_declarations",
    """
    SELECT 'D' || p_partkey AS filename, 'S.T' || p_partkey AS "table", 0::BIGINT AS position, 'C' || p_size AS "column", 'CHAR(' || p_size || ')' AS type, false AS nullable, 'string' AS host_type FROM part
    UNION ALL SELECT 'D' || p_partkey, 'S.T' || p_partkey, 1, 'N', 'INTEGER', true, 'int?' FROM part
    UNION ALL SELECT 'D' || p_partkey, 'S.T' || p_partkey, 2, 'D', CASE WHEN p_size % 2 = 0 THEN 'DECIMAL(9,2)' ELSE 'TIMESTAMP' END, p_size % 2 = 0, CASE WHEN p_size % 2 = 0 THEN 'decimal?' ELSE 'DateTime' END FROM part
    """,
)
def generated_declarations(spark: SparkSession, d: str) -> DataFrame:
    return mainframe.table_declarations(declarations(spark, d)).withColumn("position", F.col("position").cast("long"))


# ---- Results as JSON, status -----------------------------------------------


@query(
    "results_of_modules",
    """
    WITH m AS (SELECT p_partkey AS k, p_size AS size, (CASE WHEN p_size % 2 = 0 THEN 4 ELSE 3 END)::BIGINT AS f FROM part)
    SELECT 'A' || k AS filename, '{"externals":[' || list_reduce(list_transform(['A', 'B', 'C', 'D'], lambda x: '{"name":"' || x || k || '","kind":"EXTRN","line":' || f || '}'), lambda a, b: a || ',' || b)
      || '],"db2_access":[' || CASE WHEN size > 25 THEN '{"type":"CALL DSNHLI","line":' || (f + 7) || '}' ELSE '' END
      || '],"program_calls":[{"target":"SUB' || size || '","line":' || (f + 7 + (size > 25)::INT) || '}]}' AS result FROM m
    """,
)
def results_of_modules(spark: SparkSession, d: str) -> DataFrame:
    """The joined result of every assembler module as JSON."""
    own = modules(spark, d)
    out = mainframe.assembler(own)
    named = {n: out[n] for n in ("externals", "db2_access", "program_calls")}
    return results.results(own, {n: r.select("filename", *(c for c in r.columns if c not in ("filename", "line")), "line") for n, r in named.items()})


@query(
    "output_status",
    """
    WITH o AS (SELECT DISTINCT o_custkey, o_orderstatus AS s FROM orders WHERE o_orderstatus IN ('F', 'O')),
    n AS (SELECT c_custkey AS project_id, count(s) AS n, coalesce(string_agg(s, ' ' ORDER BY s), '') AS outputs FROM customer LEFT JOIN o ON o_custkey = c_custkey GROUP BY ALL)
    SELECT project_id, CASE WHEN n = 2 THEN 'COMPLETED' ELSE 'PROCESSING' END AS status, CASE WHEN n = 2 THEN 100.0 ELSE 0.0 END::DOUBLE AS progress, outputs FROM n
    """,
)
def output_status(spark: SparkSession, d: str) -> DataFrame:
    """Customers as projects, with the kinds of orders that they have as outputs."""
    outputs = table(spark, d, "orders").select(F.col("o_custkey").alias("project_id"), F.col("o_orderstatus").alias("output"))
    out = projects.output_status(table(spark, d, "customer").select(F.col("c_custkey").alias("project_id")), outputs, ("F", "O"))
    return out.withColumn("outputs", F.array_join("outputs", " "))


# ---- Graphs ----------------------------------------------------------------


@query(
    "job_dependencies",
    _ITEMS + """
    , e AS (SELECT DISTINCT 'J' || l_orderkey AS source, CASE WHEN l_returnflag = 'A' THEN 'P' ELSE 'PROC' END || l_suppkey AS target, CASE WHEN l_returnflag = 'A' THEN 'EXEC_PGM' ELSE 'EXEC_PROC' END AS relationship FROM i)
    SELECT * FROM e ORDER BY source, target, relationship LIMIT 20
    """,
)
def job_dependencies(spark: SparkSession, d: str) -> DataFrame:
    return graph.job_dependencies(graph.edges_of({"jcl": mainframe.jcl(jobs(spark, d))}))


@query(
    "graph_reachable",
    """
    WITH RECURSIVE e AS (
      SELECT 'R' || n_regionkey AS src, 'N' || n_nationkey AS dst FROM nation UNION SELECT 'N' || c_nationkey, 'C' || c_custkey FROM customer UNION SELECT 'C' || o_custkey, 'O' || o_orderkey FROM orders
      UNION SELECT 'O' || l_orderkey, 'S' || l_suppkey FROM lineitem UNION SELECT 'S' || s_suppkey, 'N' || s_nationkey FROM supplier),
    r AS (SELECT 'R1' AS node, 0 AS distance UNION SELECT dst, distance + 1 FROM r JOIN e ON src = node WHERE distance < 7)
    SELECT node, min(distance) AS distance FROM r GROUP BY node
    """,
)
def graph_reachable(spark: SparkSession, d: str) -> DataFrame:
    """All that follows from a region: nations, customers, orders, suppliers, their nations, and so on, round the circle."""
    edge = lambda t, a, src, b, dst: table(spark, d, t).select(F.concat(F.lit(a), src).alias("src"), F.concat(F.lit(b), dst).alias("dst")).distinct()
    edges = edge("nation", "R", "n_regionkey", "N", "n_nationkey").unionByName(edge("customer", "N", "c_nationkey", "C", "c_custkey")).unionByName(edge("orders", "C", "o_custkey", "O", "o_orderkey"))
    edges = edges.unionByName(edge("lineitem", "O", "l_orderkey", "S", "l_suppkey")).unionByName(edge("supplier", "S", "s_suppkey", "N", "s_nationkey"))
    start = table(spark, d, "region").where("r_regionkey = 1").select(F.concat(F.lit("R"), "r_regionkey").alias("node"))
    return graph.reachable(edges, start, 7)


# ---- Questions -------------------------------------------------------------


def _asked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    own = table(spark, d, "embeddings")
    return own, own.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")


_WITHIN = """
    WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_distance(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 4) AS distance FROM embeddings q JOIN embeddings v ON v.label = q.label WHERE q.vec_id % 20 = 0),
    r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM s) WHERE rank <= 4)
"""


@query("vector_topk_within", _WITHIN + "SELECT * FROM r")
def vector_topk_within(spark: SparkSession, d: str) -> DataFrame:
    """Every twentieth row asks the rows of its own label only."""
    own, asked = _asked(spark, d)
    return vectors.nearest_of_each(own, asked, 4, within="label")


@query(
    "rag_contexts",
    _WITHIN + "SELECT query_id, string_agg(text, chr(10) || chr(10) ORDER BY distance, vec_id) AS context, string_agg(left(text, 200), chr(1) ORDER BY distance, vec_id) AS previews FROM r JOIN documents ON doc_id = vec_id WHERE text IS NOT NULL GROUP BY query_id",
)
def rag_contexts(spark: SparkSession, d: str) -> DataFrame:
    """The context of each question: the texts of its nearest rows of one label."""
    own, asked = _asked(spark, d)
    hits = vectors.nearest_of_each(own, asked, 4, within="label")
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    found = hits.withColumnRenamed("vec_id", "id").join(texts, "id")
    return vectors.contexts(found, by="query_id").withColumn("previews", F.array_join("previews", "\u0001"))
