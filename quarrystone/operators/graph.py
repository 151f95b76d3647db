"""Dependency graphs as edge tables: building, degrees, ranking, scoring, contexts and subgraphs.

Edges are rows (src, dst, type, weight, seq).  All operators are joins and
aggregates on them, so a graph of any size stays distributed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.sources.shared import use_checkpoints

# How much each kind of edge weighs; the kinds of edges that data accesses, execution and structure are.
EDGE_WEIGHTS = {"CALL": 3, "INCLUDE": 1, "ACCESS_DB": 2, "ACCESS_FILE": 2, "SUBMIT_JOB": 4, "EXEC_PGM": 5, "EXEC_PROC": 5, "READ_FILE": 2, "WRITE_FILE": 2, "TRIGGER": 5, "EXEC_UTIL": 2, "CONFIGURES": 2}
DATA_EDGES = ("ACCESS_DB", "ACCESS_FILE", "WRITE_FILE")
JOB_EDGES = ("TRIGGER", "EXEC_PGM", "EXEC_PROC")
FLOW_EDGES = ("TRIGGER", "SUBMIT_JOB", "EXEC_PROC", "EXEC_PGM")
STRUCTURE_EDGES = ("CALL", "ACCESS_DB", "INCLUDE", "ACCESS_FILE", "READ_FILE", "WRITE_FILE")
NO_FLOW_NODES = ("FILE:", "DD:", "TABLE:", "CPY:")
DATA_NODES = ("FILE:", "DD:")


def weight_of(kind: Column, weights: Mapping[str, int] = EDGE_WEIGHTS) -> Column:
    out = F.lit(1)
    for name, weight in weights.items():
        out = F.when(kind == name, F.lit(weight)).otherwise(out)
    return out


def _edges(parts: Sequence[DataFrame]) -> DataFrame:
    """Edges of (src, dst, type, seq): names trimmed and in upper case, none blank and none to itself; of several between two nodes the last one stays."""
    every = reduce(DataFrame.unionByName, parts).withColumn("src", F.upper(F.btrim("src"))).withColumn("dst", F.upper(F.btrim("dst")))
    every = every.where("src <> '' and dst <> '' and src <> dst")
    last = every.groupBy("src", "dst").agg(F.max(F.struct("seq", "type")).alias("last"))
    return last.select("src", "dst", "last.type").withColumn("weight", weight_of(F.col("type")))


def edges_from(relations: Mapping[str, tuple[DataFrame, str, str, Column | str]]) -> DataFrame:
    """Edges of flat relations: name -> (rows, source column, target column, prefix of the target).

    A later relation's edge between the same two nodes takes the place of an earlier one's.
    """
    return _edges([
        rows.select(F.col(src).alias("src"), F.concat(F.lit(prefix) if isinstance(prefix, str) else prefix, F.col(dst)).alias("dst"), F.lit(name).alias("type"), F.lit(n).alias("seq"))
        for n, (name, (rows, src, dst, prefix)) in enumerate(relations.items())
    ])


#: Edges of parsed relations in the order in which they are laid: language, relation, source, target, kind (a value or an SQL expression), prefixes of both.
EDGE_RULES = (
    ("cobol", "program_calls", "program", "target", "'CALL'", "", ""),
    ("cobol", "copybooks", "program", "copybook", "'INCLUDE'", "", ""),
    ("cobol", "sql_tables", "program", "table", "'ACCESS_DB'", "", ""),
    ("cobol", "file_io", "program", "file", "'ACCESS_FILE'", "", "FILE:"),
    ("pli", "program_calls", "filename", "target", "'CALL'", "", ""),
    ("pli", "includes", "filename", "copybook", "'INCLUDE'", "", ""),
    ("pli", "sql_tables", "filename", "table", "'ACCESS_DB'", "", ""),
    ("pli", "file_definitions", "filename", "dd_name", "'ACCESS_FILE'", "", "DD:"),
    ("pli", "file_io", "filename", "file", "'ACCESS_FILE'", "", "FILE:"),
    ("assembler", "program_calls", "filename", "target", "'CALL'", "", ""),
    ("assembler", "copybooks", "filename", "copybook", "'INCLUDE'", "", ""),
    ("assembler", "file_io", "filename", "file", "'ACCESS_FILE'", "", "DD:"),
    ("rexx", "calls", "filename", "program", "'CALL'", "", ""),
    ("rexx", "submissions", "filename", "job", "'SUBMIT_JOB'", "", ""),
    ("rexx", "datasets", "filename", "dataset", "'ACCESS_FILE'", "", "FILE:"),
    ("jcl", "links", "job", "target", "kind", "", ""),
    ("jcl", "program_calls", "job", "program", "'EXEC_PGM'", "", ""),
    ("jcl", "proc_calls", "job", "proc", "'EXEC_PROC'", "", ""),
    ("jcl", "files", "job", "dataset", "if(mode = 'OUTPUT', 'WRITE_FILE', 'READ_FILE')", "", "FILE:"),
    ("schedule", "job_flow", "before", "job", "'TRIGGER'", "", ""),
    ("schedule", "dataset_triggers", "dataset", "job", "'TRIGGER'", "FILE:", ""),
    ("parmlib", "programs", "filename", "program", "if(purpose = 'UTILITY', 'EXEC_UTIL', 'CONFIGURES')", "", ""),
    ("copybooks", "references", "filename", "copybook", "'INCLUDE'", "", ""),
)
#: Relations that another one, where it is parsed, gives in one pass.
GIVEN_BY_LINKS = ("program_calls", "proc_calls", "files")


def edges_of(parsed: Mapping[str, Mapping[str, DataFrame]]) -> DataFrame:
    """The edges of everything parsed: language -> relation -> rows; what is missing adds none."""
    parts = []
    for n, (language, relation, src, dst, kind, before, prefix) in enumerate(EDGE_RULES):
        own = parsed.get(language, {})
        rows = None if relation in GIVEN_BY_LINKS and "links" in own else own.get(relation)
        if rows is not None:
            parts.append(rows.select(F.concat(F.lit(before), F.col(src)).alias("src"), F.concat(F.lit(prefix), F.col(dst)).alias("dst"), F.expr(kind).alias("type"), F.lit(n).alias("seq")))
    return _edges(parts)


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """node, in_degree, out_degree: one shuffle over both ends."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("x")).select("x.*")
    return ends.groupBy("node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def starts_with_any(name: Column | str, prefixes: Sequence[str]) -> Column:
    out = F.lit(False)
    for prefix in prefixes:
        out = out | F.startswith(F.col(name) if isinstance(name, str) else name, F.lit(prefix))
    return out


def top_by_in_degree(edges: DataFrame, k: int) -> DataFrame:
    """The k nodes with most edges coming in, data nodes left out."""
    return degrees(edges).where(~starts_with_any("node", DATA_NODES)).orderBy(F.desc("in_degree"), "node").limit(k)


def scores(edges: DataFrame, line_counts: DataFrame | None = None) -> DataFrame:
    """How critical each node is, data nodes (with a colon) left out: (node, score).

    Its degree, 2.5 for each edge from it to data, and 1.5 for each hundred lines of its
    source, of which at most 5000 count; ``line_counts`` is (node, lines).
    """
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.when(F.col("type").isin(*DATA_EDGES), 2.5).otherwise(0.0).alias("data")), F.struct(F.col("dst").alias("node"), F.lit(0.0).alias("data")))).alias("x")).select("x.*")
    linked = ends.where(~F.contains("node", F.lit(":"))).groupBy("node").agg((F.count("*") + F.sum("data")).alias("links"))
    if line_counts is None:
        return linked.select("node", F.col("links").alias("score"))
    sized = linked.join(line_counts, "node", "left")
    return sized.select("node", (F.col("links") + 1.5 * F.least(F.coalesce("lines", F.lit(0)) / 100.0, F.lit(50.0))).alias("score"))


def critical(edges: DataFrame, line_counts: DataFrame | None = None, k: int = 30) -> DataFrame:
    return scores(edges, line_counts).orderBy(F.desc("score"), "node").limit(k)


def view(edges: DataFrame, kinds: Sequence[str], k: int, without: Sequence[str] = ()) -> DataFrame:
    """Edges of some kinds, none at nodes with certain prefixes, between the k nodes with most of them."""
    own = edges.where(F.col("type").isin(*kinds) & ~starts_with_any("src", without) & ~starts_with_any("dst", without))
    best = degrees(own).orderBy(F.desc(F.col("in_degree") + F.col("out_degree")), "node").limit(k)
    return induced(own, best)


def outer_files(edges: DataFrame, k: int = 7) -> DataFrame:
    """Files that nothing writes, and files that nothing reads, the first k of either by name: (node, role)."""
    d = degrees(edges).where(F.startswith("node", F.lit("FILE:")))
    part = lambda c, role: d.where(c).orderBy("node").limit(k).select("node", F.lit(role).alias("role"))
    return part("in_degree = 0", "source").unionByName(part("out_degree = 0", "sink"))


def sources_and_sinks(edges: DataFrame) -> DataFrame:
    """node and role: "source" where nothing comes in, "sink" where nothing goes out."""
    d = degrees(edges).where("in_degree = 0 or out_degree = 0")
    return d.select("node", F.when(F.col("in_degree") == 0, "source").otherwise("sink").alias("role"))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes`` (column node)."""
    own = nodes.select("node").distinct()
    return edges.join(own.withColumnRenamed("node", "src"), "src", "left_semi").join(own.withColumnRenamed("node", "dst"), "dst", "left_semi")


def reachable(edges: DataFrame, start: DataFrame, steps: int) -> DataFrame:
    """node and least number of steps from ``start``, up to ``steps``; nodes that are null are none.

    The links are written to the checkpoint folder once, so no step composes them anew.
    The nodes of each step are written to the checkpoint folder before the next, so a plan
    holds one step whatever their number, and the steps end where no new node is found.
    """
    use_checkpoints(edges.sparkSession)
    links = edges.select("src", "dst").where("src is not null and dst is not null and src <> dst").checkpoint()
    levels = [start.select("node").where("node is not null").distinct().checkpoint()]
    for _ in range(steps):
        met = links.join(levels[-1].select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        new = met.join(reduce(DataFrame.unionByName, levels), "node", "left_anti").checkpoint()
        if new.isEmpty():
            break
        levels.append(new)
    return reduce(DataFrame.unionByName, [level.withColumn("distance", F.lit(n)) for n, level in enumerate(levels)])


def job_dependencies(edges: DataFrame, k: int = 20) -> DataFrame:
    """The first k edges that start something, by their names: (source, target, relationship)."""
    own = edges.where(F.col("type").isin(*JOB_EDGES)).orderBy("src", "dst", "type").limit(k)
    return own.select(F.col("src").alias("source"), F.col("dst").alias("target"), F.col("type").alias("relationship"))


def lineage(writes: DataFrame, reads: DataFrame, key: str, actor: str, order: str) -> DataFrame:
    """Who reads what another one wrote first: (key, producer, consumer); one producer for each key, the first by ``order``."""
    first = writes.groupBy(key).agg(F.min_by(actor, F.struct(order, actor)).alias("producer"))
    readers = reads.select(F.col(key), F.col(actor).alias("consumer")).distinct()
    return readers.join(first, key).where("producer <> consumer").select(key, "producer", "consumer")


def diagram_lines(edges: DataFrame, top: int) -> DataFrame:
    """Diagram source of the strongest edges, one line each, in a stated order."""
    rank = Window.orderBy(F.desc("weight"), "src", "dst")
    best = edges.orderBy(F.desc("weight"), "src", "dst").limit(top)
    return best.withColumn("line_no", F.row_number().over(rank)).select("line_no", F.concat("src", F.lit(" -->|"), "type", F.lit("| "), "dst").alias("line"))
