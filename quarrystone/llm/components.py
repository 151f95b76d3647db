"""Connected components of an edge table, without collecting any group.

Alternating star contractions: every node hands its larger neighbours to the
smallest node it knows, then every node attaches itself and its smaller
neighbours to the smallest of them.  The edges end as stars around the smallest
node of each component after a number of rounds that is logarithmic in practice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.llm.tables import cut_lineage

MOST_ROUNDS = 60


def _star(pairs: DataFrame, small: bool) -> DataFrame:
    """One contraction over (a, b): each a's neighbours b are attached to the least of them and a."""
    least = pairs.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    joined = pairs.join(least, "a")
    moved = joined.select(F.when(F.lit(small) | (F.col("b") > F.col("a")), F.col("b")).alias("x"), "m").where("x is not null")
    if small:
        moved = moved.unionByName(least.select(F.col("a").alias("x"), "m"))
    return moved.where("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b")).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node reachable, for every node with an edge to another one."""
    now = cut_lineage(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct())
    before = None
    for _ in range(MOST_ROUNDS):
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == before or mark["n"] == 0:
            break
        before = mark
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _star(both, small=False)
        oriented = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        now = cut_lineage(_star(oriented, small=True))
    else:
        raise RuntimeError("the components didn't settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
