"""Trees of fields as nested JSON.

Fields stand in the order of their tree, so a tree is the concatenation of a piece for each
field: its own members, then either the start of its children or as many ends as the next
field lies above it.  No node is ever joined to its children.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.operators.statements import LEVELS


def with_depth(fields: DataFrame, key: str = "filename", order: str = "position", level: str = "level") -> DataFrame:
    """Adds ``depth``: how many fields a field lies in, 0 for roots.

    The latest field of a level is open if none of a smaller level came after it.
    """
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    latest = F.array(*(F.struct(F.lit(n).alias("level"), F.max(F.when(F.col(level) == n, F.col(order))).over(before).alias("at")) for n in LEVELS))
    smaller = F.filter("__latest", lambda x: (x["level"] < F.col(level)) & x["at"].isNotNull())
    start = F.struct(F.lit(None).cast(dict(fields.dtypes)[order]).alias("last"), F.lit(0).alias("n"))
    is_open = lambda acc, x: acc["last"].isNull() | (x["at"] > acc["last"])
    depth = F.aggregate(smaller, start, lambda acc, x: F.struct(F.greatest(acc["last"], x["at"]).alias("last"), (acc["n"] + F.when(is_open(acc, x), 1).otherwise(0)).alias("n")))
    return fields.withColumn("__latest", latest).withColumn("depth", depth["n"]).drop("__latest")


def nested_json(fields: DataFrame, columns: Sequence[str], key: str = "filename", order: str = "position", level: str = "level", children: str = "children") -> DataFrame:
    """(key, tree): the fields of each key as a JSON array of nested objects, members that are null left out.

    ``columns`` are an object's members, at least one of them not null.  Rows of equal order within a key have no defined place.
    """
    rows = with_depth(fields, key, order, level)
    following = F.lead("depth").over(Window.partitionBy(key).orderBy(order))
    members = F.to_json(F.struct(*columns))
    inner = F.substr(members, F.lit(1), F.char_length(members) - 1)  # without its last brace
    closed = F.concat(F.lit("}"), F.repeat(F.lit("]}"), F.col("depth") - F.coalesce(F.col("following"), F.lit(0))), F.when(F.col("following").isNotNull(), F.lit(",")).otherwise(F.lit("")))
    piece = F.concat(inner, F.when(F.col("following") > F.col("depth"), F.lit(f',"{children}":[')).otherwise(closed))
    pieces = rows.withColumn("following", following).select(key, F.struct(order, piece.alias("piece")).alias("p"))
    text: Column = F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["piece"]), "")
    return pieces.groupBy(key).agg(F.concat(F.lit("["), text, F.lit("]")).alias("tree"))
