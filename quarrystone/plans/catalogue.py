"""Registered queries of the engine's own operators, with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under a name, with its SQL counterpart where there is one."""

    def add(f):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LINKS = r'href="(https?://[^"]*|/[^"]*)"'


@query(
    "link_edges_topk",
    """
    WITH links AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="(https?://[^"]*|/[^"]*)"', 1)) AS target FROM pages)
    SELECT target, count(*) AS in_degree FROM links GROUP BY target ORDER BY in_degree DESC, target LIMIT 10
    """,
)
def link_edges_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    links = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(LINKS), 1)).alias("target")).distinct()
    return links.groupBy("target").agg(F.count("*").alias("in_degree")).orderBy(F.desc("in_degree"), "target").limit(10)
