"""Queries of harvests, ordered folds and tree listings over the given tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.operators import folds, harvest
from quarrystone.plans.catalogue import query, table
from quarrystone.plans.generated_tables import _ITEMS, _filled, _of_orders
from quarrystone.sources import trees


def summaries(spark: SparkSession, d: str) -> DataFrame:
    """A summary of each order as free JSON; every fifth is broken, every seventh has a glossary that is no list."""
    values = {"n": "l_linenumber", "part": "l_partkey", "supp": "l_suppkey"}
    term = F.when(F.col("l_linenumber") % 2 == 1, _filled('{"term":"T{part}","definition":"D{supp}"}', **values)).otherwise(_filled('"note {part}"', **values))
    name = F.when(F.col("l_returnflag") == "A", "prod.rpt").when(F.col("l_returnflag") == "R", "temp.x").otherwise("prod.file")
    data = F.concat(F.lit('{"dataset":"'), name, "l_partkey", F.lit('","usage":"'), F.when(F.col("l_quantity") > 25, "old").otherwise("shr"), F.lit('"}'))
    both = F.concat(term, F.lit("\u0001"), data, F.lit("\u0002"))
    one = _of_orders(spark, d, F.lit(""), both, F.lit(""))
    parts = F.filter(F.split("text", "\u0002"), lambda x: x != "")
    joined = lambda i: F.array_join(F.transform(parts, lambda x: F.get(F.split(x, "\u0001"), F.lit(i))), ",")
    orders = table(spark, d, "orders").select(F.concat(F.lit("O"), "o_orderkey").alias("filename"), "o_orderkey", "o_orderstatus", "o_orderpriority")
    own = one.join(orders, "filename")
    glossary = F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit('{"term":"T"}'))).otherwise(F.concat(F.lit("["), joined(0), F.lit("]")))
    body = F.concat(F.lit('{"business_overview":{"scope":["Priority '), "o_orderpriority", F.lit('",'), F.lit('"Always"],"glossary":'), glossary, F.lit('},"technical_analysis":{"io_datasets":['), joined(1), F.lit("]}"), F.when(F.col("o_orderkey") % 5 == 0, F.lit("")).otherwise(F.lit("}")))
    return own.select("filename", F.when(F.col("o_orderstatus") == "P", "COBOL").otherwise("JCL").alias("file_type"), body.alias("body"))


_GOOD = _ITEMS + ", g AS (SELECT 'O' || l_orderkey AS filename, l_orderkey, l_linenumber AS n, l_partkey AS part, l_suppkey AS supp, l_returnflag AS f, l_quantity AS q, o_orderstatus AS st, o_orderpriority AS pr FROM i WHERE l_orderkey % 5 <> 0)"


@query("harvest_glossary", _GOOD + " SELECT 'T' || part AS term, arg_max('D' || supp, (filename, n)) AS definition FROM g WHERE n % 2 = 1 AND l_orderkey % 7 <> 0 GROUP BY part")
def harvest_glossary(spark: SparkSession, d: str) -> DataFrame:
    return harvest.harvest(summaries(spark, d))["glossary"]


@query("harvest_rules", _GOOD + " SELECT DISTINCT 'Priority ' || pr AS rule FROM g UNION SELECT 'Always' FROM g")
def harvest_rules(spark: SparkSession, d: str) -> DataFrame:
    return harvest.harvest(summaries(spark, d))["rules"]


@query("harvest_report_catalogue", _GOOD + " SELECT DISTINCT filename AS job, 'PROD.RPT' || part AS report FROM g WHERE st <> 'P' AND f = 'A'")
def harvest_report_catalogue(spark: SparkSession, d: str) -> DataFrame:
    return harvest.report_catalogue(harvest.harvest(summaries(spark, d))["reports"])


@query("harvest_interfaces", _GOOD + " SELECT filename AS job, CASE WHEN f = 'A' THEN 'PROD.RPT' ELSE 'PROD.FILE' END || part AS dataset, 'OLD' AS usage FROM g WHERE st <> 'P' AND f <> 'R' AND q > 25")
def harvest_interfaces(spark: SparkSession, d: str) -> DataFrame:
    return harvest.harvest(summaries(spark, d))["interfaces"]


@query(
    "harvest_prompt_context",
    _GOOD + """,
    t AS (SELECT 'T' || part AS term, arg_max('D' || supp, (filename, n)) AS definition FROM g WHERE n % 2 = 1 AND l_orderkey % 7 <> 0 GROUP BY part ORDER BY term LIMIT 30),
    r AS (SELECT DISTINCT 'Priority ' || pr AS rule FROM g UNION SELECT 'Always' FROM g ORDER BY 1 LIMIT 50)
    SELECT 'term' AS kind, term AS name, definition AS text, NULL::BIGINT AS n FROM t UNION ALL SELECT 'rule', rule, NULL, NULL FROM r
    UNION ALL SELECT 'count', 'reports', NULL, count(*) FROM g WHERE st <> 'P' AND f = 'A' UNION ALL SELECT 'count', 'interfaces', NULL, count(*) FROM g WHERE st <> 'P' AND f <> 'R' AND q > 25
    """,
)
def harvest_prompt_context(spark: SparkSession, d: str) -> DataFrame:
    return harvest.prompt_context(harvest.harvest(summaries(spark, d)))


@query("data_dictionary", "SELECT p_name AS name, p_type AS type, p_partkey AS position FROM part ORDER BY p_name, p_partkey LIMIT 50")
def data_dictionary(spark: SparkSession, d: str) -> DataFrame:
    return harvest.data_dictionary(table(spark, d, "part").select(F.col("p_name").alias("name"), F.col("p_type").alias("type"), F.col("p_partkey").alias("position")), ("name", "position"))


def _chained(state: tuple[str, int], row: dict) -> tuple[str, int]:
    return hashlib.sha256((state[0] + (row["text"] or "")).encode()).hexdigest(), state[1] + 1


@query("rolling_state", "SELECT conv_id, list_reduce(list_prepend('', list(coalesce(text, '') ORDER BY turn)), lambda s, x: sha256(s || x)) AS state, count(*) AS chunks FROM conversations GROUP BY conv_id")
def rolling_state(spark: SparkSession, d: str) -> DataFrame:
    """The state after the last turn of each conversation, every state made of the one before and a turn."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", "text")
    return folds.rolling_fold(turns, ["conv_id"], ["turn"], _chained, "state string, chunks long", start=lambda: ("", 0), finish=lambda s: {"state": s[0], "chunks": s[1]})


@query(
    "tree_listing",
    r"""
    WITH f AS (SELECT DISTINCT list_filter(string_split(regexp_replace(url, '^https?://|[?].*$', '', 'g'), '/'), lambda x: x <> '') AS p FROM pages),
    k AS (SELECT p FROM f WHERE len(p) > 0 AND NOT list_contains(p[1:len(p) - 1], 'es')),
    a AS (SELECT p[1:i] AS p, true AS is_folder, count(*) AS n FROM (SELECT p, unnest(range(1, len(p))) AS i FROM k) GROUP BY ALL UNION ALL SELECT p, false, 1 FROM k)
    SELECT array_to_string(p, '/') AS path, (len(p) - 1)::BIGINT AS depth, is_folder, n AS n_files,
           array_to_string(list_transform(p, lambda x, i: CASE WHEN i = len(p) AND NOT is_folder THEN '1' ELSE '0' END || lower(x) || chr(1) || x), chr(2)) AS sort_key FROM a
    """,
)
def tree_listing(spark: SparkSession, d: str) -> DataFrame:
    paths = table(spark, d, "pages").select(F.regexp_replace("url", r"^https?://|[?].*$", "").alias("path"))
    return trees.listing(paths, skip=("es",)).withColumn("depth", F.col("depth").cast("long"))
