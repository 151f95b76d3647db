"""Further queries of the engine's operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.functions import text as T
from quarrystone.operators import relational, statements
from quarrystone.plans.catalogue import query, table


@query("parent_by_level", "SELECT c.p_brand AS brand, c.p_partkey AS position, c.p_size AS level, max(p.p_partkey) AS parent FROM part c LEFT JOIN part p ON p.p_brand = c.p_brand AND p.p_partkey < c.p_partkey AND p.p_size < c.p_size GROUP BY 1, 2, 3")
def parent_by_level(spark: SparkSession, d: str) -> DataFrame:
    fields = table(spark, d, "part").select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("position"), F.col("p_size").alias("level"))
    return statements.with_parents(fields, key="brand")


@query("status_summary", "SELECT d.source, count(*) AS n_files, count(l.doc_id) AS n_labelled, count(*) FILTER (WHERE l.quality = 1) AS n_good FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.source")
def status_summary(spark: SparkSession, d: str) -> DataFrame:
    return relational.status_by(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id", "source", F.col("quality") == 1)


@query("union_tagged", "SELECT o_orderkey AS key, 'order' AS kind FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT DISTINCT l_orderkey, 'line' FROM lineitem WHERE l_returnflag = 'R'")
def union_tagged(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("key"))
    items = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("key")).distinct()
    return relational.tagged("kind", order=orders, line=items)


@query("distinct_pairs", "SELECT DISTINCT l_partkey AS part, l_suppkey AS supplier FROM lineitem")
def distinct_pairs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier")).distinct()


@query("missing_members", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def missing_members(spark: SparkSession, d: str) -> DataFrame:
    """Customers without a large order: key and name."""
    return relational.missing(table(spark, d, "customer").select("c_custkey", "c_name"), table(spark, d, "orders").where("o_totalprice > 300000"), "c_custkey", "o_custkey")


@query("role_counts", "SELECT conv_id, role, count(*) AS n_turns, max(turn) AS last_turn FROM conversations GROUP BY conv_id, role")
def role_counts(spark: SparkSession, d: str) -> DataFrame:
    return relational.totals_by(table(spark, d, "conversations"), ["conv_id", "role"], last_turn=F.max("turn")).withColumnRenamed("n", "n_turns")


@query("grep_contains_capped", "WITH h AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n, count(*) OVER () AS total FROM documents WHERE contains(lower(text), 'license')) SELECT doc_id, greatest(total - 100, 0)::BIGINT AS remainder FROM h WHERE n <= 100")
def grep_contains_capped(spark: SparkSession, d: str) -> DataFrame:
    """The first hundred hits and how many more there are."""
    hits = table(spark, d, "documents").where(F.contains(F.lower("text"), F.lit("license"))).select("doc_id")
    total = hits.agg(F.greatest(F.count("*") - 100, F.lit(0)).alias("remainder"))
    return hits.orderBy("doc_id").limit(100).join(F.broadcast(total))  # one row


@query("kv_extract", r"""SELECT event_id, nullif(regexp_extract(props, '"k":\s*(-?[0-9]+)', 1), '') AS k FROM events""")
def kv_extract(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", T.first_match("props", r'"k":\s*(-?[0-9]+)').alias("k"))


@query("array_sorted_distinct", "SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z]{12,}', 0))), ' ') AS words FROM documents")
def array_sorted_distinct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", relational.distinct_words(F.lower("text"), "[a-z]{12,}").alias("words"))


@query("base64_id", "SELECT page_id, rtrim(base64(encode(url)), '=') AS id FROM pages")
def base64_id(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", relational.encoded_id("url").alias("id"))


@query("keyword_vote", "SELECT source, CASE WHEN avg(contains(lower(text), 'token')::INT) > avg(contains(lower(text), 'license')::INT) THEN 'token' WHEN avg(contains(lower(text), 'token')::INT) < avg(contains(lower(text), 'license')::INT) THEN 'license' ELSE 'even' END AS vote FROM documents GROUP BY source")
def keyword_vote(spark: SparkSession, d: str) -> DataFrame:
    return relational.votes(table(spark, d, "documents"), "source", "text", "token", "license")


@query("volume_class", "SELECT o_orderkey, CASE WHEN o_totalprice >= 300000 THEN 'HIGH' WHEN o_totalprice >= 100000 THEN 'MEDIUM' ELSE 'LOW' END AS volume, CASE WHEN o_orderpriority LIKE '1-%' OR o_orderpriority LIKE '2-%' THEN 'DAILY' WHEN o_orderpriority LIKE '3-%' THEN 'WEEKLY' ELSE 'ON-DEMAND' END AS cadence FROM orders")
def volume_class(spark: SparkSession, d: str) -> DataFrame:
    volume = relational.banded("o_totalprice", (300000, "HIGH"), (100000, "MEDIUM"), default="LOW")
    cadence = relational.labelled(F.left("o_orderpriority", F.lit(2)), {"1-": "DAILY", "2-": "DAILY", "3-": "WEEKLY"}, "ON-DEMAND")
    return table(spark, d, "orders").select("o_orderkey", volume.alias("volume"), cadence.alias("cadence"))


@query("common_members", "SELECT s_nationkey AS key FROM supplier INTERSECT SELECT c_nationkey FROM customer")
def common_members(spark: SparkSession, d: str) -> DataFrame:
    named = lambda t, c: table(spark, d, t).select(F.col(c).alias("key"))
    return relational.common(named("supplier", "s_nationkey"), named("customer", "c_nationkey"), "key")


@query("first_definitions", "SELECT user_id, arg_min(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def first_definitions(spark: SparkSession, d: str) -> DataFrame:
    return relational.first_definitions(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type")
