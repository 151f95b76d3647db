"""Queries of the engine's operators in their generic form over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.functions import text as T
from quarrystone.operators import chunks, graph, relational, search, vectors
from quarrystone.plans.catalogue import LINKS, query, table
from quarrystone.sources import files

# Words whose occurrence classifies a text in the queries below.
KEYWORDS = ("License", "token", "the", "que", "der")


def _links(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages")
    return pages.select(F.col("url").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINKS), 1)).alias("dst")).distinct().withColumn("type", F.lit("LINK")).withColumn("weight", F.lit(1))


LINK_SQL = """l AS (SELECT DISTINCT url AS src, unnest(regexp_extract_all(html, 'href="(https?://[^"]*|/[^"]*)"', 1)) AS dst FROM pages)"""


@query("graph_degree", f"WITH {LINK_SQL}, e AS (SELECT src AS node, 0 AS i, 1 AS o FROM l UNION ALL SELECT dst, 1, 0 FROM l) SELECT node, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree FROM e GROUP BY node")
def graph_degree(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(_links(spark, d))


@query("graph_context_sources_sinks", f"WITH {LINK_SQL}, s AS (SELECT DISTINCT src AS node FROM l), t AS (SELECT DISTINCT dst AS node FROM l) SELECT node, 'source' AS role FROM s ANTI JOIN t USING (node) UNION ALL SELECT node, 'sink' FROM t ANTI JOIN s USING (node)")
def graph_context(spark: SparkSession, d: str) -> DataFrame:
    return graph.sources_and_sinks(_links(spark, d))


_EDGE_SQL = "e AS (SELECT src, dst, max(type) AS type FROM (SELECT 'O' || l_orderkey AS src, CASE WHEN l_returnflag = 'N' THEN 'FILE:P' ELSE 'P' END || l_partkey AS dst, CASE l_returnflag WHEN 'R' THEN 'ACCESS_DB' WHEN 'N' THEN 'WRITE_FILE' ELSE 'CALL' END AS type FROM lineitem) GROUP BY src, dst)"


def _orders_to_parts(spark: SparkSession, d: str) -> DataFrame:
    """Orders and parts as the nodes of a graph, in lower case and with blanks, so that the builder has to clean them."""
    li = table(spark, d, "lineitem")
    part = lambda flag: li.where(F.col("l_returnflag") == flag).select(F.concat(F.lit(" o"), "l_orderkey").alias("src"), F.concat(F.lit("p"), "l_partkey", F.lit(" ")).alias("dst"))
    return graph.edges_from({"ACCESS_DB": (part("R"), "src", "dst", ""), "CALL": (part("A"), "src", "dst", ""), "WRITE_FILE": (part("N"), "src", "dst", "FILE:")})


@query(
    "graph_score",
    f"WITH {_EDGE_SQL}, x AS (SELECT src AS node, CASE WHEN type IN ('ACCESS_DB', 'WRITE_FILE') THEN 2.5 ELSE 0 END AS data FROM e UNION ALL SELECT dst, 0 FROM e), n AS (SELECT 'O' || o_orderkey AS node, o_custkey % 9000 AS lines FROM orders) SELECT node, (count(*) + sum(data) + 1.5 * least(coalesce(any_value(lines), 0) / 100, 50))::DOUBLE AS score FROM x LEFT JOIN n USING (node) WHERE NOT contains(node, ':') GROUP BY node",
)
def graph_score(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "orders").select(F.concat(F.lit("O"), "o_orderkey").alias("node"), (F.col("o_custkey") % 9000).alias("lines"))
    return graph.scores(_orders_to_parts(spark, d), lines)


@query("graph_edges_cleaned", f"WITH {_EDGE_SQL} SELECT src, dst, type, CASE type WHEN 'CALL' THEN 3 ELSE 2 END AS weight FROM e")
def graph_edges_cleaned(spark: SparkSession, d: str) -> DataFrame:
    return _orders_to_parts(spark, d)


@query("graph_critical", f"WITH {_EDGE_SQL}, x AS (SELECT src AS node, CASE WHEN type IN ('ACCESS_DB', 'WRITE_FILE') THEN 2.5 ELSE 0 END AS data FROM e UNION ALL SELECT dst, 0 FROM e) SELECT node, (count(*) + sum(data))::DOUBLE AS score FROM x WHERE NOT contains(node, ':') GROUP BY node ORDER BY score DESC, node LIMIT 30")
def graph_critical(spark: SparkSession, d: str) -> DataFrame:
    return graph.critical(_orders_to_parts(spark, d))


@query("graph_structure_view", f"WITH {_EDGE_SQL}, o AS (SELECT * FROM e WHERE type IN ('CALL', 'ACCESS_DB')), t AS (SELECT node FROM (SELECT src AS node FROM o UNION ALL SELECT dst FROM o) GROUP BY node ORDER BY count(*) DESC, node LIMIT 5000) SELECT src, dst, type FROM o WHERE src IN (FROM t) AND dst IN (FROM t)")
def graph_structure_view(spark: SparkSession, d: str) -> DataFrame:
    return graph.view(_orders_to_parts(spark, d), graph.STRUCTURE_EDGES, 5000, without=graph.DATA_NODES).select("src", "dst", "type")


@query("graph_outer_files", f"WITH {_EDGE_SQL} (SELECT DISTINCT dst AS node, 'sink' AS role FROM e WHERE dst LIKE 'FILE:%' ORDER BY node LIMIT 7)")
def graph_outer_files(spark: SparkSession, d: str) -> DataFrame:
    return graph.outer_files(_orders_to_parts(spark, d))


@query("induced_subgraph_topk", f"WITH {LINK_SQL}, deg AS (SELECT node, count(*) FILTER (dir = 1) AS i FROM (SELECT src AS node, 0 AS dir FROM l UNION ALL SELECT dst, 1 FROM l) GROUP BY node ORDER BY i DESC, node LIMIT 50), big AS (SELECT src AS node FROM l GROUP BY src ORDER BY count(*) DESC, src LIMIT 50) SELECT src, dst FROM l WHERE src IN (SELECT node FROM deg UNION SELECT node FROM big) AND dst IN (SELECT node FROM deg UNION SELECT node FROM big)")
def induced_topk(spark: SparkSession, d: str) -> DataFrame:
    links = _links(spark, d)
    most = graph.degrees(links).where("out_degree > 0").orderBy(F.desc("out_degree"), "node").limit(50)
    return graph.induced(links, graph.top_by_in_degree(links, 50).select("node").unionByName(most.select("node"))).select("src", "dst")


@query("link_edge_dedupe_keep_last", """WITH x AS (SELECT page_id, url, unnest(regexp_extract_all(html, 'href="(https?://[^"]*|/[^"]*)"', 1)) AS dst FROM pages) SELECT dst, max(page_id) AS page_id FROM x GROUP BY dst""")
def keep_last_edge(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(LINKS), 1)).alias("dst"))
    return T.keep_last(rows.distinct(), ["dst"], ["page_id"])


@query("node_sanitize", "SELECT page_id, 'node' || regexp_replace(url, '[^A-Za-z0-9]', '', 'g') AS node FROM pages")
def node_sanitize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.node_name("url").alias("node"))


@query("project_file_counts", "SELECT c_custkey, count(o_orderkey) AS files FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def project_file_counts(spark: SparkSession, d: str) -> DataFrame:
    return relational.counts_of(table(spark, d, "customer"), table(spark, d, "orders"), "c_custkey", "o_custkey", "files")


@query("type_counts", "SELECT lang, source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY ALL")
def type_counts(spark: SparkSession, d: str) -> DataFrame:
    return relational.totals_by(table(spark, d, "documents"), ["lang", "source"], {"chars": "n_chars"})


@query("relation_counts_pivot", "SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'error') AS error FROM events GROUP BY user_id")
def relation_counts(spark: SparkSession, d: str) -> DataFrame:
    return relational.counts_by_kind(table(spark, d, "events"), "user_id", "event_type", ("click", "view", "error"))


@query("coverage_percent", "SELECT lang, count(*) AS files, count(l.doc_id) AS covered, round(100.0 * count(l.doc_id) / count(*), 2)::DOUBLE AS coverage FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY lang")
def coverage(spark: SparkSession, d: str) -> DataFrame:
    return relational.coverage_by(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id", "lang")


@query("incremental_skip", "SELECT doc_id, lang FROM documents ANTI JOIN labels USING (doc_id)")
def incremental_skip(spark: SparkSession, d: str) -> DataFrame:
    return relational.missing(table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels"), "doc_id")


@query("crud_matrix", "SELECT user_id, max((event_type = 'click')::INT) AS c, max((event_type = 'view')::INT) AS r, max((event_type = 'purchase')::INT) AS u, max((event_type = 'error')::INT) AS e FROM events GROUP BY user_id")
def crud_matrix(spark: SparkSession, d: str) -> DataFrame:
    return relational.usage_matrix(table(spark, d, "events"), "user_id", "event_type", {"c": "click", "r": "view", "u": "purchase", "e": "error"})


@query("category_top5", "SELECT p_brand, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS n FROM part) WHERE n <= 5")
def category_top5(spark: SparkSession, d: str) -> DataFrame:
    return relational.first_k(table(spark, d, "part"), "p_brand", [F.desc("p_retailprice"), "p_partkey"], 5).select("p_brand", "p_partkey", "p_retailprice")


@query(
    "producer_consumer_lineage",
    "WITH w AS (SELECT l_partkey, arg_min(l_suppkey, (l_orderkey, l_suppkey)) AS producer FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_partkey), r AS (SELECT DISTINCT l_partkey, l_suppkey AS consumer FROM lineitem WHERE l_returnflag = 'A') SELECT l_partkey, producer, consumer FROM w JOIN r USING (l_partkey) WHERE producer <> consumer",
)
def lineage(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag", "l_orderkey")
    return graph.lineage(li.where("l_returnflag = 'R'"), li.where("l_returnflag = 'A'"), "l_partkey", "l_suppkey", "l_orderkey")


@query("asof_last_value", "SELECT event_id, user_id, last_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_error FROM events")
def asof(spark: SparkSession, d: str) -> DataFrame:
    error = F.when(F.col("event_type") == "error", F.col("event_id"))
    return relational.last_before(table(spark, d, "events"), "user_id", ["ts", "event_id"], error, "last_error").select("event_id", "user_id", "last_error")


@query("gaps_islands", "SELECT user_id, min(event_id) AS first_event, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, g")
def gaps_islands(spark: SparkSession, d: str) -> DataFrame:
    cut = relational.islands(table(spark, d, "events").select("user_id", "event_id", "ts"), "user_id", "ts", ["ts", "event_id"], "6 HOUR")
    return relational.totals_by(cut, ["user_id", "island"], first_event=F.min("event_id")).drop("island")


@query("dim_lookup", "SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey")
def dim_lookup(spark: SparkSession, d: str) -> DataFrame:
    s, n, r = (table(spark, d, x) for x in ("supplier", "nation", "region"))
    return relational.looked_up(s, (n, "s_nationkey", "n_nationkey"), (r, "n_regionkey", "r_regionkey")).select("s_suppkey", "n_name", "r_name")


@query("keep_first_dedupe", "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY trim(lower(text))")
def keep_first_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return relational.copies_kept_first(table(spark, d, "documents"), F.trim(F.lower("text")), "doc_id")


@query("set_union_merge", "SELECT conv_id, array_to_string(list_sort(list_distinct(list(role))), ',') AS roles, count(*) AS turns FROM conversations GROUP BY conv_id")
def set_union_merge(spark: SparkSession, d: str) -> DataFrame:
    return relational.merged_sets(table(spark, d, "conversations"), "conv_id", "role", "roles")


@query("glossary_keep_last", "SELECT event_type, arg_max(value, event_id) AS value FROM events GROUP BY event_type")
def glossary(spark: SparkSession, d: str) -> DataFrame:
    return relational.last_definitions(table(spark, d, "events"), "event_type", ["event_id"], "value")


@query("upsert_latest", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    """Two batches of uploads; the latest row of each key stays."""
    events = table(spark, d, "events").select("user_id", "event_id", F.col("ts").alias("uploaded_at"), F.col("event_id").alias("upload_no"))
    even = F.col("event_id") % 2 == 0
    return files.upsert(events.where(even), events.where(~even), ["user_id"]).select("user_id", "event_id")


@query("lines_explode", "SELECT doc_id, generate_subscripts(s, 1) AS line_no, unnest(s) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)")
def lines_explode(spark: SparkSession, d: str) -> DataFrame:
    return files.lines(table(spark, d, "documents"), "doc_id").withColumn("line_no", F.col("line_no").cast("long"))


@query("line_range_view", "SELECT doc_id, array_to_string(string_split(text, chr(10))[2:4], chr(10)) AS view FROM documents WHERE len(string_split(text, chr(10))) >= 2")
def line_range_view(spark: SparkSession, d: str) -> DataFrame:
    return relational.line_range(table(spark, d, "documents"), "doc_id", 2, 4)


@query("grep_regex_topn", "SELECT doc_id, line_no, text FROM (SELECT doc_id, generate_subscripts(s, 1) AS line_no, unnest(s) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)) WHERE regexp_matches(text, '[Ll]icense') ORDER BY doc_id, line_no LIMIT 100")
def grep_regex(spark: SparkSession, d: str) -> DataFrame:
    return relational.grep(table(spark, d, "documents"), "doc_id", "[Ll]icense", 100).withColumn("line_no", F.col("line_no").cast("long"))


@query("keyword_flags", "SELECT doc_id, array_to_string(list_filter(['License', 'token', 'the', 'que', 'der'], lambda w: contains(text, w)), ',') AS words FROM documents")
def keyword_flags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", relational.words_in("text", KEYWORDS).alias("words"))


@query("classify_ordered", "SELECT p_partkey, CASE WHEN contains(p_type, 'PROMO') THEN 'METAL' WHEN contains(p_type, 'ECONOMY') THEN 'METAL' WHEN contains(p_type, 'SMALL') THEN 'COATED' ELSE 'OTHER' END AS category FROM part")
def classify_ordered(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", T.classify("p_type", (("PROMO", "METAL"), ("ECONOMY", "METAL"), ("SMALL", "COATED")), "OTHER").alias("category"))


@query("json_props", "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("section_chunks", "WITH l AS (SELECT doc_id, generate_subscripts(s, 1) AS n, unnest(s) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)), g AS (SELECT *, sum(CASE WHEN length(t) < 20 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS chunk FROM l) SELECT doc_id, chunk::BIGINT AS chunk, min(n)::BIGINT AS start_line, max(n)::BIGINT AS end_line, string_agg(t, chr(10) ORDER BY n) AS text FROM g GROUP BY doc_id, chunk")
def section_chunks(spark: SparkSession, d: str) -> DataFrame:
    own = files.lines(table(spark, d, "documents"), "doc_id")
    out = chunks.sections(own, F.char_length("text") < 20, "doc_id")
    return out.select("doc_id", "chunk", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), "text")


@query("sliding_chunks", "SELECT doc_id, s AS start, substring(text, s + 1, 1000) AS chunk FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 201, 0) + 1, 800)) AS s FROM documents)")
def sliding_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunks.sliding(table(spark, d, "documents"), "doc_id").select("doc_id", F.col("start").cast("long").alias("start"), "chunk")


@query("vector_topk", "SELECT vec_id, round(list_distance(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 4) AS distance FROM embeddings ORDER BY distance, vec_id LIMIT 10")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "embeddings")
    q = own.where("vec_id = 0").limit(1).select(F.col("embedding").alias("q"))  # the stated query
    return vectors.nearest(own.join(F.broadcast(q), F.lit(True), "left"), F.col("q"), 10).select("vec_id", "distance")


@query(
    "vector_topk_each",
    """
    WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_distance(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 4) AS distance FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM s) WHERE rank <= 10
    """,
)
def vector_topk_each(spark: SparkSession, d: str) -> DataFrame:
    """A search at every row whose id is divisible by 20, against all rows."""
    own = table(spark, d, "embeddings")
    return vectors.nearest_of_each(own, own.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), 10)


@query("rag_context_preview", "SELECT doc_id, left(text, 200) AS preview FROM documents")
def rag_preview(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", relational.preview("text").alias("preview"))


@query("message_prune", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 4 OR turn = 0")
def message_prune(spark: SparkSession, d: str) -> DataFrame:
    return relational.newest_and_head(table(spark, d, "conversations"), "conv_id", "turn", 4).select("conv_id", "turn", "role")


@query("truncate_escape", "SELECT page_id, CASE WHEN length(url) > 30 THEN left(url, 27) || '...' ELSE url END AS short, replace(replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS escaped FROM pages")
def truncate_escape(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.truncated("url", 30).alias("short"), T.html_escaped("url").alias("escaped"))


@query("theta_contains", "SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def theta_contains(spark: SparkSession, d: str) -> DataFrame:
    """Documents that contain a benchmark item."""
    return search.containing(table(spark, d, "benchmark"), table(spark, d, "documents"), "item_id", "doc_id")


@query("theta_contains_short", "WITH i AS (SELECT item_id, string_split(text, ' ')[1] AS text FROM benchmark UNION ALL SELECT item_id + 100000, string_split(text, ' ')[1] || ' ' || left(string_split(text, ' ')[2], 3) FROM benchmark) SELECT DISTINCT i.item_id, d.doc_id FROM i JOIN documents d ON contains(d.text, i.text)")
def theta_contains_short(spark: SparkSession, d: str) -> DataFrame:
    """The same for items of one word, and of one and the beginning of another."""
    w = F.split("text", " ")
    one = table(spark, d, "benchmark").select("item_id", F.get(w, F.lit(0)).alias("text"))
    two = table(spark, d, "benchmark").select((F.col("item_id") + 100000).alias("item_id"), F.concat_ws(" ", F.get(w, F.lit(0)), F.left(F.get(w, F.lit(1)), F.lit(3))).alias("text"))
    return search.containing(one.unionByName(two), table(spark, d, "documents"), "item_id", "doc_id")
