"""Mixing sources to target weights by hierarchical budgets (operator 7), by SQL functions only.

A token budget is split down a domain-language-source tree by weights.  A node
can take no more than its documents give in ``max_epochs`` readings; what a node
can't take goes to its siblings first, and only when all of them are full does
their parent's shortage go to the parent's siblings.  Every leaf then reads
whole epochs and, for the rest, the token-prefix of one more epoch in an order
seeded by the epoch.

A leaf may hold a third of all documents, so its prefix is not found by one sort:
tokens are summed by ranges of the order key, the range in which the budget ends
is found on the sums, and only documents of that range are sorted.

Defined results: documents without words weigh nothing and go with the prefix they
fall in; null languages, sources and domains are the node "unknown"; rows of equal
id are taken or left together within their leaf; null ids share one place in the
order; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrystone.llm.quality import words
from quarrystone.llm.tables import cut_lineage

LEVELS = ("domain", "lang", "source")
RANGE_ROWS = 2000


@dataclass(frozen=True)
class Mixture:
    """Whole-number weights by node name for each level (1 where none is given), and the budget."""

    weights: Mapping[str, Mapping[str, int]] = field(default_factory=lambda: {"domain": {"web": 5, "books": 3, "forums": 2}, "lang": {"en": 6, "de": 2, "fr": 2, "es": 2}, "source": {}})
    percent: int = 60  # of all tokens of the input
    max_epochs: int = 2
    seed: int = 7


def domain_of(source: Column) -> Column:
    """Domains by the number in a source's name."""
    number = F.regexp_extract(source, "[0-9]+", 0).try_cast("int") % 3
    return F.when(number == 0, "web").when(number == 1, "books").when(number == 2, "forums")


def _weight(level: str, mix: Mixture) -> Column:
    given = mix.weights.get(level, {})
    out = F.lit(1)
    for name, weight in given.items():
        out = F.when(F.col(level) == name, F.lit(int(weight))).otherwise(out)
    return out


def _share(nodes: DataFrame, parent: list[str], level: str, mix: Mixture) -> DataFrame:
    """Split ``budget`` among siblings: each gets its weight's part, at most its capacity."""
    w = nodes.withColumn("w", _weight(level, mix)).withColumn("fill", F.when(F.col("w") > 0, F.col("capacity") / F.col("w")).otherwise(F.lit(float("inf"))))
    ordered = Window.partitionBy(*parent).orderBy("fill", level)
    before = F.coalesce(F.sum("capacity").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("w").over(ordered.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    w = w.withColumn("rate", F.when(rest > 0, (F.col("budget") - before).cast("double") / rest).otherwise(0.0))
    full = (F.col("w") > 0) & (F.col("fill") <= F.col("rate"))
    rate = F.max(F.when(~full, F.col("rate"))).over(Window.partitionBy(*parent))
    return w.withColumn("budget", F.when(full, F.col("capacity")).otherwise(F.floor(rate * F.col("w")))).drop("w", "fill", "rate")


def leaf_budgets(leaves: DataFrame, total: Column | int, mix: Mixture) -> DataFrame:
    """Budgets of the leaves (domain, lang, source, have): top down, level by level."""
    own = leaves.withColumn("capacity", F.col("have") * mix.max_epochs)
    above = own.agg(F.floor(F.coalesce(F.sum("have"), F.lit(0)) * mix.percent / 100).cast("long").alias("budget")) if total is None else own.agg(F.lit(total).cast("long").alias("budget"))
    path: list[str] = []
    for level in LEVELS:
        nodes = own.groupBy(*path, level).agg(F.sum("capacity").alias("capacity"))
        nodes = nodes.join(above.select(*path, "budget"), path) if path else nodes.withColumn("budget", F.lit(above.first()["budget"]))
        above = _share(nodes, path, level, mix).select(*path, level, "budget")
        path.append(level)
    return own.join(above, list(LEVELS)).select(*LEVELS, "have", "rows", "budget")


def _leaf_columns(df: DataFrame, id_col: str, text_col: str, domain: Column) -> DataFrame:
    named = lambda c: F.coalesce(c.cast("string"), F.lit("unknown"))
    return df.select(F.col(id_col).alias("id"), named(domain).alias("domain"), named(F.col("lang")).alias("lang"), named(F.col("source")).alias("source"), F.size(words(F.coalesce(F.col(text_col), F.lit("")))).cast("long").alias("n_tokens"))


def _key(mix: Mixture, epoch: Column, id_: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(mix.seed)), epoch.cast("string"), F.coalesce(id_.cast("string"), F.lit("null"))))


def leaf_decisions(rows: DataFrame, mix: Mixture, total: int | None = None) -> DataFrame:
    """For each leaf how many whole epochs it reads and the last key of the prefix of one more."""
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("have"), F.count("*").alias("rows"))
    plan = leaf_budgets(cut_lineage(leaves), total, mix)
    plan = plan.withColumn("epochs", F.when(F.col("have") > 0, F.floor(F.col("budget") / F.greatest("have", F.lit(1)))).otherwise(0).cast("long"))
    plan = plan.withColumn("left", F.when(F.col("epochs") >= mix.max_epochs, F.lit(-1)).otherwise(F.col("budget") - F.col("epochs") * F.col("have")))
    plan = cut_lineage(plan.withColumn("digits", F.greatest(F.lit(1), F.ceil(F.log(16.0, F.col("rows") / RANGE_ROWS))).cast("int")))
    keyed = rows.join(plan.where("left >= 0").select(*LEVELS, "epochs", "left", "digits"), list(LEVELS)).withColumn("key", _key(mix, F.col("epochs"), F.col("id")))
    keyed = keyed.withColumn("range", F.substr("key", F.lit(1), F.col("digits")))
    sums = keyed.groupBy(*LEVELS, "range", "left").agg(F.sum("n_tokens").alias("tokens"), F.max("key").alias("last"))
    running = F.sum("tokens").over(Window.partitionBy(*LEVELS).orderBy("range"))
    sums = cut_lineage(sums.withColumn("upto", running))
    inside = sums.where("upto <= left").groupBy(*LEVELS).agg(F.max("last").alias("last_whole"))
    edge = sums.where("upto > left and upto - tokens <= left").select(*LEVELS, "range", (F.col("left") - (F.col("upto") - F.col("tokens"))).alias("room"))
    within = keyed.select(*LEVELS, "range", "key", "n_tokens").join(edge, [*LEVELS, "range"])
    spent = F.sum("n_tokens").over(Window.partitionBy(*LEVELS, "range").orderBy("key"))
    partly = within.withColumn("spent", spent).where("spent <= room").groupBy(*LEVELS).agg(F.max("key").alias("last_partly"))
    out = plan.join(inside, list(LEVELS), "left").join(partly, list(LEVELS), "left")
    return cut_lineage(out.select(*LEVELS, "epochs", "budget", F.greatest("last_whole", "last_partly").alias("last")))


def copies(mix: Mixture, id_: Column) -> Column:
    return (F.col("epochs") + F.when(_key(mix, F.col("epochs"), id_) <= F.col("last"), 1).otherwise(0)).cast("int")


def mix_sources(df: DataFrame, mix: Mixture = Mixture(), id_col: str = "doc_id", text_col: str = "text", domain: Column | None = None) -> DataFrame:
    """Selected documents with how often each is read: id, domain, lang, source, n_tokens, copies."""
    rows = cut_lineage(_leaf_columns(df, id_col, text_col, domain_of(F.col("source")) if domain is None else domain))
    decided = leaf_decisions(rows, mix)
    out = rows.join(decided, list(LEVELS)).withColumn("copies", copies(mix, F.col("id"))).where("copies > 0")
    return out.select(F.col("id").alias(id_col), *LEVELS, "n_tokens", "copies")


def select_mixture(df: DataFrame, mix: Mixture, id_col: str = "doc_id", text_col: str = "text", domain: Column | None = None) -> DataFrame:
    """The selected rows with all their columns, as often as they are read.

    The decisions are one row a leaf, so the texts stay where they are when that
    table is small enough for Spark to send it around.
    """
    domain = domain_of(F.col("source")) if domain is None else domain
    decided = leaf_decisions(cut_lineage(_leaf_columns(df, id_col, text_col, domain)), mix).select(*(F.col(c).alias(f"__{c}") for c in LEVELS), "epochs", "last")
    named = lambda c: F.coalesce(c.cast("string"), F.lit("unknown"))
    tagged = df.select(*(F.col(c).alias(f"__own_{i}") for i, c in enumerate(df.columns)), named(domain).alias("__domain"), named(F.col("lang")).alias("__lang"), named(F.col("source")).alias("__source"))
    own_id = F.col(f"__own_{df.columns.index(id_col)}")
    out = tagged.join(decided, [f"__{c}" for c in LEVELS]).withColumn("__copies", copies(mix, own_id)).where("__copies > 0")
    if mix.max_epochs > 1:
        out = out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return out.select(*(F.col(f"__own_{i}").alias(c) for i, c in enumerate(df.columns)))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default mixture over all of ``documents``."""
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _level_sql(name: str, above: str | None, path: list[str], level: str, weight: str) -> str:
    keys = ", ".join([*path, level])
    part = f"PARTITION BY {', '.join(path)}" if path else ""
    budget = f"JOIN {above} USING ({', '.join(path)})" if above else ", total"
    return f"""{name}_n AS (SELECT * FROM (SELECT {keys}, sum(capacity)::BIGINT AS capacity, {weight} AS w FROM leaves GROUP BY {keys}) {budget}),
{name}_r AS (SELECT *, capacity / w AS fill, (budget - coalesce(sum(capacity) OVER ({part} ORDER BY capacity / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
  / sum(w) OVER ({part} ORDER BY capacity / w, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate FROM {name}_n),
{name} AS (SELECT {keys}, CASE WHEN fill <= rate THEN capacity ELSE floor(max(CASE WHEN fill > rate THEN rate END) OVER ({part}) * w)::BIGINT END AS budget FROM {name}_r),
"""


def _case(level: str, given: Mapping[str, int]) -> str:
    return "1" if not given else f"CASE {level} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in given.items()) + " ELSE 1 END"


def oracle(mix: Mixture = Mixture(), docs: str = "documents") -> str:
    """CTEs of the same selection by one sort a leaf; the last one is ``picked``."""
    return (
        rf"""t AS (SELECT doc_id, coalesce(CASE try_cast(regexp_extract(source, '[0-9]+') AS INT) % 3 WHEN 0 THEN 'web' WHEN 1 THEN 'books' WHEN 2 THEN 'forums' END, 'unknown') AS domain,
  coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source, len(list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> ''))::BIGINT AS n_tokens FROM {docs}),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS have, sum(n_tokens)::BIGINT * {mix.max_epochs} AS capacity FROM t GROUP BY ALL),
total AS (SELECT floor(sum(have) * {mix.percent} / 100)::BIGINT AS budget FROM leaves),
"""
        + _level_sql("l1", None, [], "domain", _case("domain", mix.weights["domain"]))
        + _level_sql("l2", "l1", ["domain"], "lang", _case("lang", mix.weights["lang"]))
        + _level_sql("l3", "l2", ["domain", "lang"], "source", _case("source", mix.weights["source"]))
        + f"""plan AS (SELECT domain, lang, source, CASE WHEN have > 0 THEN budget // have ELSE 0 END AS epochs, budget, have FROM leaves JOIN l3 USING (domain, lang, source)),
spent AS (SELECT t.*, epochs, CASE WHEN epochs >= {mix.max_epochs} THEN -1 ELSE budget - epochs * have END AS room,
  sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{mix.seed}:' || epochs || ':' || doc_id)) AS upto FROM t JOIN plan USING (domain, lang, source)),
picked AS (SELECT doc_id, domain, lang, source, n_tokens, (epochs + CASE WHEN upto <= room THEN 1 ELSE 0 END)::INT AS copies FROM spent WHERE epochs + CASE WHEN upto <= room THEN 1 ELSE 0 END > 0)
"""
    )


ORACLE = "WITH " + oracle() + "SELECT * FROM picked"
