"""What documents gather from summaries of no fixed schema: rules, glossary, reports and interfaces.

A summary is JSON as some writer left it.  It becomes a VARIANT, and every path is tried:
a path that isn't there, or holds something else than a list, gives nothing, and text that isn't
JSON gives nothing at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Where summaries keep what is gathered, words that make a dataset a report or an interface, and how much of it a prompt or table takes.
RULES, GLOSSARY, DATASETS = "$.business_overview.scope", "$.business_overview.glossary", "$.technical_analysis.io_datasets"
REPORT_WORDS = ("SYSOUT", ".RPT", ".LIST")
INTERFACE_USES = ("OLD", "NEW")
PASSING = "TEMP"
NARRATIVE, PURPOSE, PROCESSES, ACRONYMS, TERMS = "$.executive_narrative", "$.business_purpose", "$.key_business_processes", "$.harvested_acronyms", "$.glossary"
NO_OVERVIEW = "Overview unavailable."
NO_PURPOSE = "The system facilitates core data processing."
PROCESS_LEAD = "The system encompasses the following core business processes:"
NO_PROCESSES = ("The system is comprised of ", " processing modules handling batch transactions.")
MOST_TERMS, MOST_RULES, MOST_ENTRIES = 30, 50, 50


def _items(summaries: DataFrame, path: str) -> DataFrame:
    """(filename, file_type, position, item) of the list at a path."""
    found = F.try_variant_get(F.try_parse_json("body"), path, "array<variant>")
    return summaries.select("filename", "file_type", F.posexplode(found).alias("position", "item"))


def _member(name: str):
    return F.try_variant_get("item", f"$.{name}", "string")


def harvest(summaries: DataFrame) -> dict[str, DataFrame]:
    """Tables gathered from summaries (filename, file_type, body)."""
    rules = _items(summaries, RULES).select(F.try_variant_get("item", "$", "string").alias("rule")).where("rule is not null").distinct()
    terms = _items(summaries, GLOSSARY).select("filename", "position", _member("term").alias("term"), _member("definition").alias("definition")).where("term is not null")
    glossary = terms.groupBy("term").agg(F.max_by("definition", F.struct("filename", "position")).alias("definition"))
    datasets = _items(summaries, DATASETS).where("upper(file_type) = 'JCL'").select("filename", "position", F.upper(F.coalesce(_member("dataset"), F.lit(""))).alias("dataset"), F.upper(F.coalesce(_member("usage"), F.lit(""))).alias("usage"))

    def holds(c: str, words: tuple[str, ...]):
        return F.col(c).rlike("|".join(w.replace(".", "[.]") for w in words))

    return {
        "rules": rules,
        "glossary": glossary,
        "reports": datasets.where(holds("dataset", REPORT_WORDS)).select(F.col("filename").alias("job"), F.col("dataset").alias("report")),
        "interfaces": datasets.where(holds("usage", INTERFACE_USES) & ~F.contains("dataset", F.lit(PASSING))).select(F.col("filename").alias("job"), "dataset", "usage"),
    }


def report_catalogue(reports: DataFrame) -> DataFrame:
    """Reports once a job, by job; the order holds when the rows are written or shown."""
    return reports.distinct().orderBy("job", "report")


def prompt_context(found: dict[str, DataFrame]) -> DataFrame:
    """What a prompt takes: the first terms and rules by name, and the numbers of reports and interfaces: (kind, name, text, n)."""
    none = F.lit(None)
    terms = found["glossary"].orderBy("term").limit(MOST_TERMS).select(F.lit("term").alias("kind"), F.col("term").alias("name"), F.col("definition").alias("text"), none.cast("long").alias("n"))
    rules = found["rules"].orderBy("rule").limit(MOST_RULES).select(F.lit("rule").alias("kind"), F.col("rule").alias("name"), none.cast("string").alias("text"), none.cast("long").alias("n"))
    counts = [found[k].agg(F.count("*").alias("n")).select(F.lit("count").alias("kind"), F.lit(k).alias("name"), none.cast("string").alias("text"), "n") for k in ("reports", "interfaces")]
    return terms.unionByName(rules).unionByName(counts[0]).unionByName(counts[1])


def data_dictionary(fields: DataFrame, keys: tuple[str, ...], most: int = MOST_ENTRIES) -> DataFrame:
    """The first entries by their keys."""
    return fields.orderBy(*keys).limit(most)


def introduction(systems: DataFrame, key: str = "project") -> DataFrame:
    """The introduction that a report gives of each system, in order: (key, section, position, heading, text).

    ``systems`` are (key, body, n_modules), the body being the summary of a system as JSON.  What a
    summary lacks is replaced by a set sentence; without processes the modules are counted.  Members of a
    list that aren't objects are left out.  A null body, or one that is no JSON, is a summary that lacks everything.
    """
    body = F.try_parse_json("body")
    text = lambda path: F.try_variant_get(body, path, "string")
    listed = lambda path: F.coalesce(F.try_variant_get(body, path, "array<variant>"), F.array().cast("array<variant>"))
    own = systems.select(key, "n_modules", text(NARRATIVE).alias("narrative"), text(PURPOSE).alias("purpose"), listed(PROCESSES).alias("processes"), listed(ACRONYMS).alias("acronyms"), listed(TERMS).alias("terms"))
    entry = lambda heading, text: F.struct(heading.cast("string").alias("heading"), text.cast("string").alias("text"))
    none = F.lit(None)
    paragraphs = F.filter(F.transform(F.split("narrative", "\n"), lambda x: F.btrim(x, F.lit(" \t\r"))), lambda x: x != "")
    overview = F.when(F.col("narrative") != "", F.transform(paragraphs, lambda x: entry(none, x))).otherwise(F.array(entry(none, F.coalesce("purpose", F.lit(NO_OVERVIEW)))))

    def members(items: str, heading: str, value: str, default: str | None) -> Column:
        objects = F.filter(items, lambda x: F.startswith(F.schema_of_variant(x), F.lit("OBJECT")))
        get = lambda x, name: F.try_variant_get(x, f"$.{name}", "string")
        return F.transform(objects, lambda x: entry(F.coalesce(get(x, heading), F.lit(default or "")), F.coalesce(get(x, value), F.lit(""))))

    counted = F.concat(F.lit(NO_PROCESSES[0]), F.col("n_modules").cast("string"), F.lit(NO_PROCESSES[1]))
    processes = F.when(F.size("processes") > 0, F.concat(F.array(entry(none, F.lit(PROCESS_LEAD))), members("processes", "process_name", "description", "Process"))).otherwise(F.array(entry(none, counted)))
    glossary = F.slice(F.when(F.size("acronyms") > 0, members("acronyms", "term", "definition", None)).otherwise(members("terms", "term", "definition", None)), 1, MOST_TERMS)
    sections = (("overview", overview), ("purpose", F.array(entry(none, F.coalesce("purpose", F.lit(NO_PURPOSE))))), ("processes", processes), ("glossary", glossary))
    told = F.flatten(F.array(*(F.transform(rows, lambda x, i: F.struct(F.lit(name).alias("section"), (i + 1).alias("position"), x["heading"].alias("heading"), x["text"].alias("text"))) for name, rows in sections)))
    return own.select(key, F.explode(told).alias("r")).select(key, "r.*")
