"""Answers of a summariser as tables: headed sections, lists, texts that go on, fenced JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Headings by the field that each fills.
# A heading of a text or an entry is followed by its value; a text goes on in the next lines.
TEXTS = {"purpose:": "purpose"}
ENTRIES = {"entity:": "entity"}
# A value stands on the line of its heading and leaves open what was open before.
VALUES = {"table name:": "table_name", "host variable structure:": "host_structure"}
# A list takes the items after its heading.
LISTS = {
    "workload identity:": "workload_identity",
    "dependencies & triggers:": "dependencies_triggers",
    "operational rules:": "operational_rules",
    "table structure:": "table_structure",
    "functionalities:": "functionalities",
    "key operations:": "key_operations",
    "workflow steps:": "steps",
    "main datasets:": "main_datasets",
    "notes:": "notes",
    "key fields:": "key_fields",
    "register usage:": "register_usage",
    "configuration areas:": "configuration_areas",
    "key parameters:": "key_parameters",
}

_SPACE = " \t\r\f\u000b"


def section_parts(texts: DataFrame, key: str = "filename") -> DataFrame:
    """(key, line, field, part, starts): what each line adds to which field.

    A line with a heading starts its field; items of a list and further lines of a text
    belong to the field that was opened last.  Items outside a list, lines after
    a list or an entry, and headings without a value add nothing; blank lines close nothing.
    Keys are unique; a text that is null or blank has no rows.
    """
    own = texts.select(key, F.posexplode(F.split("text", "\n")).alias("line", "t")).withColumn("t", F.btrim("t", F.lit(_SPACE))).where("t <> ''")
    low = F.lower("t")
    heads = F
    for heading, field in {**TEXTS, **ENTRIES, **VALUES, **LISTS}.items():
        heads = heads.when(F.startswith(low, F.lit(heading)), F.lit(field))
    own = own.withColumn("head", heads.otherwise(F.lit(None).cast("string")))
    opens = F.when(F.col("head").isNotNull() & ~F.col("head").isin(*VALUES.values()), F.col("head"))
    own = own.withColumn("open", F.last(opens, True).over(Window.partitionBy(key).orderBy("line")))
    rest = F.btrim(F.substr("t", F.locate(":", F.col("t")) + 1), F.lit(_SPACE))
    item = F.startswith("t", F.lit("- "))
    in_list, in_text = F.col("open").isin(*LISTS.values()), F.col("open").isin(*TEXTS.values())
    field = F.when(F.col("head").isNotNull(), F.when(~F.col("head").isin(*LISTS.values()), F.col("head"))).when(item & in_list, F.col("open")).when(~item & in_text & ~F.endswith("t", F.lit(":")), F.col("open"))
    part = F.when(F.col("head").isNotNull(), rest).when(item, F.btrim(F.substr("t", F.lit(3)), F.lit(_SPACE))).otherwise(F.col("t"))
    return own.select(key, "line", field.alias("field"), part.alias("part"), F.col("head").isNotNull().alias("starts")).where("field is not null")


def sections(texts: DataFrame, key: str = "filename") -> DataFrame:
    """One row for each text (key, text): its texts and values as strings, its lists as arrays, in order.

    What isn't there is an empty string or array, as all is for a text that is null.  Of
    headings that come again the last counts for texts and values; lists go on.
    """
    ordered = F.array_sort(F.collect_list(F.struct("line", "field", "part", "starts"))).alias("parts")
    joined = texts.select(key).join(section_parts(texts, key).groupBy(key).agg(ordered), key, "left")
    of = lambda field: F.filter("parts", lambda p: p["field"] == field)

    def text(field: str) -> Column:
        own = of(field)
        first = F.array_max(F.transform(F.filter(own, lambda p: p["starts"]), lambda p: p["line"]))
        return F.array_join(F.transform(F.filter(own, lambda p: p["line"] >= first), lambda p: p["part"]), " ")

    strings = {f: text(f) for f in (*TEXTS.values(), *ENTRIES.values(), *VALUES.values())}
    lists = {f: F.transform(of(f), lambda p: p["part"]) for f in LISTS.values()}
    empty = F.array().cast("array<string>")
    return joined.select(key, *(F.coalesce(c, F.lit("")).alias(f) for f, c in strings.items()), *(F.coalesce(c, empty).alias(f) for f, c in lists.items()))


def unfenced(text: Column | str) -> Column:
    """A text without the fences around code, closed or not."""
    bare = F.replace(F.replace(F.col(text) if isinstance(text, str) else text, F.lit("```json"), F.lit("")), F.lit("```"), F.lit(""))
    return F.btrim(bare, F.lit(_SPACE + "\n"))


def fenced_json(answers: DataFrame, key: str = "filename", text: str = "text") -> DataFrame:
    """(key, body variant, error): the JSON of each answer, fenced or bare; a null text and one that is no JSON have an error and no body."""
    body = F.try_parse_json(unfenced(text))
    return answers.select(key, body.alias("body")).withColumn("error", F.when(F.col("body").isNull(), "no JSON"))
