"""What a system as a whole consists of, from summaries of its files and from written reports.

Summaries: (filename, file_type, analysis), types in upper case, analysis as text.
Reports: (name, text) in Markdown.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.functions.text import extract_all, first_match
from quarrystone.sources.files import lines

CODE = ("COBOL", "PLI", "ASSEMBLY", "REXX")
CONFIG = ("PARMLIB", "CONTROL_CARD")
DATA = ("DCLGEN", "SQL", "COPYBOOK")

# Words that show a product in the analysis of a file.
UTILITY_WORDS = ("DFSORT", "IDCAMS", "IEBGENER", "IKJEFT", "DSNUPROC", "DB2 LOAD")
MIDDLEWARE = {"IBM MQ": ("MQ",), "File Transfer (FTP/Connect:Direct)": ("FTP", "NDM"), "XML Parsing": ("XML",), "JSON Parsing": ("JSON",)}


def has_any(text: Column, words: Sequence[str]) -> Column:
    """Whether any of the words occurs, whatever its case; false for null."""
    upper = F.upper(F.coalesce(text, F.lit("")))
    out = F.lit(False)
    for word in words:
        out = out | F.contains(upper, F.lit(word))
    return out


def of_layer(file_type: Column) -> Column:
    """jcl, code, data, config or other."""
    return F.when(file_type == "JCL", "jcl").when(file_type.isin(*CODE), "code").when(file_type.isin(*DATA), "data").when(file_type.isin(*CONFIG), "config").otherwise("other")


def scope(summaries: DataFrame) -> DataFrame:
    """Files by type and layer."""
    return summaries.groupBy("file_type").agg(F.count("*").alias("files")).withColumn("layer", of_layer(F.col("file_type")))


def features(summaries: DataFrame) -> DataFrame:
    """One row of counts of files that show a product."""
    kind, text = F.col("file_type"), F.col("analysis")
    code, config = kind.isin(*CODE), kind.isin(*CONFIG)
    counted = {
        "config": config,
        "utilities": config & has_any(text, UTILITY_WORDS),
        "jcl": kind == "JCL",
        "code": code,
        "db2": kind.isin("DCLGEN", "SQL") | (code & has_any(text, ("EXEC SQL",))),
        "vsam": code & has_any(text, ("VSAM", "INDEXED")),
        "cics": code & has_any(text, ("CICS",)),
        "ims": code & has_any(text, ("DL/I", "IMS")),
        "rexx": kind == "REXX",
        **{name: code & has_any(text, words) for name, words in MIDDLEWARE.items()},
    }
    return summaries.agg(*(F.count_if(c).alias(n) for n, c in counted.items()), F.array_join(F.array_sort(F.collect_set(F.when(kind.isin(*CODE, "JCL"), kind))), ", ").alias("languages"))


def landscape(summaries: DataFrame) -> DataFrame:
    """Infrastructure layers and what was found of each: (layer, components)."""
    n = F.col
    listed = lambda *parts: F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull()), ", ")
    counted = lambda name, before, after: F.when(n(name) > 0, F.concat(F.lit(before), n(name).cast("string"), F.lit(after)))
    system = F.when((n("config") > 0) & (n("utilities") > 0), "IBM z/OS (Confirmed via Utility Control Cards)").when(n("config") > 0, "IBM z/OS (Inferred from System Config)").when(n("jcl") > 0, "IBM Mainframe Compatible (z/OS, VSE, or Re-hosted)").when(n("code") > 0, "Cross-Platform (COBOL/PLI Runtime)").otherwise("Unknown Environment")
    or_else = lambda c, default: F.coalesce(F.nullif(c, F.lit("")), F.lit(default))
    rows = {
        "Operating System": system,
        "Programming Languages": n("languages"),
        "Data Persistence": or_else(listed(F.when(n("db2") > 0, "IBM DB2 (Relational)"), counted("vsam", "VSAM (KSDS/ESDS, ", " modules)")), "Flat Files / Sequential"),
        "Execution Environment": or_else(listed(counted("cics", "CICS Transaction Server (", " modules)"), counted("ims", "IMS Transaction Manager (", " modules)"), counted("jcl", "Batch Processing (JES, ", " jobs)"), counted("rexx", "TSO/E Interactive (", " scripts)")), "Standard z/OS Environment"),
        "Integration & Middleware": or_else(listed(*(F.when(F.col(f"`{m}`") > 0, m) for m in MIDDLEWARE)), "File-Based Integration"),
    }
    return features(summaries).select(F.explode(F.array(*(F.struct(F.lit(k).alias("layer"), v.alias("components")) for k, v in rows.items()))).alias("r")).select("r.*")


def feeds(datasets: DataFrame, disposition: str, k: int = 15) -> DataFrame:
    """Distinct (dataset, job) whose usage has the disposition, the first k by name: OLD comes in, NEW goes out."""
    return datasets.where(F.contains(F.upper("usage"), F.lit(disposition))).select("dataset", "job").distinct().orderBy("dataset", "job").limit(k)


# ---- Reports ---------------------------------------------------------------


def bullets_under(reports: DataFrame, heading: str) -> DataFrame:
    """Bullets after a line with the heading, up to the next bold line or section, by report: (name, bullets)."""
    own = lines(reports, "name")
    opens = F.contains("text", F.lit(heading))
    closes = ~opens & (F.startswith("text", F.lit("**")) | F.startswith("text", F.lit("##")))
    state = F.last(F.when(opens, 1).when(closes, 0), ignorenulls=True).over(Window.partitionBy("name").orderBy("line_no"))
    marked = own.withColumn("open", F.coalesce(state, F.lit(0)) == 1).withColumn("bullet", F.startswith("text", F.lit("- ")) & ~opens)
    return marked.groupBy("name").agg(F.count_if(F.col("open") & F.col("bullet")).alias("bullets"))


def numbered_entries(reports: DataFrame) -> DataFrame:
    """Headings of the form ``### F12:`` by report: (name, entries)."""
    return reports.select("name", F.coalesce(F.regexp_count("text", F.lit(r"(?m)^### F\d+:")), F.lit(0)).alias("entries"))


def files_in_headings(reports: DataFrame) -> DataFrame:
    """File names that are a heading: (name, filename)."""
    return reports.select("name", F.explode(extract_all("text", r"(?m)^### ([\w\-]+\.\w+)$")).alias("filename"))


def implementers(reports: DataFrame, label: str = "Implemented By") -> DataFrame:
    """Distinct programs of comma lists after a bold label: (name, program)."""
    found = reports.select("name", F.explode(extract_all("text", rf"(?m)\*\*{label}\*\*:\s*([^\n]+)$")).alias("list"))
    return found.select("name", F.explode(F.transform(F.split("list", ","), lambda x: F.btrim(x))).alias("program")).where("program <> ''").distinct()


def coverage(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """One row: keys expected, how many of them were found, percent with one decimal; 100 when nothing is expected."""
    seen = found.select(key).distinct().withColumn("__seen", F.lit(1))
    both = expected.select(key).distinct().join(seen, key, "left")
    n, m = F.count("*"), F.count("__seen")
    return both.agg(n.alias("expected"), m.alias("covered"), F.when(n == 0, F.lit(100.0)).otherwise(F.round(100.0 * m / n, 1)).alias("percent"))


def functional_groups(modules: DataFrame, categories: Mapping[str, Sequence[str]], other: str = "OTHER") -> DataFrame:
    """Programs by the first category one of whose words the name or description has: (category, programs, names)."""
    out = F.lit(other)
    for name, words in reversed(categories.items()):
        out = F.when(has_any(F.concat_ws(" ", "name", "description"), words), name).otherwise(out)
    return modules.withColumn("category", out).groupBy("category").agg(F.count("*").alias("programs"))


def described(reports: DataFrame, datasets: DataFrame) -> DataFrame:
    """Datasets with the description of the first step, by (job, step), that mentions one: equal names are joined, so texts aren't compared with all datasets.

    A mention is a whole dotted name in the description.
    """
    mentions = reports.select("job", "step", "description", F.explode(F.array_distinct(extract_all(F.upper("description"), r"([A-Z@#$][A-Z0-9@#$-]*(?:\.[A-Z0-9@#$-]+)+)"))).alias("dataset"))
    first = mentions.groupBy("dataset").agg(F.min(F.struct("job", "step", "description")).alias("m"))
    return datasets.select("dataset").distinct().join(first, "dataset", "left").select("dataset", "m.job", "m.step", "m.description")


def session_state(log: DataFrame, last: int = 15) -> DataFrame:
    """By session: its last converted components in their order, distinct files and errors; log (session, seq, event, detail)."""
    newest = Window.partitionBy("session").orderBy(F.desc("seq"))
    recent = log.where("event = 'converted'").withColumn("__n", F.row_number().over(newest)).where(F.col("__n") <= last)
    named = recent.groupBy("session").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "detail"))), lambda x: x["detail"]).alias("converted"))
    counts = log.groupBy("session").agg(F.count_distinct(F.when(F.col("event") == "file", F.col("detail"))).alias("files"), F.count_if(F.col("event") == "error").alias("errors"))
    return counts.join(named, "session", "left").select("session", "converted", "files", "errors")


def snippets(log: DataFrame, word: str, hits: int = 3, size: int = 500) -> DataFrame:
    """The first hits of a word by session, whatever its case, cut to a length: (session, seq, snippet)."""
    found = log.where(F.contains(F.upper("text"), F.upper(F.lit(word))))
    first = found.withColumn("__n", F.row_number().over(Window.partitionBy("session").orderBy("seq"))).where(F.col("__n") <= hits)
    return first.select("session", "seq", F.substr("text", F.lit(1), F.lit(size)).alias("snippet"))


def section_titles(reports: DataFrame) -> DataFrame:
    """Headings with their level: (name, line_no, level, title)."""
    return lines(reports, "name").where(F.col("text").rlike(r"^#{1,6} ")).select("name", "line_no", F.length(first_match("text", r"^(#+)")).alias("level"), F.regexp_extract("text", r"^#+\s+(.*)$", 1).alias("title"))
