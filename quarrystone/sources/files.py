"""Source files as tables: discovery, decoding, size guards and the lines table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.functions.text import keep_last

# Size limits in MB by file type.
LIMITS_MB = {"cobol": 10, "copybook": 5, "jcl": 2, "rexx": 5, "catproc": 2, "proc": 2, "pli": 10}
DEFAULT_LIMIT_MB = 5

# Limits of parsers in MB, and what an empty file is to them.
PARSER_LIMITS = {"cobol": (50, "error"), "copybook": (10, "warning")}

# Words of which two make a decoded text plausible, by file type.
COBOL_WORDS = ("DIVISION", "SECTION", "PROCEDURE", "WORKING-STORAGE", "PERFORM", "MOVE", "IF", "END-IF", "CALL", "COPY")
COPYBOOK_WORDS = ("PIC", "PICTURE", "OCCURS", "REDEFINES", "VALUE", "COMP", "BINARY", "FILLER", "COPY")
# One of these operations makes an assembler text plausible.
ASSEMBLER_WORDS = r"\b(?:CSECT|DSECT|MACRO|USING|LR|L|MVC|END)\b"


def find_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files under a folder, however deep, as (filename, length, modified, content)."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("filename"), "length", F.col("modificationTime").alias("modified"), "content")


def catalogue(files: DataFrame, project_id: str, file_type: str | None = None) -> DataFrame:
    """Files of a project, or of one type of it, in their order."""
    own = files.where(F.col("project_id") == project_id)
    return (own if file_type is None else own.where(F.col("file_type") == file_type)).orderBy("file_type", "filename")


def upsert(files: DataFrame, uploads: DataFrame, keys: Sequence[str] = ("project_id", "file_type", "filename")) -> DataFrame:
    """The latest row of each key; both tables have ``uploaded_at`` and ``upload_no``."""
    return keep_last(files.unionByName(uploads), list(keys), ["uploaded_at", "upload_no"])


def oversized(files: DataFrame) -> DataFrame:
    """Files over the limit of their type, or empty, with the reason."""
    limit = F.lit(DEFAULT_LIMIT_MB)
    for kind, mb in LIMITS_MB.items():
        limit = F.when(F.col("file_type") == kind, F.lit(mb)).otherwise(limit)
    size = F.octet_length("content")
    reason = F.when(size == 0, "empty file").when(size > limit * 1024 * 1024, F.concat(F.lit("over "), limit.cast("string"), F.lit(" MB")))
    return files.withColumn("reason", reason).where("reason is not null").drop("content")


def parser_guard(files: DataFrame) -> DataFrame:
    """Files (filename, file_type, content) that a parser refuses or warns of: (filename, level, reason).

    Programs and copybooks have limits of their own; an empty copybook is a warning, an empty program an error.
    """
    size, kind = F.octet_length("content"), F.lower("file_type")
    rows = F
    for name, (mb, level) in PARSER_LIMITS.items():
        rows = rows.when((kind == name) & (size == 0), F.struct(F.lit(level).alias("level"), F.lit("File is empty").alias("reason")))
        rows = rows.when((kind == name) & (size > mb * 1024 * 1024), F.struct(F.lit("error").alias("level"), F.lit(f"File exceeds maximum size of {mb} MB").alias("reason")))
    return files.select("filename", rows.otherwise(F.lit(None)).alias("r")).where("r is not null").select("filename", "r.*")


def control_share_ok(text: Column) -> Column:
    head = F.substr(text, F.lit(1), F.lit(1000))
    return F.char_length(head) - F.char_length(F.regexp_replace(head, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")) <= 10


def looks_like(text: Column, words: Sequence[str] = COBOL_WORDS, least: int = 2) -> Column:
    """At least so many of the words occur and few control characters do."""
    upper = F.upper(text)
    hits = sum((F.when(F.contains(upper, F.lit(w)), 1).otherwise(0) for w in words), F.lit(0))
    return control_share_ok(text) & (hits >= least)


def _page(name: str) -> str:
    """The 256 characters of a code page from the codec's own table.  cp1047, which lacks one, is cp037 with three pairs of bytes swapped."""
    if name != "cp1047":
        return bytes(range(256)).decode(name, errors="replace")
    table = list(bytes(range(256)).decode("cp037"))
    for a, b in ((0x5F, 0xB0), (0xAD, 0xBA), (0xBD, 0xBB)):
        table[a], table[b] = table[b], table[a]
    return "".join(table)


#: EBCDIC code pages that are tried, in this order.
CODE_PAGES = ("cp1047", "cp037", "cp500", "cp875")


def ebcdic(content: Column, page: str = "cp037") -> Column:
    """Text of EBCDIC bytes: a byte-for-byte translation; the next-line character becomes a line feed."""
    latin = "".join(map(chr, range(256)))
    table = _page(page).replace("\x85", "\n")
    same = [i for i in range(1, 256) if latin[i] != table[i]]
    return F.translate(F.decode(content, "ISO-8859-1"), "".join(latin[i] for i in same), "".join(table[i] for i in same))


def decoded(files: DataFrame, words: Sequence[str] = COBOL_WORDS, pages: Sequence[str] = CODE_PAGES) -> DataFrame:
    """Adds ``encoding`` and ``text``: UTF-8 if valid and plausible, else the first plausible EBCDIC page, else UTF-8 with replacements."""
    utf8 = F.try_validate_utf8(F.col("content").cast("string"))
    encoding = F.when(utf8.isNotNull() & looks_like(utf8, words), "utf-8")
    text = F.make_valid_utf8(F.col("content").cast("string"))
    for page in pages:
        encoding = encoding.when(looks_like(ebcdic(F.col("content"), page), words), page)
    out = files.withColumn("encoding", encoding.otherwise("utf-8-replace"))
    for page in pages:
        text = F.when(F.col("encoding") == page, ebcdic(F.col("content"), page)).otherwise(text)
    return out.withColumn("text", F.regexp_replace(text, "\r\n?", "\n"))


def _always(text: Column) -> Column:
    return F.lit(True)


def decoded_as(files: DataFrame, kind: str, pages: Sequence[str] = CODE_PAGES) -> DataFrame:
    """Adds ``encoding`` and ``text`` by the rule of a file type.

    UTF-8 or an EBCDIC page is taken where the text is plausible for the type: two
    words for COBOL and copybooks, an operation for assembler, PROC or DCL in PL/I pages;
    scripts and parameter members are taken as they can be decoded first, schedules
    know one page, and table declarations try the pages before UTF-8.  Else UTF-8 with
    replacements, for PL/I Latin-1.
    """
    has = lambda *words: lambda t: reduce(lambda a, b: a | b, (F.contains(t, F.lit(w)) for w in words))
    sql = lambda t: F.contains(F.upper(t), F.lit("EXEC SQL"))
    in_utf8, in_page = {
        "cobol": (looks_like, looks_like),
        "copybook": (lambda t: looks_like(t, COPYBOOK_WORDS), lambda t: looks_like(t, COPYBOOK_WORDS)),
        "assembly": (lambda t: F.upper(t).rlike(ASSEMBLER_WORDS), lambda t: F.upper(t).rlike(ASSEMBLER_WORDS)),
        "pli": (_always, has("PROC", "DCL")),
        "rexx": (_always, _always),
        "parmlib": (_always, _always),
        "ca7": (_always, _always),
        "dclgen": (sql, sql),
    }[kind]
    own = {"ca7": pages[:1], "dclgen": pages[:3]}.get(kind, pages)
    raw = F.col("content").cast("string")
    utf8 = [("utf-8", F.try_validate_utf8(raw), in_utf8)]
    by_page = [(page, ebcdic(F.col("content"), page), in_page) for page in own]
    rest = ("latin-1", F.decode("content", "ISO-8859-1")) if kind == "pli" else ("utf-8-replace", F.make_valid_utf8(raw))
    encoding, text = F, F
    for name, t, fits in by_page + utf8 if kind == "dclgen" else utf8 + by_page:
        taken = t.isNotNull() & fits(t)
        encoding, text = encoding.when(taken, F.lit(name)), text.when(taken, t)
    return files.withColumn("encoding", encoding.otherwise(F.lit(rest[0]))).withColumn("text", F.regexp_replace(text.otherwise(rest[1]), "\r\n?", "\n"))


def rejects(files: DataFrame, *parsed: DataFrame) -> DataFrame:
    """Files without a row in any of the parsed tables, with the reason: (filename, reason)."""
    seen = reduce(DataFrame.unionByName, [p.select("filename") for p in parsed]).distinct()
    left = files.join(seen, "filename", "left_anti")
    return left.select("filename", F.when(F.col("text").isNull(), "not decoded").when(F.btrim("text", F.lit(" \t\n")) == "", "empty file").otherwise("nothing recognised").alias("reason"))


def lines(files: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """One row a line with its number from 1."""
    return files.select(*keys, F.posexplode(F.split(text, "\n")).alias("pos", "line")).select(*keys, (F.col("pos") + 1).alias("line_no"), F.col("line").alias("text"))


def write_relations(relations: dict[str, DataFrame], path: str) -> None:
    """Each flat relation as a Parquet table of its own folder."""
    for name, rows in relations.items():
        rows.write.mode("overwrite").parquet(f"{path}/{name}")


def markdown_table(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows of a Markdown table, written by the cluster: (line)."""
    cells = F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns))
    return df.orderBy(*order).select(F.concat(F.lit("| "), cells, F.lit(" |")).alias("line"))
