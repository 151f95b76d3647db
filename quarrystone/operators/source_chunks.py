"""Source texts cleaned by language and cut into named chunks.

Cleaning is a column expression on the text; cutting is a running count of
boundary lines within a file.  Every cutter takes files (filename, text) and
returns (filename, chunk, kind, name, start_line, end_line, text), lines counted
in the cleaned text.  Null and blank texts have no chunks; blank chunks are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.functions.text import carried, extract_all, first_match, once, truncated
from quarrystone.operators.chunks import sliding
from quarrystone.sources.files import lines

COLUMNS = ("filename", "chunk", "kind", "name", "start_line", "end_line", "text")
VOTERS = 50  # lines that vote on sequence numbers

# Lines of schedule listings that belong to the print-out, and job names that are none.
LISTING_NOISE = r"(?i)^\s*(?:DATE:|LIST:|TIME:|PAGE:|-+\s*$|END OF LIST)"
NO_JOBS = ("DATE", "TIME", "PAGE", "LIST", "SYS")
# Words that make a comment line of a parameter member a header.
HEADER_WORDS = ("SYSTEM", "IPL", "SUBSYSTEM", "DATASET", "DEVICE", "STORAGE", "PROGRAM", "LIBRARY", "EXIT", "SMF", "JES", "CATALOG", "SECURITY", "NETWORK", "VTAM", "CICS", "DB2", "IMS", "ALLOCATION", "SCHEDULER", "CONSOLE", "OPERATOR")
# Words that end a statement on a line of their own without being a paragraph.
NO_PARAGRAPHS = ("EXIT", "GOBACK", "END-IF", "END-PERFORM", "END-EVALUATE", "END-READ", "CONTINUE")


def has_sequence(text: Column, width: int, blank_counts: bool = True) -> Column:
    """Over 80 % of the first 50 lines that are long enough start with digits (or blanks) only."""
    heads = F.slice(F.split(text, "\n"), 1, VOTERS)
    voters = F.filter(heads, lambda x: F.char_length(x) >= (width if blank_counts else width + 1))
    pattern = rf"^(?: *\d+ *| {{{width}}})$" if blank_counts else rf"^\d{{{width}}}$"
    numeric = F.filter(voters, lambda x: F.substr(x, F.lit(1), F.lit(width)).rlike(pattern))
    return (F.size(voters) > 0) & (F.size(numeric) * 10 > F.size(voters) * 8)


def without_sequence(text: Column, width: int, blank_counts: bool = True) -> Column:
    return F.when(has_sequence(text, width, blank_counts), F.regexp_replace(text, rf"(?m)^.{{{width}}}", "")).otherwise(text)


def _kept_lines(text: Column, keep: Callable[[Column], Column]) -> Column:
    return F.array_join(F.filter(F.split(text, "\n"), keep), "\n")


def clean_cobol(text: Column) -> Column:
    """Also for copybooks: without sequence columns and comment lines."""
    return _kept_lines(without_sequence(text, 6), lambda x: ~F.ltrim(x).rlike("^[*/]"))


def clean_jcl(text: Column) -> Column:
    cut = F.transform(F.split(text, "\n"), lambda x: F.substr(x, F.lit(1), F.lit(72)))
    return F.array_join(F.filter(cut, lambda x: F.startswith(x, F.lit("//")) & ~F.startswith(x, F.lit("//*"))), "\n")


def clean_pli(text: Column) -> Column:
    """Without sequence numbers and the blank after them, where most lines have one; a comment leaves a space."""
    plain = F.when(has_sequence(text, 6, blank_counts=False), F.regexp_replace(text, r"(?m)^[0-9]{6} (?=[^\n]{2})", "")).otherwise(text)
    return _squeezed(F.regexp_replace(plain, r"(?s)/\*.*?\*/", " "))


def clean_include(text: Column) -> Column:
    """An included PL/I member: a comment leaves a space, sequence columns stay."""
    return _squeezed(F.regexp_replace(text, r"(?s)/\*.*?\*/", " "))


def _squeezed(text: Column) -> Column:
    """Without blank lines and without white space at either end."""
    return F.btrim(F.regexp_replace(text, r"\n\s*\n", "\n"), F.lit(" \t\n\r\f\u000b"))


def clean_assembler(text: Column) -> Column:
    """Without comments and blank lines; continued lines (column 72) joined with column 16 of the next."""
    joined = F.regexp_replace(text, r"(?m)(?<=^[^\n]{71})\S[^\n]*\n {15}", "")
    return _kept_lines(joined, lambda x: (F.btrim(x) != "") & ~F.startswith(x, F.lit("*")))


def clean_rexx(text: Column) -> Column:
    return without_sequence(text, 8)


def clean_schedule(text: Column) -> Column:
    return _kept_lines(text, lambda x: ~x.rlike(LISTING_NOISE))


def clean_parameters(text: Column) -> Column:
    return F.regexp_replace(text, r"(?m)[ \t]+$", "")


def whole(files: DataFrame, clean: Callable[[Column], Column], kind: str) -> DataFrame:
    """The cleaned file as one chunk."""
    own = files.select("filename", clean(F.col("text")).alias("text")).where(F.btrim("text") != "")
    return own.select("filename", F.lit(0).cast("long").alias("chunk"), F.lit(kind).alias("kind"), F.col("filename").alias("name"), F.lit(1).alias("start_line"), F.size(F.split("text", "\n")).alias("end_line"), "text")


def _cut(marked: DataFrame, first_kind: str, first_name: str) -> DataFrame:
    """Chunks from lines with ``kind`` and ``name`` at boundaries, null elsewhere."""
    order = Window.partitionBy("filename").orderBy("line_no")
    numbered = marked.withColumn("chunk", F.count("kind").over(order))
    grouped = numbered.groupBy("filename", "chunk").agg(F.max("kind").alias("kind"), F.max("name").alias("name"), F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"), F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("ls"))
    text = F.array_join(F.transform("ls", lambda x: x["text"]), "\n")
    return grouped.select("filename", "chunk", F.coalesce("kind", F.lit(first_kind)).alias("kind"), F.coalesce("name", F.lit(first_name)).alias("name"), "start_line", "end_line", text.alias("text")).where(F.btrim("text", F.lit(" \t\n")) != "")


def _cut_within(marks: Column, first_kind: str, first_name: str) -> Column:
    """Chunks of an array of lines (text, kind, name), as ``_cut`` gives them, cut within the array."""
    at = F.filter(F.transform(marks, lambda m, i: F.when(m["kind"].isNotNull(), i)), lambda i: i.isNotNull())
    before = F.filter(F.array(F.lit(-1)), lambda _: F.get(marks, F.lit(0))["kind"].isNull())

    def cut(at: Column) -> Column:
        def chunk(start: Column, i: Column) -> Column:
            first = F.greatest(start, F.lit(0))
            end = F.coalesce(F.get(at, i + 1), F.size(marks))
            text = F.array_join(F.transform(F.slice(marks, first + 1, end - first), lambda m: m["text"]), "\n")
            number = i + F.when(F.get(at, F.lit(0)) == -1, 0).otherwise(1)
            own = lambda c, other: F.when(start == -1, F.lit(other)).otherwise(F.get(marks, first)[c])
            return F.struct(number.cast("long").alias("chunk"), own("kind", first_kind).alias("kind"), own("name", first_name).alias("name"), (first + 1).alias("start_line"), end.alias("end_line"), text.alias("text"))

        return F.filter(F.transform(at, chunk), lambda c: F.btrim(c["text"], F.lit(" \t\n")) != "")

    return once(F.concat(before, at), cut)


def _each_or_whole(files: DataFrame, clean: Callable[[Column], Column], cut: Callable[[Column], Column]) -> DataFrame:
    """The chunks that ``cut`` gives of the lines of a cleaned text, or else the text as one chunk, in one pass over the files."""

    def chunks(text: Column) -> Column:
        one = F.struct(F.lit(0).cast("long").alias("chunk"), F.lit("whole").alias("kind"), F.col("filename").alias("name"), F.lit(1).alias("start_line"), F.size(F.split(text, "\n")).alias("end_line"), text.alias("text"))
        rest = F.filter(F.array(one), lambda c: F.btrim(c["text"]) != "")
        return once(once(F.split(text, "\n"), cut), lambda found: F.when(F.size(found) > 0, found).otherwise(rest))

    return files.where("text is not null").select("filename", F.explode(once(clean(F.col("text")), chunks)).alias("c")).select("filename", "c.*").select(*COLUMNS)


def _rest_whole(chunks: DataFrame, files: DataFrame, clean: Callable[[Column], Column], kind: str) -> DataFrame:
    rest = whole(files, clean, kind).join(chunks.select("filename").distinct(), "filename", "left_anti")
    return chunks.select(*COLUMNS).unionByName(rest.select(*COLUMNS))


def _cleaned_lines(files: DataFrame, clean: Callable[[Column], Column]) -> DataFrame:
    return lines(files.select("filename", clean(F.col("text")).alias("text")), "filename")


def cobol(files: DataFrame) -> DataFrame:
    """Divisions, and the paragraphs of the procedure division after its header; a file without divisions is one chunk."""
    division = lambda x: F.upper(first_match(x, r"(?i)^\s*(\w+)\s+DIVISION\b"))
    word = lambda x: F.upper(first_match(x, r"(?i)^\s*([A-Z0-9][A-Z0-9_-]*)\s*\.\s*$"))

    def marked(x: Column) -> Column:
        named = lambda w: F.when((x["within"] == "PROCEDURE") & w.rlike("[A-Z]") & ~w.isin(*NO_PARAGRAPHS), w)
        header = F.struct(x["text"].alias("text"), F.when(x["division"] == "PROCEDURE", "division_header").otherwise("division").alias("kind"), x["division"].alias("name"))
        paragraph = once(named(word(x["text"])), lambda w: F.struct(x["text"].alias("text"), F.when(w.isNotNull(), "paragraph").alias("kind"), w.alias("name")))
        return F.when(x["division"].isNotNull(), header).otherwise(paragraph)

    def cut(ls: Column) -> Column:
        divided = lambda ds: F.when(F.exists(ds, lambda d: d.isNotNull()), once(F.transform(F.arrays_zip(ls.alias("text"), ds.alias("division"), carried(ds).alias("within")), marked), lambda m: _cut_within(m, "header", "HEADER")))
        return once(F.transform(ls, division), divided)

    return _each_or_whole(files, clean_cobol, cut)


def pli(files: DataFrame) -> DataFrame:
    """A header, procedures and labelled statements."""
    own = _cleaned_lines(files, clean_pli)
    label = F.upper(first_match("text", r"^\s*([\w#$@]+)\s*:(?!=)"))
    procedure = F.col("text").rlike(r"(?i)^\s*[\w#$@]+\s*:\s*PROC(?:EDURE)?\b")
    return _rest_whole(_cut(own.withColumn("name", label).withColumn("kind", F.when(procedure, "procedure").when(label.isNotNull(), "label")), "header", "HEADER"), files, clean_pli, "whole")


def schedule(files: DataFrame) -> DataFrame:
    """One chunk a job; wildcard jobs and what stands before the first job are left out."""
    own = _cleaned_lines(files, clean_schedule)
    starts = F.col("text").rlike(r"(?i)^(?!\s*DEP-JOB:).*?(?<!DEP-)JOB:\s+\S")
    name = F.upper(F.regexp_extract("text", r"(?i)(?<!DEP-)JOB:\s+(\S+)", 1))
    text = F.when(starts, F.regexp_replace("text", r"(?i)^.*?(?<!DEP-)JOB:\s+", "JOB: ")).otherwise(F.col("text"))
    found = _cut(own.select("filename", "line_no", F.when(starts, "job_definition").alias("kind"), F.when(starts, name).alias("name"), text.alias("text")), "header", "HEADER")
    return found.where((F.col("kind") == "job_definition") & ~F.contains("name", F.lit("*")) & ~F.col("name").isin(*NO_JOBS))


def assembler(files: DataFrame, least: int = 4) -> DataFrame:
    """Sections, labels and data areas of at least so many lines; shorter ones stay with the chunk before."""
    own = _cleaned_lines(files, clean_assembler)
    data = F.col("text").rlike(r"^[A-Z0-9_@#$]{1,8}\s+(?:DS|DC|EQU|EXTRN|WXTRN)\b")
    section = F.col("text").rlike(r"(?i)^\s*(?:[A-Z0-9_@#$]{1,63})?\s+(?:CSECT|DSECT|RSECT|COM|LOCTR)\b")
    label = F.col("text").rlike(r"^[A-Z0-9_@#$]{1,8}\s+(?!(?:DS|DC|EQU|ORG|LTORG|EXTRN|WXTRN|SPACE|EJECT|PRINT|TITLE|COPY|MACRO|MEND)\b)")
    order = Window.partitionBy("filename").orderBy("line_no")
    own = own.withColumn("data", data)
    begins = F.when(section, "section").when(F.col("data") & ~F.coalesce(F.lag("data").over(order), F.lit(False)), "data_area").when(label & ~F.col("data"), "label")
    own = own.withColumn("begins", begins)
    # A boundary counts if the next one is far enough; sections always do.
    after = F.coalesce(F.min(F.when(F.col("begins").isNotNull(), F.col("line_no"))).over(order.rowsBetween(1, Window.unboundedFollowing)), F.max("line_no").over(Window.partitionBy("filename")) + 1)
    kind = F.when((F.col("begins") == "section") | (after - F.col("line_no") >= least), F.col("begins"))
    return _cut(own.withColumn("kind", kind).withColumn("name", F.when(kind.isNotNull(), F.coalesce(first_match("text", r"^([A-Z0-9_@#$]+)"), F.lit("UNNAMED")))), "header", "HEADER")


def parameters(files: DataFrame) -> DataFrame:
    """Sections at header comments; members without any are cut into groups of KEY=VALUE lines, which end at a comment or two blank lines."""
    comment = lambda x: x.rlike(r"^\s*\*")
    header = lambda x: x.rlike(r"^\s*\*{3,}") | (comment(x) & F.upper(x).rlike("|".join(HEADER_WORDS)))
    blank = lambda x: F.btrim(x) == ""
    none = F.lit(None).cast("string")

    def titled(x: Column) -> Column:
        name = lambda title: F.when(title == "", "Parameter Group").otherwise(truncated(title, 50))
        return F.when(header(x), F.struct(x.alias("text"), F.lit("parameter_group").alias("kind"), once(F.btrim(x, F.lit("* \t")), name).alias("name"))).otherwise(F.struct(x.alias("text"), none.alias("kind"), none.alias("name")))

    def groups(ls: Column) -> Column:
        gap = lambda x, i: comment(x) | (blank(x) & F.coalesce((i > 0) & blank(F.get(ls, i - 1)), F.lit(False)))
        found = once(F.transform(ls, lambda x, i: F.struct(x.alias("text"), F.when(gap(x, i), "parameter_group").alias("kind"), none.alias("name"))), lambda m: _cut_within(m, "parameter_group", "Parameter Group"))
        keyed = lambda c, keys: F.when(F.size(keys) > 0, c.withField("name", truncated(F.array_join(F.slice(keys, 1, 3), ", "), 50)))
        return F.filter(F.transform(found, lambda c: once(extract_all(c["text"], r"(?m)^\s*([A-Za-z][A-Za-z0-9_]*)\s*="), lambda keys: keyed(c, keys))), lambda c: c.isNotNull())

    def cut(ls: Column) -> Column:
        return once(F.transform(ls, titled), lambda m: F.when(F.exists(m, lambda x: x["kind"].isNotNull()), _cut_within(m, "header", "HEADER")).otherwise(groups(ls)))

    return _each_or_whole(files, clean_parameters, cut)


def pages(files: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    """Running text in overlapping windows of characters; line numbers aren't known."""
    cut = sliding(files.where("text is not null"), "filename", size=size, overlap=overlap)
    none = F.lit(None).cast("int")
    return cut.select("filename", F.col("n").cast("long").alias("chunk"), F.lit("window").alias("kind"), F.col("filename").alias("name"), none.alias("start_line"), none.alias("end_line"), F.col("chunk").alias("text")).where("text <> ''")


#: Cutters by file extension.
CUTTERS: dict[Callable[[DataFrame], DataFrame], Sequence[str]] = {
    cobol: ("cbl", "cob", "cobol"),
    lambda f: whole(f, clean_cobol, "copybook"): ("cpy", "copy"),
    pli: ("pli", "pl1"),
    lambda f: whole(f, clean_include, "include"): ("inc", "mac"),
    lambda f: whole(f, clean_jcl, "job"): ("jcl", "proc"),
    schedule: ("ca7", "ljob", "job"),
    lambda f: whole(f, clean_rexx, "script"): ("rexx", "rex"),
    assembler: ("asm", "hlasm"),
    parameters: ("parm", "ctl"),
    pages: ("md", "txt"),
}


def chunk(files: DataFrame, cutters: dict[Callable[[DataFrame], DataFrame], Sequence[str]] = CUTTERS) -> DataFrame:
    """All files, each cut as its extension says, with ``folder``: the first part of ``path`` where there is one.  Other extensions raise an error in the job."""
    extension = F.lower(F.element_at(F.split("filename", r"\."), -1))
    known = [e for ends in cutters.values() for e in ends]
    checked = files.withColumn("__ext", F.when(extension.isin(*known), extension).otherwise(F.raise_error(F.concat(F.lit("no chunker for "), "filename"))))
    parts = [cut(checked.where(F.col("__ext").isin(*ends))).select(*COLUMNS) for cut, ends in cutters.items()]
    return reduce(DataFrame.unionByName, parts)


def summary_passes(files: DataFrame, kind: Column, rolling: Sequence[str] = ("cobol", "pli", "assembly"), small: int = 200) -> DataFrame:
    """How a file is summarised: chunk after chunk, or in a single pass; short assembler files go in one."""
    n = F.size(F.split("text", "\n"))
    return files.select("filename", F.when((kind == "assembly") & (n < small), "single").when(kind.isin(*rolling), "rolling").otherwise("single").alias("passes"))
