"""Further statements of COBOL programs, copybooks, record layouts and register calls.

Line-oriented grammars become windows over the lines table of a file: a running
sum numbers logical lines and statements, the last value so far stands for
state such as the contents of a register.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.functions.text import extract_all, first_match, keep_first, located, zipped
from quarrystone.operators.mainframe import cobol_code, cobol_source, table_declarations
from quarrystone.sources.files import lines

_WORD = r"[A-Za-z][A-Za-z0-9_-]*"


def _optional_upper(c: Column | str) -> Column:
    return F.nullif(F.upper(F.col(c) if isinstance(c, str) else c), F.lit(""))


def cobol_statements(files: DataFrame) -> dict[str, DataFrame]:
    """Statements beyond calls and data access, by kind, with their first line; ``seq`` counts those of a file and kind from 0."""
    src = cobol_code(files)

    def each(pattern: str, *names: str) -> DataFrame:
        return src.select("filename", F.posexplode(located("s", "numbers", pattern, *names)).alias("seq", "m")).withColumn("line", F.col("m.line"))

    cics = each(rf"(?is)EXEC\s+CICS\s+([A-Za-z]+)(.*?)END-EXEC", "verb", "rest")
    xml = each(rf"(?is)XML\s+PARSE\s+({_WORD})(.*?)END-XML", "document", "rest")
    # Both kinds in one pass over the texts.
    of_kind = lambda kind: lambda m, seq: F.struct(seq.alias("seq"), F.lit(kind).alias("type"), F.upper(m["source"]).alias("source"), F.upper(m["target"]).alias("target"), m["line"].alias("line"))
    written = F.transform(located("s", "numbers", rf"(?i)JSON\s+GENERATE\s+({_WORD})\s+FROM\s+({_WORD})", "target", "source"), of_kind("GENERATE"))
    read = F.transform(located("s", "numbers", rf"(?i)JSON\s+PARSE\s+({_WORD})\s+INTO\s+({_WORD})", "source", "target"), of_kind("PARSE"))
    json = src.select("filename", F.explode(F.concat(written, read)).alias("m")).select("filename", "m.*")
    invoke = each(rf'(?i)INVOKE\s+({_WORD})\s+"([^"]+)"', "object", "method")
    evaluate = each(rf"(?is)EVALUATE\s+({_WORD})(.*?)END-EVALUATE", "subject", "body")
    # A branch counts where another WHEN follows and nothing in between has the letter W.
    branches = F.size(extract_all("m.body", r"(?is)(WHEN\s+[^Ww]+?)(?=WHEN)"))
    programs = each(rf"(?is)IDENTIFICATION\s+DIVISION\..*?PROGRAM-ID\.\s*({_WORD})", "program")
    declared = src.select("filename", F.regexp_extract("s", r"(?is)DECLARATIVES\.(.*?)END\s+DECLARATIVES", 1).alias("s"))
    uses = declared.select("filename", F.posexplode(extract_all("s", rf"(?i)USE\s+(?:GLOBAL\s+)?(?:AFTER\s+)?(?:STANDARD\s+)?(?:ERROR|EXCEPTION|DEBUGGING)\s+(?:PROCEDURE\s+)?(?:ON\s+)?({_WORD})?")).alias("seq", "file"))
    return {
        "cics": cics.select("filename", "seq", F.upper("m.verb").alias("command"), F.concat_ws(" ", F.lit("EXEC CICS"), "m.verb", F.nullif(F.regexp_replace("m.rest", r"^\s+|\s+$", ""), F.lit("")), F.lit("END-EXEC")).alias("statement"), "line"),
        "xml_parse": xml.select("filename", "seq", F.upper("m.document").alias("document"), F.upper(first_match("m.rest", rf"(?i)PROCESSING\s+PROCEDURE\s+({_WORD})")).alias("procedure"), "line"),
        "json": json,
        "invoke": invoke.select("filename", "seq", F.upper("m.object").alias("object"), F.col("m.method").alias("method"), "line"),
        "evaluate": evaluate.select("filename", "seq", F.upper("m.subject").alias("subject"), F.nullif(branches, F.lit(0)).alias("when_count"), "line"),
        "nested_programs": programs.where("seq > 0").select("filename", "seq", F.upper("m.program").alias("program"), "line"),
        "declaratives": uses.select("filename", "seq", _optional_upper("file").alias("on_file")),
    }


# ---- Copybooks -------------------------------------------------------------


def ends_statement(text: Column) -> Column:
    """Whether a period outside quotes ends the line or is followed by an upper-case letter or a digit."""
    bare = F.regexp_replace(text, r"""(?<!\\)(['"]).*?(?:(?<!\\)\1|$)""", "q")
    return bare.rlike(r"\.\s*($|\p{Lu}|\d)") | F.rtrim(text).endswith(".")


def copybook_lines(files: DataFrame) -> DataFrame:
    """Logical lines: columns 8-72, no comment, debugging or blank lines, continuations joined; (filename, line_no, text)."""
    indicator = F.when(F.char_length("text") >= 7, F.substr("text", F.lit(7), F.lit(1))).otherwise(F.lit(" "))
    own = lines(files, "filename").withColumn("indicator", indicator).where(~F.col("indicator").isin("*", "/", "D", "d"))
    own = own.withColumn("text", F.when(F.char_length("text") < 7, F.col("text")).otherwise(F.substr("text", F.lit(8), F.lit(65))))
    own = own.where("trim(text) <> ''")
    by_file = Window.partitionBy("filename").orderBy("line_no")
    starts = (F.col("indicator") != "-") | (F.row_number().over(by_file) == 1)
    numbered = own.withColumn("starts", starts).withColumn("logical", F.sum(F.col("starts").cast("int")).over(by_file))
    piece = F.when(F.col("starts"), F.col("text")).otherwise(F.regexp_replace(F.ltrim("text"), "^['\"]", ""))
    parts = numbered.groupBy("filename", "logical").agg(F.array_sort(F.collect_list(F.struct("line_no", piece.alias("piece")))).alias("p"))
    joined = F.aggregate(F.slice("p", 2, F.size("p")), F.col("p")[0]["piece"], lambda acc, x: F.concat(F.rtrim(acc), x["piece"]))
    return parts.select("filename", F.col("p")[0]["line_no"].alias("line_no"), joined.alias("text"))


def copybook_statements(files: DataFrame) -> DataFrame:
    """Statements up to their period: (filename, line_no, text, terminated); an open one at the end gets a period."""
    ended = copybook_lines(files).withColumn("ends", ends_statement(F.col("text")).cast("int"))
    before = Window.partitionBy("filename").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    numbered = ended.withColumn("stmt", F.coalesce(F.sum("ends").over(before), F.lit(0)))
    whole = numbered.groupBy("filename", "stmt").agg(F.min("line_no").alias("line_no"), F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("p"), F.max("ends").alias("ends"))
    text = F.array_join(F.transform("p", lambda x: x["text"]), " ")
    done = F.col("ends") == 1
    return whole.select("filename", "line_no", F.concat(text, F.when(done, "").otherwise(".")).alias("text"), done.alias("terminated"))


def copybooks(files: DataFrame) -> dict[str, DataFrame]:
    """Copybooks that copybooks name, and warnings on statements without an end."""
    stmts = copybook_statements(files)
    found = stmts.withColumn("name", _optional_upper(F.regexp_extract("text", rf"(?i)^\s*COPY\s+({_WORD})", 1))).where("name is not null")
    return {
        "references": found.select("filename", "line_no", F.col("name").alias("copybook"), F.upper(first_match("text", rf"(?i)^\s*COPY\s+{_WORD}\s+(?:OF|IN)\s+({_WORD})")).alias("library"), F.btrim(first_match("text", r"(?i)REPLACING\s+(.+?)(?:\.|$)")).alias("replacing")),
        "warnings": stmts.where("not terminated").select("filename", "line_no", F.concat(F.lit("Unterminated statement at line "), "line_no").alias("warning")),
    }


# ---- Record layouts --------------------------------------------------------

#: Level numbers of data items: groups and items, renamed items, independent items.
LEVELS = (*range(1, 50), 66, 77)
# Prefixes of the names of null indicators.
INDICATOR_PREFIXES = ("INDNULL-", "NULL-", "IND-", "N_")


def with_parents(fields: DataFrame, key: str = "filename", order: str = "position", level: str = "level") -> DataFrame:
    """Adds ``parent``: the latest earlier row of a smaller level, null for roots.

    One window keeps the latest row of every level, so the work grows with the rows and not with their pairs.
    """
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    latest = [F.when(F.col(level) > n, F.max(F.when(F.col(level) == n, F.col(order))).over(before)) for n in LEVELS]
    return fields.withColumn("parent", F.greatest(*latest))


def record_fields(files: DataFrame) -> DataFrame:
    """Fields of record layouts in order, with their parents and what the table declarations of the same file say of them.

    Condition names (88) are left out, and a variable-length item stands for its
    length and text parts.  A field has the column of its own name or, failing
    that, of its name without a prefix of up to three characters; null
    indicators have none, but make the field they belong to nullable.
    """
    source = files.select("filename", F.posexplode(F.split(cobol_source(F.col("text")), "\n")).alias("position", "line"))
    fields = source.select("filename", "position", first_match("line", r"^\s*(\d{2})\s+[\w-]+").cast("int").alias("level"), F.upper(first_match("line", r"^\s*\d{2}\s+([\w-]+)")).alias("name")).where("level is not null and level <> 88")
    by_file = Window.partitionBy("filename").orderBy("position")
    varying = F.coalesce((F.lead("level").over(by_file) == 49) & F.lead("name").over(by_file).contains("-LEN"), F.lit(False))
    fields = fields.withColumn("is_varying", varying).where("not (level = 49 and name rlike '-(LEN|TEXT)$')")
    fields = with_parents(fields)

    names = fields.select("filename", "name").distinct()
    links = names.select("filename", F.col("name").alias("indicator"), F.explode(F.filter(F.array(*(F.when(F.startswith("name", F.lit(p)), F.substr("name", F.lit(len(p) + 1))) for p in INDICATOR_PREFIXES)), lambda x: x.isNotNull())).alias("name")).join(names, ["filename", "name"], "left_semi")
    links = links.groupBy("filename", "name").agg(F.min("indicator").alias("indicator"))
    indicators = links.select("filename", F.col("indicator").alias("name"), F.lit(True).alias("is_indicator"))

    columns = keep_first(table_declarations(files), ["filename", "column"], ["table", "position"]).select("filename", "column", "type", "nullable", "host_type")
    exact = columns.select("filename", F.col("column").alias("full"), F.struct("column", "type", "nullable", "host_type").alias("x"))
    short = columns.select("filename", F.col("column").alias("short"), F.struct("column", "type", "nullable", "host_type").alias("y"))
    keyed = fields.withColumn("full", F.replace("name", F.lit("-"), F.lit("_"))).withColumn("short", F.replace(F.regexp_replace("name", "^[A-Z0-9]{1,3}-", ""), F.lit("-"), F.lit("_")))
    joined = keyed.join(exact, ["filename", "full"], "left").join(short, ["filename", "short"], "left").join(links, ["filename", "name"], "left").join(indicators, ["filename", "name"], "left")
    plain = F.col("is_indicator").isNull() & ~F.contains("name", F.lit("FILLER"))
    meta = F.when(plain, F.coalesce("x", "y"))
    typed = joined.withColumn("meta", meta)
    nullable = F.when(F.col("indicator").isNotNull(), F.lit(True)).otherwise(F.col("meta.nullable"))
    return typed.select("filename", "position", "level", "name", "parent", "is_varying", F.col("meta.column").alias("column"), F.col("meta.type").alias("type"), nullable.alias("nullable"), F.col("meta.host_type").alias("host_type"), "indicator")


# ---- Register calls --------------------------------------------------------


def register_calls(files: DataFrame) -> DataFrame:
    """Branches with return register 14 through a register, with what the latest load in the same section put there."""
    code = lines(files, "filename").select("filename", "line_no", F.upper(F.regexp_extract("text", r"^([^*]*)", 1)).alias("t"))
    parts = code.select("filename", "line_no", F.regexp_extract("t", r"^(\S*)\s+([A-Z][A-Z0-9]*)", 1).alias("label"), F.regexp_extract("t", r"^\S*\s+([A-Z][A-Z0-9]*)", 1).alias("op"), F.regexp_extract("t", r"^\S*\s+[A-Z][A-Z0-9]*\s+([A-Z0-9_]+),", 1).alias("first"), F.regexp_extract("t", r"^\S*\s+[A-Z][A-Z0-9]*\s+[A-Z0-9_]+,(\S+)", 1).alias("second"))
    section = F.sum(F.when(F.col("op").isin("CSECT", "DSECT", "RSECT", "COM", "LOCTR") & (F.col("label") != ""), 1).otherwise(0))
    in_section = parts.withColumn("section", section.over(Window.partitionBy("filename").orderBy("line_no")))
    constant = F.regexp_extract("second", r"^=V\(([^)]+)\)", 1)
    load = F.col("op") == "L"
    loaded = F.when(load & (constant != ""), F.struct(constant.alias("target"), F.lit("V-constant").alias("load_type"), F.col("line_no").alias("load_line")))
    loaded = F.coalesce(loaded, F.when(load & F.col("second").rlike("^[A-Z0-9_]+$"), F.struct(F.col("second").alias("target"), F.lit("direct-symbol").alias("load_type"), F.col("line_no").alias("load_line"))))
    call = F.col("op").isin("BALR", "BASR") & (F.col("first") == "14")
    steps = in_section.select("filename", "section", "line_no", F.when(load, F.col("first")).when(call, F.col("second")).alias("register"), call.alias("is_call"), loaded.alias("loaded")).where("register is not null")
    so_far = Window.partitionBy("filename", "section", "register").orderBy("line_no")
    known = steps.withColumn("now", F.last("loaded", True).over(so_far)).where("is_call and now is not null")
    return known.select("filename", "now.target", F.col("register").alias("via_register"), "now.load_type", "now.load_line", F.col("line_no").alias("call_line"))
