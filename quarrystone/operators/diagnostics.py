"""What a run over source files tells of them: status, fatal errors, warnings and lines that no rule matched.

Rules give spans of lines; for the languages here, the lines outside all spans are told apart
within each text, in one pass that also finds its warnings and whether it can be parsed at all.
For spans in a table of their own, they come out of one window over a file's spans and lines.
A type without a parser, or whose parser fails, costs only its own files.

Scripts, schedules, declarations and PL/I include members have a status only: any line of
a script may be a command, and the others are looked through for what they hold.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.functions.text import contained, covered, extract_all, first_match, once
from quarrystone.operators.mainframe import PARAMETER_PATTERNS, SERVICE_VERBS, UTILITIES, assembler_code, cobol_lines
from quarrystone.operators.statements import copybooks

CONTENT = 100  # characters of a line that a report shows

# Words that begin a sentence of a program, and operations of job control.
COBOL_VERBS = (
    "ACCEPT", "ADD", "ALTER", "AUTHOR", "CALL", "CANCEL", "CLOSE", "COMPUTE", "CONTINUE", "COPY", "DATE-COMPILED", "DATE-WRITTEN", "DECLARATIVES", "DELETE", "DISPLAY", "DIVIDE", "ELSE", "END", "ENTRY", "EVALUATE",
    "EXIT", "FD", "FILE-CONTROL", "GO", "GOBACK", "IF", "INITIALIZE", "INSPECT", "INSTALLATION", "INVOKE", "JSON", "MERGE", "MOVE", "MULTIPLY", "OBJECT-COMPUTER", "OPEN", "PERFORM", "PROGRAM-ID", "READ", "RELEASE", "REPLACE",
    "RETURN", "REWRITE", "SD", "SEARCH", "SELECT", "SET", "SORT", "SOURCE-COMPUTER", "START", "STOP", "STRING", "SUBTRACT", "UNSTRING", "USE", "WHEN", "WRITE", "XML",
)
JCL_OPERATIONS = ("JOB", "EXEC", "DD", "PROC", "PEND", "INCLUDE", "SET", "IF", "ELSE", "ENDIF", "JCLLIB", "OUTPUT", "CNTL", "ENDCNTL")

_TO_PERIOD = r"(?:[^.'\"]++|'[^'\n]*+'|\"[^\"\n]*+\"|['\"]|\.(?=\S))*+(?:\.|\z)"
COBOL_RULES = (
    rf"(?im)^[ ]*(?:\d\d?(?=[ ])|(?:{'|'.join(COBOL_VERBS)})(?![A-Z0-9-])|END-(?!EXEC)[A-Z]+){_TO_PERIOD}",
    r"(?im)^[ ]*[A-Z0-9][A-Z0-9-]*(?:[ ]+(?:DIVISION|SECTION)[^.\n]*)?[ ]*\.",
    r"(?is)\bEXEC\s.*?END-EXEC\.?",
)
# Words that begin a statement of PL/I.
PLI_VERBS = (
    "ALLOCATE", "BEGIN", "CALL", "CLOSE", "DCL", "DECLARE", "DEFAULT", "DEFINE", "DELAY", "DELETE", "DISPLAY", "DO", "ELSE", "END", "ENTRY", "EXEC", "EXIT", "FETCH", "FLUSH", "FORMAT", "FREE", "GET", "GO", "GOTO", "IF",
    "ITERATE", "LEAVE", "LOCATE", "ON", "OPEN", "OTHER", "OTHERWISE", "PACKAGE", "PROC", "PROCEDURE", "PUT", "READ", "RELEASE", "RESIGNAL", "RETURN", "REVERT", "REWRITE", "SELECT", "SIGNAL", "STOP", "THEN", "UNLOCK", "WAIT",
    "WHEN", "WRITE",
)
_PLI_PIECE = r"(?s)/\*.*?(?:\*/|\z)|'[^']*+'?|\"[^\"]*+\"?|[^/'\"]++|/"
_PLI_NAME = r"[\w$@#]++(?:\s*+\((?:[^();]++|\((?:[^();]++|\([^();]*+\))*+\))*+\))?"
_PLI_ASSIGNED = rf"{_PLI_NAME}(?:\s*+(?:\.|->|,)\s*+{_PLI_NAME})*+\s*+(?:\*\*|\|\||[-+*/|&])?="
PLI_RULE = rf"(?i)\u0003(?:{_PLI_NAME}\s*+:\s*+)*+(?:(?:{'|'.join(PLI_VERBS)})(?![\w$@#])|%|\+\+INCLUDE\b|\*PROCESS\b|{_PLI_ASSIGNED}|(?=;))[^;]*+;"
ASSEMBLER_RULE = r"(?i)^([A-Z0-9_@#$.&]+\s+)?[A-Z@#$][A-Z0-9@#$]*(\s.*)?$"


def unmatched(code: DataFrame, spans: DataFrame) -> DataFrame:
    """The lines (filename, line, content) that lie in none of the spans (filename, line, last_line)."""
    ends = spans.select("filename", "line", F.lit(False).alias("is_line"), "last_line", F.lit(None).cast("string").alias("content"))
    both = ends.unionByName(code.select("filename", "line", F.lit(True).alias("is_line"), F.lit(None).cast("int").alias("last_line"), "content"))
    so_far = Window.partitionBy("filename").orderBy("line", "is_line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("reach", F.max("last_line").over(so_far)).where("is_line and coalesce(reach, 0) < line").select("filename", "line", "content")


@dataclass(frozen=True)
class Language:
    """How files of one type are judged.

    ``code`` gives the lines that a rule should match, ``spans`` what the rules matched, ``warnings``
    (filename, line, message), ``fatal`` a message for a file that can't be parsed, ``most_bytes`` its largest size.
    ``found`` gives unmatched lines and warnings of a text in one expression, an array of (error_type, message, line, content), in place of tables.
    Without any of these a file has a status and warnings only; ``empty`` says whether a blank file is a fatal error, a warning or nothing of note (null).
    """

    code: Callable[[DataFrame], DataFrame] | None = None
    spans: Callable[[DataFrame], DataFrame] | None = None
    message: str = ""
    warnings: Callable[[DataFrame], DataFrame] | None = None
    fatal: Callable[[], Column] | None = None
    most_bytes: int | None = None
    empty: str | None = None
    found: Callable[[], Column] | None = None


def _entry(kind: str, message: Column | str, line: Column | None = None, content: Column | None = None) -> Column:
    null = lambda c, t: (F.lit(None) if c is None else c).cast(t)
    return F.struct(F.lit(kind).alias("error_type"), (F.lit(message) if isinstance(message, str) else message).alias("message"), null(line, "int").alias("line"), null(None if content is None else F.left(content, F.lit(CONTENT)), "string").alias("content"))


def _unmatched_in(plain: Column, content: Column, marked: Column, rules: tuple[str, ...], number: Callable[[Column], Column], message: str, blank: str) -> Column:
    """Lines of ``plain`` that aren't blank and on which no match lies, with what ``content`` has there."""
    where = F.filter(F.transform(plain, lambda x, i: F.when(F.btrim(x, F.lit(blank)) != "", i)), lambda i: i.isNotNull())
    return F.transform(F.array_except(where, covered(marked, *rules)), lambda i: _entry("unrecognized", message, number(i), F.btrim(F.get(content, i), F.lit(blank))))


def _cobol_found() -> Column:
    lines_ = lambda src: once(F.split(src["s"], "\n"), lambda c: _unmatched_in(c, c, src["s"], COBOL_RULES, lambda i: F.get(src["numbers"], i), "No statement recognised", " "))
    return once(cobol_lines(F.col("text")), lines_)


def _jcl_found() -> Column:
    """Of statements, not comments, data in the stream or lines that go on from the one before."""
    cut = F.transform(F.split("text", "\n"), lambda x, i: F.struct((i + 1).alias("line"), F.rtrim(F.substr(x, F.lit(1), F.lit(72))).alias("t")))
    own = F.filter(cut, lambda l: F.startswith(l["t"], F.lit("//")) & ~F.startswith(l["t"], F.lit("//*")))
    operation = lambda t: F.upper(F.regexp_extract(t, r"^//\S*\s+(\S+)", 1))

    def begun(own: Column) -> Column:
        goes_on = lambda i: (i > 0) & F.endswith(F.get(own, i - 1)["t"], F.lit(","))
        return F.filter(F.transform(own, lambda l, i: F.when((l["t"] != "//") & ~F.coalesce(goes_on(i), F.lit(False)), F.struct(l["line"], l["t"], operation(l["t"]).alias("op")))), lambda x: x.isNotNull())

    def told(code: Column) -> Column:
        step = F.array_position(F.transform(code, lambda x: x["op"]), "EXEC").cast("int")
        early = F.filter(F.when(step > 0, F.slice(code, F.lit(1), step - 1)).otherwise(code), lambda x: x["op"] == "DD")
        unknown = F.filter(code, lambda x: ~x["op"].isin(*JCL_OPERATIONS))
        return F.concat(F.transform(unknown, lambda x: _entry("unrecognized", "Unknown operation", x["line"], x["t"])), F.transform(early, lambda x: _entry("warning", F.concat(F.lit("DD statement before any EXEC: "), F.regexp_extract(x["t"], r"^//(\S*)", 1)), x["line"])))

    return once(own, lambda own: once(begun(own), told))


def _assembler_found() -> Column:
    return F.transform(F.filter(assembler_code(F.col("text")), lambda x: ~x["text"].rlike(ASSEMBLER_RULE)), lambda x: _entry("unrecognized", "No instruction recognised", x["line"], x["text"]))


def _copybook_warnings(files: DataFrame) -> DataFrame:
    return copybooks(files)["warnings"].select("filename", F.col("line_no").alias("line"), F.col("warning").alias("message"))


def _pli_masked(pieces: Column) -> Column:
    """The text without comments, and without semicolons, colons and equals signs in strings; line breaks stay."""
    quoted = lambda p: F.startswith(p, F.lit("'")) | F.startswith(p, F.lit('"'))
    return F.array_join(F.transform(pieces, lambda p: F.when(F.startswith(p, F.lit("/*")), F.regexp_replace(p, r"[^\n]+", " ")).when(quoted(p), F.translate(p, ";:=", "___")).otherwise(p)), "")


def _pli_open(pieces: Column) -> Column:
    """The comment or string that has no end, with the line on which it begins."""

    def told(p: Column) -> Column:
        size = F.char_length(p)
        open_quote = lambda q: F.startswith(p, F.lit(q)) & ((size < 2) | ~F.endswith(p, F.lit(q)))
        message = F.when(F.startswith(p, F.lit("/*")) & ((size < 4) | ~F.endswith(p, F.lit("*/"))), "comment without an end").when(open_quote("'") | open_quote('"'), "string without an end")
        line = F.size(F.split("text", "\n")) - F.size(F.split(p, "\n")) + 1
        return F.filter(F.array(_entry("warning", message, line)), lambda x: x["message"].isNotNull())

    return once(F.try_element_at(pieces, F.lit(-1)), told)


def _pli_found() -> Column:
    """Texts are cut into comments, quoted strings and what lies between them."""

    def told(pieces: Column) -> Column:
        marked = lambda plain: F.regexp_replace(plain, r"(\A\s*+|;\s*+)(?=\S)", "$1\u0003")
        left = lambda x: _unmatched_in(x["plain"], x["content"], x["marked"], (PLI_RULE,), lambda i: i + 1, "No statement recognised", " \t\r")
        parts = lambda plain: F.struct(F.split(plain, "\n").alias("plain"), F.split("text", "\n").alias("content"), marked(plain).alias("marked"))
        return F.concat(once(_pli_masked(pieces), lambda plain: once(parts(plain), left)), _pli_open(pieces))

    return once(extract_all(F.translate("text", "\u0003", " "), _PLI_PIECE, 0), told)


def _member_found() -> Column:
    """Lines that hold nothing a member is looked through for."""
    upper = ("used", "executed", "job", "procedure")

    def plain(x: Column) -> Column:
        tests = [F.upper(x).rlike(p) if name in upper else x.rlike(p) for name, p in PARAMETER_PATTERNS.items()]
        return ~(reduce(Column.__or__, tests) | x.rlike(SERVICE_VERBS) | (F.size(contained(x, UTILITIES)) > 0))

    own = F.transform(F.split("text", "\n"), lambda x, i: F.struct((i + 1).alias("line"), F.btrim(x, F.lit(" \t\r")).alias("content")))
    left = F.filter(own, lambda x: (x["content"] != "") & ~F.startswith(x["content"], F.lit("*")) & plain(x["content"]))
    return F.transform(left, lambda x: _entry("unrecognized", "Nothing recognised", x["line"], x["content"]))


LANGUAGES = {
    "cobol": Language(found=_cobol_found, fatal=lambda: F.when(first_match("text", r"(?i)(PROGRAM-ID)\.").isNull(), F.lit("no PROGRAM-ID")), most_bytes=50 << 20, empty="fatal"),
    "copybook": Language(warnings=_copybook_warnings, most_bytes=10 << 20, empty="warning"),
    "jcl": Language(found=_jcl_found),
    "assembly": Language(found=_assembler_found),
    "pli": Language(found=_pli_found),
    "ctl": Language(found=_member_found),
    **{kind: Language() for kind in ("inc", "dclgen", "rexx", "ca7")},
}

_ERRORS = ("filename", "file_type", "error_type", "message", "line", "content")


def _blank() -> Column:
    return F.btrim("text", F.lit(" \t\r\n")) == ""


def _fatal(files: DataFrame, language: Language) -> Column:
    """Why a file can't be parsed; null for one that can."""
    out = F.when(F.col("text").isNull(), F.lit("not decoded"))
    if language.empty == "fatal":
        out = out.when(_blank(), F.lit("empty file"))
    if language.most_bytes:
        out = out.when(F.octet_length("text") > language.most_bytes, F.concat(F.lit("larger than "), F.lit(str(language.most_bytes >> 20)), F.lit(" MB")))
    return F.coalesce(out, language.fatal()) if language.fatal else out


def _of_type(files: DataFrame, kind: str, language: Language) -> DataFrame:
    null = lambda t: F.lit(None).cast(t)
    told = [language.found()] if language.found else []
    if language.empty == "warning":
        told.append(F.filter(F.array(_entry("warning", "File is empty")), lambda _: _blank()))
    none = F.filter(F.array(_entry("fatal", "")), lambda _: F.lit(False))
    rows = once(_fatal(files, language), lambda why: F.when(why.isNotNull(), F.array(_entry("fatal", why))).otherwise(F.concat(none, *told)))
    found = [files.select("filename", F.explode(rows).alias("e")).select("filename", "e.*")]
    good = lambda: files.where(_fatal(files, language).isNull()).select("filename", "text")
    if language.code:
        left = unmatched(language.code(good()), language.spans(good()))
        found.append(left.select("filename", F.lit("unrecognized").alias("error_type"), F.lit(language.message).alias("message"), "line", F.left("content", F.lit(CONTENT)).alias("content")))
    if language.warnings:
        found.append(language.warnings(good()).select("filename", F.lit("warning").alias("error_type"), "message", F.col("line").cast("int"), null("string").alias("content")))
    return reduce(DataFrame.unionByName, found).select("filename", F.lit(kind).alias("file_type"), *_ERRORS[2:])


def parse_errors(files: DataFrame, languages: dict[str, Language] | None = None, kinds: list[str] | None = None) -> DataFrame:
    """Errors of files (filename, file_type, text): fatal, warning or unrecognized, with line and content where there are any.

    ``kinds`` are the types that files may have; others are fatal errors like those of a type whose
    parser can't be planned.  Files are known by name within their type.
    """
    languages = LANGUAGES if languages is None else languages
    found = []
    broken = []
    for kind in kinds or list(languages):
        own = files.where(F.col("file_type") == kind).drop("file_type")
        try:
            errors = _of_type(own, kind, languages[kind])
            errors.schema  # noqa: B018  an expression that can't be resolved shows here
            found.append(errors)
        except Exception as why:  # noqa: BLE001  whatever it is, the other types go on
            message = f"no parser for {kind}" if kind not in languages else f"parser failed: {type(why).__name__}: {str(why).splitlines()[0] if str(why) else ''}"[:200]
            broken.append((kind, message))
    known = [k for k in (kinds or list(languages)) if k not in {b for b, _ in broken}]
    reason = F.concat(F.lit("no parser for "), F.coalesce("file_type", F.lit("an unnamed type")))
    for kind, message in broken:
        reason = F.when(F.col("file_type") == kind, F.lit(message)).otherwise(reason)
    other = files.where(F.col("file_type").isNull() | ~F.col("file_type").isin(*known)) if known else files
    found.append(other.select("filename", "file_type", F.lit("fatal").alias("error_type"), reason.alias("message"), F.lit(None).cast("int").alias("line"), F.lit(None).cast("string").alias("content")))
    return reduce(DataFrame.unionByName, found)


def parse_results(files: DataFrame, errors: DataFrame) -> DataFrame:
    """A row of each file: (filename, file_type, success, error)."""
    fatal = errors.where("error_type = 'fatal'").groupBy("filename", "file_type").agg(F.min("message").alias("error"))
    same = (F.col("f.filename") == F.col("e.filename")) & F.col("f.file_type").eqNullSafe(F.col("e.file_type"))
    joined = files.select("filename", "file_type").alias("f").join(fatal.alias("e"), same, "left")
    return joined.select("f.filename", "f.file_type", F.col("e.error").isNull().alias("success"), "e.error")


def parse_summary(results: DataFrame, errors: DataFrame) -> DataFrame:
    """Counts of each type: files, successful and failed ones, files with any error, and errors by kind."""
    files = results.groupBy("file_type").agg(F.count("*").alias("total_files"), F.count_if("success").alias("successful"), F.count_if(~F.col("success")).alias("failed"))
    by_file = errors.groupBy("file_type", "filename").agg(*(F.count_if(F.col("error_type") == k).alias(k) for k in ("fatal", "warning", "unrecognized")))
    told = by_file.groupBy("file_type").agg(F.count("*").alias("files_with_errors"), *(F.sum(k).alias(k) for k in ("fatal", "warning", "unrecognized")))
    joined = files.alias("f").join(told.alias("e"), F.col("f.file_type").eqNullSafe(F.col("e.file_type")), "left")
    return joined.select("f.*", *(F.coalesce(f"e.{k}", F.lit(0)).alias(k) for k in ("files_with_errors", "fatal", "warning", "unrecognized")))


def summary_of(files: DataFrame, errors: DataFrame) -> DataFrame:
    """``parse_summary`` of files and their errors: each text is read once for its errors, and files meet them as counts, in one aggregate by file."""
    kinds = ("fatal", "warning", "unrecognized")
    listed = files.select("file_type", "filename", F.lit(1).alias("n"), *(F.lit(0).alias(k) for k in kinds))
    told = errors.select("file_type", "filename", F.lit(0).alias("n"), *((F.col("error_type") == k).cast("int").alias(k) for k in kinds))
    by_file = listed.unionByName(told).groupBy("file_type", "filename").agg(*(F.sum(c).alias(c) for c in ("n", *kinds)))
    failed = F.when((F.col("fatal") > 0) & F.col("filename").isNotNull(), F.col("n")).otherwise(0)
    return by_file.groupBy("file_type").agg(F.sum("n").alias("total_files"), F.sum(F.col("n") - failed).alias("successful"), F.sum(failed).alias("failed"), F.count_if(F.col("fatal") + F.col("warning") + F.col("unrecognized") > 0).alias("files_with_errors"), *(F.sum(k).alias(k) for k in kinds)).where("total_files > 0")
