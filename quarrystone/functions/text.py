"""Column helpers for text: extraction, deduplication keys, classification and name cleaning."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """What ``use`` makes of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def extract_all(text: Column | str, pattern: str, group: int = 1) -> Column:
    """All matches of one group, in order."""
    return F.regexp_extract_all(col(text), F.lit(pattern), F.lit(group))


def first_match(text: Column | str, pattern: str, group: int = 1) -> Column:
    """The first match of a group; null where there is none."""
    return F.nullif(F.regexp_extract(col(text), pattern, group), F.lit(""))


def zipped(text: Column | str, pattern: str, *names: str) -> Column:
    """All matches as structs of their groups 1, 2, ... under the given names."""
    arrays = [extract_all(text, pattern, i + 1).alias(n) for i, n in enumerate(names)]
    return F.arrays_zip(*arrays)


def carried(values: Column) -> Column:
    """Each value of an array of strings, or in the place of a null the last one before it."""
    none = F.lit(None).cast("string")

    def filled(values: Column) -> Column:
        there = F.filter(F.transform(values, lambda v, i: F.when(v.isNotNull(), F.struct(i.alias("at"), v.alias("v")))), lambda x: x.isNotNull())
        until = lambda found, k: F.coalesce(F.get(found, k)["at"], F.size(values))
        runs = lambda found: F.transform(found, lambda x, k: F.array_repeat(x["v"], until(found, k + 1) - x["at"]))
        return once(there, lambda found: F.concat(F.array_repeat(none, until(found, F.lit(0))), F.flatten(runs(found))))

    return once(values, filled)


def _marked_lines(marked: Column, mark: str) -> Column:
    """The index of the line of each mark, in order."""
    count = lambda x: F.when(F.contains(x, F.lit(mark)), F.char_length(x) - F.char_length(F.replace(x, F.lit(mark), F.lit("")))).otherwise(0)
    return F.flatten(F.transform(F.split(marked, "\n"), lambda x, i: F.array_repeat(i, count(x))))


def located(text: Column | str, numbers: Column | str, pattern: str, *names: str) -> Column:
    """All matches as structs of their groups under the given names, with ``line`` and ``last_line``.

    ``numbers`` has the number in the file of each line of the text, for texts whose lines
    have been dropped or joined; lines joined to another belong to it.  Matches are marked
    in the text, and a line has as many of them as marks: no offset is counted.
    """
    after = lambda i: F.get(col(numbers), i + 1) - 1

    def found(plain: Column) -> Column:
        first = lambda marked: F.transform(_marked_lines(marked, "\u0001"), lambda i: F.get(col(numbers), i))
        last = lambda marked: F.transform(_marked_lines(marked, "\u0002"), lambda i: F.coalesce(after(i), F.get(col(numbers), i)))
        groups = [extract_all(plain, pattern, i + 1).alias(n) for i, n in enumerate(names)]
        return once(F.regexp_replace(plain, pattern, "\u0001$0\u0002"), lambda marked: F.arrays_zip(*groups, first(marked).alias("line"), last(marked).alias("last_line")))

    return once(F.translate(col(text), "\u0001\u0002", "  "), found)


def covered(text: Column, *patterns: str) -> Column:
    """The index of each line on which a part of a match lies, once for each match there."""
    lines = lambda marked: F.flatten(F.zip_with(_marked_lines(marked, "\u0001"), _marked_lines(marked, "\u0002"), lambda a, b: F.sequence(a, b)))
    return once(F.translate(text, "\u0001\u0002", "  "), lambda plain: F.concat(*(once(F.regexp_replace(plain, p, "\u0001$0\u0002"), lines) for p in patterns)))


def sorted_distinct(values: Column | str) -> Column:
    return F.array_sort(F.array_distinct(col(values)))


def classify(text: Column | str, ordered: Sequence[tuple[str, str]], default: str | None = None) -> Column:
    """The label of the first word that the text contains."""
    out = F
    for word, label in ordered:
        out = out.when(F.contains(col(text), F.lit(word)), F.lit(label))
    return out.otherwise(F.lit(default))


def contained(text: Column | str, words: Sequence[str]) -> Column:
    """The words that occur in the upper-case text, in the given order."""
    return F.filter(F.array(*(F.lit(w) for w in words)), lambda w: F.contains(F.upper(col(text)), w))


def keep_first(df: DataFrame, keys: Sequence[Column | str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key in a stated order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def first_lines(df: DataFrame, line: str = "line") -> DataFrame:
    """Distinct rows, each with the first line on which it stands."""
    return df.groupBy(*(c for c in df.columns if c != line)).agg(F.min(line).alias(line))


def first_seen(df: DataFrame, keys: Sequence[str], value: str, order: Column | str, name: str) -> DataFrame:
    """The distinct values of each key in the order in which they are first seen; values without a position come last, values at one position by their order.

    The least position of every value is aggregated before the shuffle, so a key's list is as long as its distinct values and not as its rows.
    A key whose values are all null has an empty list.
    """
    least = df.groupBy(*keys, value).agg(F.min(order).alias("__at"))
    ranked = F.array_sort(F.collect_list(F.when(F.col(value).isNotNull(), F.struct(F.col("__at").isNull().alias("__none"), "__at", value))))
    return least.groupBy(*keys).agg(F.transform(ranked, lambda x: x[value]).alias(name))


def keep_last(df: DataFrame, keys: Sequence[Column | str], order: Sequence[str]) -> DataFrame:
    """The last row of each key in a stated order."""
    return keep_first(df, keys, [F.col(c).desc() for c in order])


def node_name(text: Column | str) -> Column:
    """A name that is safe as a graph node: letters and digits only, after a word that makes it begin with a letter."""
    return F.concat(F.lit("node"), F.regexp_replace(col(text), "[^A-Za-z0-9]", ""))


def truncated(text: Column | str, n: int) -> Column:
    """At most n characters, the last three of them dots where something was cut."""
    return F.when(F.char_length(col(text)) > n, F.concat(F.substr(col(text), F.lit(1), F.lit(n - 3)), F.lit("..."))).otherwise(col(text))


def html_escaped(text: Column | str) -> Column:
    out = col(text)
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(raw), F.lit(name))
    return out


def dataset_name(text: Column | str) -> Column:
    """A dataset name without quotes, member and generation, in upper case."""
    return F.upper(F.btrim(F.regexp_replace(F.regexp_replace(col(text), r"\(.*\)", ""), "['\"]", "")))


def upper_plain(text: Column | str) -> Column:
    """Upper case in which sharp s is two letters, as in both Python and Java."""
    return F.upper(F.replace(col(text), F.lit("ß"), F.lit("ss")))
