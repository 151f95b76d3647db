"""Operators of catalogues and reports on any tables: counts, matrices, first and last values, islands, look-ups, views of texts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.functions.text import contained, keep_first, keep_last, sorted_distinct
from quarrystone.sources.files import lines


def counts_of(owners: DataFrame, members: DataFrame, key: str, member_key: str, name: str = "n") -> DataFrame:
    """Every owner's key with its number of members, 0 where it has none; members are counted before they are joined."""
    counted = members.groupBy(F.col(member_key).alias(key)).agg(F.count("*").alias(name))
    return owners.select(key).join(counted, key, "left").select(key, F.coalesce(name, F.lit(0)).alias(name))


def totals_by(df: DataFrame, keys: Sequence[str], sums: Mapping[str, str] | None = None, **named: Column) -> DataFrame:
    """Rows by key as ``n``, sums of columns under new names, and other aggregates by name."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *(F.sum(c).alias(name) for name, c in (sums or {}).items()), *(c.alias(name) for name, c in named.items()))


def counts_by_kind(df: DataFrame, key: str, kind: str, kinds: Sequence[str]) -> DataFrame:
    """A row for each key with a count for each of the given kinds."""
    return df.groupBy(key).agg(*(F.count_if(F.col(kind) == k).alias(k) for k in kinds))


def usage_matrix(df: DataFrame, key: str, kind: str, letters: Mapping[str, str]) -> DataFrame:
    """Whether a key has any row of a kind, 1 or 0, under a letter for each kind."""
    return df.groupBy(key).agg(*(F.max(F.coalesce(F.col(kind) == k, F.lit(False)).cast("int")).alias(letter) for letter, k in letters.items()))


def coverage_by(expected: DataFrame, found: DataFrame, key: str, by: str) -> DataFrame:
    """By group: files expected, how many were found, percent with two decimals."""
    has = found.select(key).distinct().withColumn("__has", F.lit(1))
    n, m = F.count("*"), F.count("__has")
    return expected.select(key, by).join(has, key, "left").groupBy(by).agg(n.alias("files"), m.alias("covered"), F.round(100.0 * m / n, 2).alias("coverage"))


def missing(expected: DataFrame, have: DataFrame, key: str, have_key: str | None = None) -> DataFrame:
    """Expected rows whose key isn't there."""
    return expected.join(have.select(F.col(have_key or key).alias(key)).distinct(), key, "left_anti").select(*expected.columns)


def common(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct keys of both."""
    return a.select(key).intersect(b.select(key))


def status_by(files: DataFrame, results: DataFrame, key: str, by: str, good: Column) -> DataFrame:
    """By group: files, those with a result, those with a good one."""
    joined = files.select(key, by).join(results.withColumn("__has", F.lit(1)), key, "left")
    return joined.groupBy(by).agg(F.count("*").alias("n_files"), F.count("__has").alias("n_labelled"), F.count_if(good).alias("n_good"))


def first_k(df: DataFrame, by: str, order: Sequence[Column | str], k: int) -> DataFrame:
    """The first k rows of each group."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("__n") <= k).drop("__n")


def newest_and_head(df: DataFrame, by: str, turn: str, k: int) -> DataFrame:
    """The last k turns of each conversation, and its first."""
    newest = Window.partitionBy(by).orderBy(F.desc(turn))
    return df.withColumn("__n", F.row_number().over(newest)).where((F.col("__n") <= k) | (F.col(turn) == 0)).drop("__n")


def last_before(df: DataFrame, by: str, order: Sequence[str], value: Column, name: str) -> DataFrame:
    """Adds the last value that isn't null of the rows before."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.last(value, True).over(w))


def islands(df: DataFrame, by: str, at: str, order: Sequence[str], gap: str) -> DataFrame:
    """Adds ``island``: the number of gaps longer than an interval up to a row, the first row's included."""
    w = Window.partitionBy(by).orderBy(*order)
    near = F.coalesce(F.col(at) - F.lag(at).over(w) <= F.expr(f"INTERVAL {gap}"), F.lit(False))
    return df.withColumn("__new", F.when(near, 0).otherwise(1)).withColumn("island", F.sum("__new").over(w)).drop("__new")


def looked_up(df: DataFrame, *dimensions: tuple[DataFrame, str, str]) -> DataFrame:
    """Rows with the columns of dimensions joined one after another: (dimension, key here, key there)."""
    return reduce(lambda rows, x: rows.join(x[0], F.col(x[1]) == F.col(x[2])), dimensions, df)


def copies_kept_first(df: DataFrame, same: Column, key: str) -> DataFrame:
    """The least key of rows with the same value, and how many they are."""
    return df.groupBy(same.alias("__same")).agg(F.min(key).alias(key), F.count("*").alias("copies")).drop("__same")


def merged_sets(df: DataFrame, key: str, member: str, name: str, separator: str = ",") -> DataFrame:
    """The sorted distinct members of a key in one text, and its rows."""
    return df.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(member)), separator).alias(name), F.count("*").alias("turns"))


def last_definitions(df: DataFrame, term: str, order: Sequence[str], *columns: str) -> DataFrame:
    """The last row of each term."""
    return keep_last(df, [term], list(order)).select(term, *columns)


def first_definitions(df: DataFrame, term: str, order: Sequence[str], *columns: str) -> DataFrame:
    """The first row of each term."""
    return keep_first(df, [term], list(order)).select(term, *columns)


def tagged(name: str, **parts: DataFrame) -> DataFrame:
    """The rows of all parts, each under its part's name in a further column."""
    return reduce(DataFrame.unionByName, [rows.withColumn(name, F.lit(tag)) for tag, rows in parts.items()])


def line_range(files: DataFrame, key: str, first: int, last: int) -> DataFrame:
    """Lines from first to last, counted from 1, of texts that reach the first: (key, view)."""
    own = files.select(key, F.split("text", "\n").alias("s")).where(F.size("s") >= first)
    return own.select(key, F.array_join(F.slice("s", first, last - first + 1), "\n").alias("view"))


def grep(files: DataFrame, key: str, pattern: str, k: int) -> DataFrame:
    """The first k lines that match, by key and line: (key, line_no, text); texts without a match aren't cut into lines."""
    found = lines(files.where(F.col("text").rlike(pattern)), key).where(F.col("text").rlike(pattern))
    return found.orderBy(key, "line_no").limit(k)


def preview(text: Column | str, n: int = 200) -> Column:
    return F.substr(F.col(text) if isinstance(text, str) else text, F.lit(1), F.lit(n))


def votes(df: DataFrame, by: str, text: str, a: str, b: str) -> DataFrame:
    """Which of two words more texts of a group contain, whatever their case: (by, vote)."""
    has = lambda w: F.count_if(F.size(contained(text, [w.upper()])) > 0)
    return df.groupBy(by).agg(has(a).alias("__a"), has(b).alias("__b")).select(by, F.when(F.col("__a") > F.col("__b"), a).when(F.col("__a") < F.col("__b"), b).otherwise("even").alias("vote"))


def words_in(text: Column | str, words: Sequence[str]) -> Column:
    """The words that occur as they stand, comma-joined in the given order."""
    c = F.col(text) if isinstance(text, str) else text
    return F.array_join(F.filter(F.array(*(F.lit(w) for w in words)), lambda w: F.contains(c, w)), ",")


def encoded_id(name: Column | str) -> Column:
    """A name as an id for addresses: base 64 of its bytes without padding."""
    return F.rtrim(F.regexp_replace(F.base64(F.encode(F.col(name) if isinstance(name, str) else name, "UTF-8")), "\r?\n", ""), F.lit("="))


def banded(value: Column | str, *bands: tuple[float, str], default: str) -> Column:
    """The label of the first band whose least value is reached."""
    c, out = F.col(value) if isinstance(value, str) else value, F
    for least, label in bands:
        out = out.when(c >= least, F.lit(label))
    return out.otherwise(F.lit(default))


def labelled(value: Column, labels: Mapping[str, str], default: str) -> Column:
    out = F
    for name, label in labels.items():
        out = out.when(value == name, F.lit(label))
    return out.otherwise(F.lit(default))


def distinct_words(text: Column, pattern: str) -> Column:
    return F.array_join(sorted_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), " ")
