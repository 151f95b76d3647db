"""Quality rules as a short-circuit cascade (operator 5), by SQL functions only.

Every rule is a condition over measures of a text.  On a sample the rules' selectivity
and cost are estimated in one job, and they are put in the order of rejection per
cost, each judged on what the rules before it leave; a document is out at the first
rule that rejects it, so the measures of later rules aren't computed for it.  The
order changes the work, never the verdict.

The cost of a rule is the work counted for its measures: characters, words and lines
of the sample's texts, times what each measure does with them.  So it doesn't depend
on how busy the machines are.

Defined results: null and empty texts have no words and are rejected by the
least number of words; rows are independent, so repeated rows, null ids and other
columns, whatever their names, change nothing; very long texts take time in proportion
to their length; an empty table, or an empty sample, keeps the rules' given order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.llm.spans import let
from quarrystone.llm.tables import two_columns

SAMPLE_ROWS = 2000  # expected size of the sample on which cost and selectivity are estimated
SAMPLE_SEED = 11
SPACE = "[ \\t\\n\\x0B\\f\\r]+"
SYMBOLS = "[#*$%&|<>]+"
NO_LETTERS = r"[^\p{L}]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def _repeated_words(w: Column) -> Column:
    """Words in three-word windows that occur at least twice."""

    def covered(hashes: Column) -> Column:
        def from_sorted(s: Column) -> Column:
            same = lambda x, i: (i >= 0) & (i < F.size(s)) & (F.get(s, i)["h"] == x["h"])
            again = F.filter(s, lambda x, i: F.coalesce(same(x, i - 1), F.lit(False)) | F.coalesce(same(x, i + 1), F.lit(False)))
            at = F.sort_array(F.transform(again, lambda x: x["i"]))
            start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
            return F.aggregate(at, start, lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"), i.alias("last")), lambda acc: acc["n"])

        all_differ = F.size(F.array_distinct(hashes)) == F.size(hashes)
        return F.when(all_differ, F.lit(0)).otherwise(let(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), from_sorted))

    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(F.size(w) < 3, F.lit(0)).otherwise(let(windows, covered)).cast("long")


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\t\\n\\x0B\\f\\r]"))


def measures(text: Column, w: Column) -> dict[str, Column]:
    """The measures that rules speak of, of a text and its words."""
    return {
        "n_chars": F.char_length(text).cast("long"),
        "n_words": F.size(w).cast("long"),
        "word_chars": F.char_length(F.array_join(w, "")).cast("long"),
        "n_symbols": (F.char_length(text) - F.char_length(F.regexp_replace(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(_lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": _repeated_words(w),
        "n_lines": F.size(_lines(text)).cast("long"),
        "n_letters": F.char_length(F.regexp_replace(text, NO_LETTERS, "")).cast("long"),
        "n_open_lines": F.size(F.filter(_lines(text), lambda x: F.endswith(x, F.lit("...")) | F.endswith(x, F.lit("…")))).cast("long"),
        "n_bullet_lines": F.size(F.filter(_lines(text), lambda x: x.rlike("^[ \\t]*[-*•]"))).cast("long"),
        "n_distinct_words": F.size(F.array_distinct(w)).cast("long"),
    }


#: What each measure does, counted: (for each character, for each word, for each line).
WORK = {
    "n_chars": (0, 0, 0),
    "n_words": (0, 0, 0),
    "word_chars": (1, 1, 0),
    "n_symbols": (2, 0, 0),
    "n_dup_lines": (2, 0, 8),
    "n_repeat_words": (1, 40, 0),
    "n_lines": (1, 0, 4),
    "n_letters": (4, 0, 0),
    "n_open_lines": (1, 0, 6),
    "n_bullet_lines": (1, 0, 10),
    "n_distinct_words": (1, 8, 0),
}
BASE_MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

Measures = Mapping[str, Column]


@dataclass(frozen=True)
class Rule:
    """A rule rejects where its condition over the measures it needs holds."""

    name: str
    needs: tuple[str, ...]
    rejects: Callable[[Measures], Column]
    base: bool = False


RULES = (
    Rule("few_words", ("n_words",), lambda m: m["n_words"] < 50, base=True),
    Rule("repeated_words", ("n_words", "n_repeat_words"), lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"], base=True),
    Rule("word_length", ("n_words", "word_chars"), lambda m: (m["word_chars"] > 14 * m["n_words"]) | (m["word_chars"] < 2 * m["n_words"])),
    Rule("symbols", ("n_words", "n_symbols"), lambda m: 10 * m["n_symbols"] > 3 * m["n_words"]),
    Rule("repeated_lines", ("n_lines", "n_dup_lines"), lambda m: 100 * m["n_dup_lines"] > 60 * m["n_lines"]),
    Rule("few_letters", ("n_chars", "n_letters"), lambda m: 2 * m["n_letters"] < m["n_chars"]),
    Rule("open_lines", ("n_lines", "n_open_lines"), lambda m: 10 * m["n_open_lines"] > 3 * m["n_lines"]),
    Rule("bullet_lines", ("n_lines", "n_bullet_lines"), lambda m: 10 * m["n_bullet_lines"] > 9 * m["n_lines"]),
    Rule("few_distinct_words", ("n_words", "n_distinct_words"), lambda m: 500 * m["n_distinct_words"] < m["n_words"]),
)


def _evaluated(rule: Rule, found: Measures) -> Column:
    """A rule's condition, its measures computed when it is its turn."""
    return let(F.struct(*(found[n].alias(n) for n in rule.needs)), lambda m: rule.rejects({n: m[n] for n in rule.needs}))


def _cost(rule: Rule, chars: int, words_: int, lines: int, n: int) -> float:
    return n + sum(a * chars + b * words_ + c * lines for a, b, c in (WORK[x] for x in rule.needs))


def order_rules(src: DataFrame, text_col: str, rules: Sequence[Rule] = RULES, rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules by rejection per cost on a seeded sample of about ``rows`` rows, each judged on what those before it leave.

    One job evaluates all rules on the sample and counts rows and work by which rules
    reject them: at most 2 ** len(rules) rows come to the driver, and no text.
    """
    fraction = min(1.0, rows / max(1, src.count()))
    sample = src.select(F.col(text_col).alias("text")).sample(fraction, SAMPLE_SEED)

    def over(w: Column) -> Column:
        found = measures(F.col("text"), w)
        bit = lambda i, rule: F.when(_evaluated(rule, found), F.lit(1 << i)).otherwise(F.lit(0))
        mask = reduce(lambda a, b: a + b, (bit(i, r) for i, r in enumerate(rules)))
        return F.struct(mask.alias("mask"), *(found[n].alias(n) for n in ("n_chars", "n_words", "n_lines")))

    judged = sample.select(let(words(F.col("text")), over).alias("m")).select("m.*")
    seen = [tuple(r) for r in judged.groupBy("mask").agg(F.count("*"), F.sum("n_chars"), F.sum("n_words"), F.sum("n_lines")).collect()]
    return _greedy(seen, rules)


def _greedy(seen: Iterable[tuple[int, int, int, int, int]], rules: Sequence[Rule]) -> list[Rule]:
    """``seen``: which rules reject, as bits, with rows, characters, words and lines."""
    left, out, rest = list(seen), [], list(enumerate(rules))
    while rest:
        n, chars, words_, lines = (sum(x[k] for x in left) for k in range(1, 5))
        worth = [(sum(x[1] for x in left if x[0] >> i & 1) / max(1.0, _cost(r, chars, words_, lines, n)), -k) for k, (i, r) in enumerate(rest)]
        i, best = rest.pop(-max(worth)[1])
        out.append(best)
        left = [x for x in left if not x[0] >> i & 1]
    return out


def verdict(rules: Sequence[Rule], condition: Callable[[Rule], Column], first: Column | None = None) -> Column:
    """True where no rule rejects, nor ``first``; a CASE stops at the first that does."""
    out = F if first is None else F.when(first, F.lit(False))
    for rule in rules:
        out = out.when(condition(rule), F.lit(False))
    return out.otherwise(F.lit(True))


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = RULES, ordered: Sequence[Rule] | None = None) -> DataFrame:
    """Base measures of every row, whether a base rule rejects it, and the verdict.

    The base measures are asked for of every row, and rules over them alone are free
    then, so they come first; the others go in the order of the sample.
    """
    src = two_columns(df, id_col, text_col)
    known = [r for r in rules if set(r.needs) <= {*BASE_MEASURES, "n_chars"}]
    cascade = order_rules(src, text_col, [r for r in rules if r not in known]) if ordered is None else [r for r in ordered if r not in known]
    own = src.select("*", words(F.col(text_col)).alias("__words"))
    found = measures(F.col(text_col), F.col("__words"))
    own = own.select("*", *(found[n].alias(n) for n in BASE_MEASURES))
    now = found | {n: F.col(n) for n in BASE_MEASURES}
    failed = lambda some: reduce(lambda a, b: a | b, (r.rejects(now) for r in some), F.lit(False))
    own = own.select("*", failed(r for r in known if r.base).alias("base_failed"), failed(known).alias("__failed"))
    return own.select(id_col, *BASE_MEASURES, "base_failed", verdict(cascade, lambda r: _evaluated(r, now), F.col("__failed")).alias("kept"))


def keep_good(df: DataFrame, text_col: str = "text", rules: Sequence[Rule] = RULES, ordered: Sequence[Rule] | None = None) -> DataFrame:
    """The rows that no rule rejects, all columns as they were.

    All measures are computed inside the CASE, so a row that one rule rejects doesn't
    pay for the rules after it.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    ordered = order_rules(df.select(text.alias("text")), "text", rules) if ordered is None else ordered

    def over(w: Column) -> Column:
        found = measures(text, w)
        return verdict(ordered, lambda r: _evaluated(r, found))

    return df.where(let(words(text), over))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query of operator 5 over all of ``documents``."""
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(string_split_regex(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) AS l FROM d),
g AS (SELECT doc_id, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM w WHERE len(w) >= 3)),
again AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, k) AS n FROM g) WHERE n > 1),
cover AS (SELECT doc_id, count(DISTINCT p + o)::BIGINT AS n FROM again, (SELECT unnest([0, 1, 2]) AS o) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  length(text) AS n_chars, length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS n_letters, len(list_filter(l, lambda x: suffix(x, '...') OR suffix(x, '…'))) AS n_open, len(list_filter(l, lambda x: regexp_matches(x, '^[ \t]*[-*•]'))) AS n_bullet, len(list_distinct(w)) AS n_distinct,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l) AS n_lines, coalesce(cover.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN cover USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR word_chars > 14 * n_words OR word_chars < 2 * n_words OR 10 * n_symbols > 3 * n_words OR 100 * n_dup_lines > 60 * n_lines OR 2 * n_letters < n_chars OR 10 * n_open > 3 * n_lines OR 10 * n_bullet > 9 * n_lines OR 500 * n_distinct < n_words) AS kept FROM b
"""
