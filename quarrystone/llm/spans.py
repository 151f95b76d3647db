"""Match positions by SQL functions alone: spans of a pattern in code points and bytes.

Everything here takes time in proportion to the text and n log n for n matches:
sums are formed by doubling, look-ups by halving, and pieces are cut from the bytes
of a text, where a place is reached without reading what stands before it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,byte:int,value:string>>"
_POWERS = [1 << k for k in range(31)]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once for a row and use it several times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Every element combined with all before it; ``combine`` is associative.

    Each pass adds what stands 1, 2, 4, ... places before, so there are log n passes.
    """

    def passes(own: Column) -> Column:
        shifts = F.filter(F.array(*map(F.lit, _POWERS)), lambda p: p < F.size(own))
        return F.aggregate(shifts, own, lambda acc, p: F.transform(acc, lambda x, i: F.when(i < p, x).otherwise(combine(F.get(acc, i - p), x))))

    return let(values, lambda own: F.when(F.size(own) < 2, own).otherwise(passes(own)))


def n_below(ascending: Column, value: Column) -> Column:
    """How many elements of an ascending array are less than a value."""
    shifts = F.filter(F.array(*map(F.lit, reversed(_POWERS))), lambda p: p <= F.size(ascending))
    return F.aggregate(shifts, F.lit(0), lambda n, p: F.when((n + p <= F.size(ascending)) & (F.get(ascending, n + p - 1) < value), n + p).otherwise(n))


def match_spans(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as (start, end, byte, value): code points, and the byte where each starts.

    Splitting a text at a pattern gives the gaps between its matches, so the
    lengths of gaps and matches, summed up, are the positions.  Only texts with
    a match pay for the second scan.
    """

    def place(found: Column) -> Column:
        def with_ends(ends: Column) -> Column:
            return F.zip_with(found, ends, lambda m, e: F.struct((e["c"] - F.char_length(m)).alias("start"), e["c"].alias("end"), (e["b"] - F.octet_length(m)).alias("byte"), m.alias("value")))

        def with_gaps(gaps: Column) -> Column:
            both = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda m, g: F.struct((F.char_length(g) + F.char_length(m)).alias("c"), (F.octet_length(g) + F.octet_length(m)).alias("b")))
            added = running(both, lambda x, y: F.struct((x["c"] + y["c"]).alias("c"), (x["b"] + y["b"]).alias("b")))
            return let(added, with_ends)

        return F.when(F.size(found) == 0, F.array().cast(SPAN)).otherwise(let(F.split(text, pattern, -1), with_gaps))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), place)


def only_if(condition: Column, spans: Column) -> Column:
    """A cheap necessary condition before a scan."""
    return F.when(condition, spans).otherwise(F.array().cast(SPAN))


def apart(spans: Column, others: Column) -> Column:
    """The spans that none of the others overlaps.

    Of the others that start before a span ends, the greatest end decides.
    """

    def with_others(o: Column) -> Column:
        starts = F.transform(o, lambda x: x["start"])
        tops = running(F.transform(o, lambda x: x["end"]), F.greatest)
        free = lambda s, a, t: F.coalesce(F.get(t, F.nullif(n_below(a, s["end"]), F.lit(0)) - 1) <= s["start"], F.lit(True))
        return let(starts, lambda a: let(tops, lambda t: F.filter(spans, lambda s: free(s, a, t))))

    ordered = F.sort_array(F.transform(others, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))))
    return F.when((F.size(others) == 0) | (F.size(spans) == 0), spans).otherwise(let(ordered, with_others))


def bytes_of(raw: Column, at: Column, n: Column) -> Column:
    """``n`` bytes of a text, given as bytes, from byte ``at``, as text."""
    return F.substring(raw, at + 1, n).cast("string")


def with_bytes(text: Column, body: Callable[[Column], Column]) -> Column:
    """The bytes of a text, made once for a row."""
    return let(text.cast("binary"), body)


def replaced(text: Column, regions: Column) -> Column:
    """A text with regions (byte, stop, label) replaced by their labels; regions that overlap are one, with the label of the first."""

    def with_regions(r: Column, raw: Column) -> Column:
        def with_tops(tops: Column) -> Column:
            before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(tops, i - 1))
            pieces = F.transform(r, lambda x, i: F.when(x["byte"] >= before(i), F.concat(bytes_of(raw, before(i), x["byte"] - before(i)), x["label"])).otherwise(F.lit("")))
            last = F.get(tops, F.size(tops) - 1)
            return F.concat(F.array_join(pieces, ""), bytes_of(raw, last, F.octet_length(text) - last))

        return let(running(F.transform(r, lambda x: x["stop"]), F.greatest), with_tops)

    return F.when(F.size(regions) == 0, text).otherwise(with_bytes(text, lambda raw: let(F.sort_array(regions), lambda r: with_regions(r, raw))))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
