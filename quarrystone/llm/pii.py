"""Personal data in texts (operator 1), by SQL functions only.

Regular expressions propose spans, checksums confirm them (Luhn for cards,
mod 97 for IBANs, ranges for addresses and phone numbers) and whole words in the 40
characters before or after a span raise its score.  Kinds that prove themselves are
reported whatever their score; the others need context to reach the threshold.

Patterns are written so that the regex engine never goes back over what it has
read: possessive runs, and a start only where a run starts or where the last
match ended.  That gives the same matches as the plain patterns, in linear time.

Defined results: null and empty texts have no spans; offsets are code points;
rows are independent, so repeated rows, null ids and other columns, whatever their
names, change nothing; an empty table gives an empty table; the time for a very long
text grows with its length and n log n with its n matches.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.llm.spans import bytes_of, joined, let, match_spans, only_if, replaced, with_bytes
from quarrystone.llm.tables import two_columns

CONTEXT_CHARS = 40
CONTEXT_BONUS = 0.4
THRESHOLD = 0.5
BASE_KINDS = ("email", "ip", "card", "phone")


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    score: float
    context: str
    marker: str | None = None  # a character without which there is no match


# Patterns of the kinds, their prior scores and context words.
_LOCAL = "[A-Za-z0-9._%+-]"
KINDS = (
    Kind("email", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.9, "mail|contact|write to", "@"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.6, "ip|host|server|address|login", "."),
    Kind("card", r"[0-9](?:[ -]?[0-9]){12,}+", 0.8, "card|visa|credit|debit|payment"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", 0.6, "phone|tel|call|mobile|fax", "+"),
    Kind("iban", r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", 0.9, "iban|account|bank"),
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", 0.2, "ssn|social security", "-"),
)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _ip_ok(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), lambda p: F.coalesce(p.try_cast("bigint") <= 255, F.lit(False)))


def _card_ok(value: Column) -> Column:
    return let(_digits(value), lambda d: F.char_length(d).between(13, 19) & F.call_function("luhn_check", d))


def _phone_ok(value: Column) -> Column:
    return F.char_length(_digits(value)).between(9, 15)


def mod97(value: Column) -> Column:
    """Remainder of an IBAN-like string by 97, its first four characters moved to the end."""
    moved = F.concat(F.substr(value, F.lit(5)), F.substr(value, F.lit(1), F.lit(4)))

    def step(acc: Column, c: Column) -> Column:
        number = F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return (acc * F.when(number > 9, 100).otherwise(10) + number) % 97

    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), step)


_CONFIRM = {"ip": _ip_ok, "card": _card_ok, "phone": _phone_ok, "iban": lambda v: mod97(v) == 1}


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _near(raw: Column, s: Column, kind: Kind) -> Column:
    """Whether a context word stands, as a word, in the characters before or after a span.

    One character more is read on each side, to see where a word begins or ends.
    """
    n, most = CONTEXT_CHARS + 1, 4 * (CONTEXT_CHARS + 1)  # characters, and the bytes that hold as many at least
    stop = s["byte"] + F.octet_length(s["value"])
    before = bytes_of(raw, F.greatest(s["byte"] - most, F.lit(0)), F.least(s["byte"], F.lit(most)))
    before = F.right(F.when(s["start"] < n, F.concat(F.lit(" "), before)).otherwise(before), F.lit(n))
    after = F.left(F.concat(bytes_of(raw, stop, F.lit(most)), F.lit(" ")), F.lit(n))
    return _lower(before).rlike(f"[^a-z0-9](?:{kind.context})(?:[^a-z0-9]|$)") | _lower(after).rlike(f"(?:^|[^a-z0-9])(?:{kind.context})[^a-z0-9]")


def _spans(text: Column, raw: Column, kind: Kind) -> Column:
    found = match_spans(text, kind.pattern)
    if kind.marker:
        found = only_if(F.contains(text, F.lit(kind.marker)), found)
    if kind.name in _CONFIRM:
        found = F.filter(found, lambda s: _CONFIRM[kind.name](s["value"]))
    if kind.name not in BASE_KINDS:  # not a part of a longer word or number
        inside = lambda at: bytes_of(raw, at, F.lit(1)).rlike("[A-Za-z0-9]")
        found = F.filter(found, lambda s: ~(((s["byte"] > 0) & inside(F.greatest(s["byte"], F.lit(1)) - 1)) | inside(s["byte"] + F.octet_length(s["value"]))))

    def scored(s: Column) -> Column:
        score = F.lit(kind.score) + F.when(_near(raw, s, kind), F.lit(CONTEXT_BONUS)).otherwise(F.lit(0.0))
        return F.struct(F.lit(kind.name).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["byte"].alias("byte"), s["value"].alias("value"), F.least(score, F.lit(1.0)).alias("score"))

    out = F.transform(found, scored)
    return out if kind.name in BASE_KINDS else F.filter(out, lambda s: s["score"] >= THRESHOLD)


def _all_spans(text: Column) -> Column:
    return with_bytes(text, lambda raw: F.concat(*(_spans(text, raw, k) for k in KINDS)))


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of personal data: ``id_col``, ``spans array<struct<kind,start,end,byte,value,score>>`` by kind, then start."""
    src = two_columns(df, id_col, text_col)
    return src.select(id_col, _all_spans(F.col(text_col)).alias("spans"))


def mask_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts with exactly the spans of :func:`find_pii` replaced by their kind in brackets: ``id_col``, ``masked``.  Spans that overlap get one label, that of the first."""
    src = two_columns(df, id_col, text_col)
    region = lambda s: F.struct(s["byte"].alias("byte"), (s["byte"] + F.octet_length(s["value"])).alias("stop"), F.concat(F.lit("["), s["kind"], F.lit("]")).alias("label"))
    return src.select(id_col, replaced(F.col(text_col), F.transform(_all_spans(F.col(text_col)), region)).alias("masked"))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query of operator 1 over all of ``documents``."""
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    percent = F.transform("spans", lambda s: F.round(100 * s["score"]).cast("int").cast("string"))
    return found.select("doc_id", *(count(k) for k in BASE_KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.array_join(percent, ",").alias("scores"))


def _kind_sql(name: str, pattern: str, ok: str) -> str:
    kind = next(k for k in KINDS if k.name == name)
    lower = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    return f"""{name}_m AS (SELECT doc_id, text, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS g FROM d),
{name}_p AS (SELECT doc_id, text, m[i] AS v, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM {name}_m)),
{name}_s AS (SELECT doc_id, '{name}' AS kind, s::BIGINT AS s, (s + length(v))::BIGINT AS e, least(100, {round(100 * kind.score)} + CASE WHEN near THEN {round(100 * CONTEXT_BONUS)} ELSE 0 END) AS score FROM (
  SELECT *, regexp_matches(translate(right(' ' || substr(text, greatest(s - 41, 0)::BIGINT + 1, least(s, 41)::BIGINT), 41), {lower}), '[^a-z0-9](?:{kind.context})(?:[^a-z0-9]|$)')
    OR regexp_matches(translate(left(substr(text, (s + length(v))::BIGINT + 1, 41) || ' ', 41), {lower}), '(?:^|[^a-z0-9])(?:{kind.context})[^a-z0-9]') AS near,
    (s > 0 AND regexp_matches(substr(text, greatest(s, 1)::BIGINT, 1), '[A-Za-z0-9]')) OR regexp_matches(substr(text, (s + length(v))::BIGINT + 1, 1), '[A-Za-z0-9]') AS inside,
    regexp_replace(v, '[^0-9]', '', 'g') AS digits FROM {name}_p) WHERE {ok}),"""


ORACLE = (
    "WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),\n"
    + _kind_sql("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true")
    + _kind_sql("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "list_max(list_transform(string_split(v, '.'), lambda x: coalesce(try_cast(x AS HUGEINT), 999))) <= 255")
    + _kind_sql(
        "card",
        r"[0-9](?:[ -]?[0-9])+",
        "length(digits) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1), lambda i: CASE WHEN i % 2 = 1 THEN digits[length(digits) + 1 - i]::INT ELSE (digits[length(digits) + 1 - i]::INT * 2) % 10 + (digits[length(digits) + 1 - i]::INT * 2) // 10 END)) % 10 = 0",
    )
    + _kind_sql("phone", r"\+[0-9][ ().0-9-]+[0-9]", "length(digits) BETWEEN 9 AND 15")
    + _kind_sql(
        "iban",
        r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}",
        "NOT inside AND array_to_string(list_transform(string_split(v[5:] || v[1:4], ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c ELSE (ascii(c) - 55)::VARCHAR END), '')::DECIMAL(38, 0) % 97 = 1",
    )
    + _kind_sql("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "NOT inside AND near")
    + """
a AS (SELECT *, 1 AS k FROM email_s UNION ALL SELECT *, 2 FROM ip_s UNION ALL SELECT *, 3 FROM card_s UNION ALL SELECT *, 4 FROM phone_s UNION ALL SELECT *, 5 FROM iban_s UNION ALL SELECT *, 6 FROM ssn_s),
j AS (SELECT doc_id, count(*) FILTER (k = 1) AS n_email, count(*) FILTER (k = 2) AS n_ip, count(*) FILTER (k = 3) AS n_card, count(*) FILTER (k = 4) AS n_phone,
  coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s) FILTER (k <= 4), '') AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s) AS spans, string_agg(score, ',' ORDER BY k, s) AS scores FROM a GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_email, 0)::BIGINT AS n_email, coalesce(n_ip, 0)::BIGINT AS n_ip, coalesce(n_card, 0)::BIGINT AS n_card, coalesce(n_phone, 0)::BIGINT AS n_phone,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores FROM d LEFT JOIN j USING (doc_id)
"""
)
