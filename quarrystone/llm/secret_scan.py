"""Secrets in texts (operator 2), by SQL functions only.

Three patterns give the base spans.  Besides, long tokens are judged by two
character Markov models, one of random strings and one of ordinary identifiers,
each trained from labelled samples: a token whose log-likelihood ratio per
transition, and in sum, is high enough is a secret too, wherever it stands.

The models are counts of character pairs, aggregated by Spark; what comes to the
driver is one number for each pair of ``SYMBOLS``, a fixed size.  The samples may be
given as a table (text, label); by default they are made from a counter: digests in
several alphabets for random strings, combinations of ordinary words for identifiers.

Defined results: null and empty texts have no spans; offsets are code points;
rows are independent, so repeated rows, null ids and other columns, whatever their
names, change nothing; an empty table gives an empty table; the time for a very long
text grows with its length and n log n with its n matches; of tokens, those that
overlap a base span are not judged; without samples of a class all its transitions
are equally likely.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.llm.spans import apart, joined, let, match_spans, only_if, replaced
from quarrystone.llm.tables import two_columns

SYMBOLS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-="
SAMPLES = 4000  # labelled samples of each class that the default makes
SMOOTHING = 0.5
PER_STEP = 0.6  # least mean log-likelihood ratio
IN_SUM = 16.0  # least total log-likelihood ratio
BASE_KINDS = ("assign", "access", "hex")

# The base patterns and the form of tokens that the models judge.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}+"
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"

# Parts of ordinary identifiers.
PARTS = (
    "account active address amount array async attribute audit backup balance batch binary block buffer build button cache "
    "callback category change channel check child class client close cluster code collection column command comment commit config connection "
    "container content context control count create currency current customer data database date debug default delete depth description detail "
    "device digest directory display document domain driver duration element email enable encoding engine entry error event example execute export "
    "factory failure feature field file filter folder format frame function gateway global group handler header height history host image import "
    "index info input insert instance integer interface internal invoice item iterator job journal key label language latest layout length level "
    "library limit line link list listener load local location lock logger manager mapping margin matrix member memory merge message method metric "
    "minute mobile model module monitor month name network node normal notification number object offset operation option order output package page "
    "parameter parent parser partition password path pattern payment pending percent permission person phone pixel pointer policy position power "
    "prefix previous price primary printer process product profile program project property protocol provider public query queue random range reader "
    "record region register release remote render replace report request reset resource response result return review rotate route sample schedule "
    "schema scope screen script search second section select sequence server service session setting shadow shape signal simple size source space "
    "stack start state status step storage stream string style subject suffix summary switch symbol system table target task template text thread "
    "ticket time title token topic total trace transaction transfer transform tree trigger type update upload user utility validate value variable "
    "vector version view visible volume warning weight widget width window worker wrapper writer year zone"
).split()


def default_samples(spark: SparkSession, n: int = SAMPLES) -> DataFrame:
    """Labelled samples (text, label) made from a counter: 1 random, 0 ordinary."""
    i = F.col("id").cast("string")
    digest = F.sha2(F.concat(F.lit("sample-"), i), 256)
    raw = F.unhex(digest)
    random = F.array(F.base64(raw), digest, F.upper(F.substr(digest, F.lit(1), F.lit(40))), F.translate(F.base64(raw), "+/=", "Aq7"), F.upper(F.translate(F.base64(raw), "+/=", "Aq7")))
    parts = F.array(*(F.lit(p) for p in PARTS))
    part = lambda k: F.get(parts, F.pmod(F.xxhash64(F.col("id"), F.lit(k)), F.lit(len(PARTS))).cast("int"))
    words = [part(k) for k in range(4)]
    ordinary = F.array(F.concat_ws("_", *words), F.concat_ws("-", *words[:3]), F.concat(words[0], *(F.initcap(w) for w in words[1:])), F.concat_ws("/", *words), F.upper(F.concat_ws("_", *words[:3])), F.concat(*words[:2], F.pmod(F.xxhash64("id"), F.lit(1000)).cast("string")), F.concat(*words))
    rows = spark.range(n)
    return rows.select(F.explode(random).alias("text"), F.lit(1).alias("label")).unionByName(rows.select(F.explode(ordinary).alias("text"), F.lit(0).alias("label")))


def fit(samples: DataFrame) -> list[float]:
    """Log-likelihood ratio of every transition, row by row over SYMBOLS, from (text, label)."""
    n = len(SYMBOLS)
    at = F.explode(F.sequence(F.lit(1), F.char_length("text") - 1)).alias("i")
    pairs = samples.where("char_length(text) > 1").select("text", "label", at).select("label", F.substr("text", F.col("i"), F.lit(1)).alias("a"), F.substr("text", F.col("i") + 1, F.lit(1)).alias("b"))
    place = lambda c: F.instr(F.lit(SYMBOLS), F.col(c)) - 1
    counted = pairs.select("label", place("a").alias("a"), place("b").alias("b")).where("a >= 0 and b >= 0").groupBy("label", "a", "b").count().collect()
    count = [[[SMOOTHING] * n for _ in range(n)] for _ in range(2)]
    for label, a, b, c in counted:
        count[int(label)][a][b] += c
    out = []
    for a in range(n):
        ordinary, random = (sum(count[k][a]) for k in (0, 1))
        out += [math.log(count[1][a][b] / random) - math.log(count[0][a][b] / ordinary) for b in range(n)]
    return out


def ratio(token: Column, model: list[float]) -> Column:
    """Sum of the log-likelihood ratios of a token's transitions."""
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in model)), ",").cast("array<double>")  # folded to a constant
    places = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(SYMBOLS), c) - 1)
    pairs = F.zip_with(F.slice(places, F.lit(1), F.size(places) - 1), F.slice(places, F.lit(2), F.size(places) - 1), lambda a, b: F.get(table, a * len(SYMBOLS) + b))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))


def _named(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["byte"].alias("byte"), s["value"].alias("value"), F.lit(None).cast("double").alias("score")))


def _base_spans(text: Column) -> Column:
    assign = F.filter(match_spans(text, ASSIGN), lambda s: F.char_length(F.regexp_extract(s["value"], ASSIGN, 2)) >= 12)
    words = F.lower(text)
    likely = F.contains(words, F.lit("passw")) | F.contains(words, F.lit("secret")) | F.contains(words, F.lit("token")) | F.contains(words, F.lit("api"))
    access = only_if(F.contains(text, F.lit("AKIA")), match_spans(text, ACCESS))
    return F.concat(_named("assign", only_if(likely, assign)), _named("access", access), _named("hex", match_spans(text, HEX)))


def _all_spans(text: Column, model: list[float]) -> Column:
    """Base spans and, apart from them, tokens that the models call random: by start, then kind as listed."""
    steps = lambda s: F.greatest(F.char_length(s["value"]) - 1, F.lit(1))
    order = lambda k: F.array_position(F.array(*(F.lit(x) for x in (*BASE_KINDS, "random"))), k)

    def with_base(base: Column) -> Column:
        judged = F.transform(apart(match_spans(text, TOKEN), base), lambda s: F.struct(F.lit("random").alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["byte"].alias("byte"), s["value"].alias("value"), ratio(s["value"], model).alias("score")))
        secret = F.filter(judged, lambda s: (s["score"] >= IN_SUM) & (s["score"] >= PER_STEP * steps(s)))
        keyed = F.transform(F.concat(base, secret), lambda s: F.struct(s["start"].alias("start"), order(s["kind"]).alias("k"), *(s[x].alias(x) for x in ("kind", "end", "byte", "value", "score"))))
        return F.transform(F.sort_array(keyed), lambda s: F.struct(*(s[x].alias(x) for x in ("kind", "start", "end", "byte", "value", "score"))))

    return let(_base_spans(text), with_base)


def find_secrets(df: DataFrame, model: list[float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``spans array<struct<kind,start,end,byte,value,score>>`` by start, then kind as listed."""
    model = model or fit(default_samples(df.sparkSession))
    src = two_columns(df, id_col, text_col)
    return src.select(id_col, _all_spans(F.col(text_col), model).alias("spans"))


def mask_secrets(df: DataFrame, model: list[float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts with exactly the spans of :func:`find_secrets` replaced by [SECRET]; all other columns as they were.

    Of an assignment only the value is replaced, so its name stays.  Null texts stay null.
    """
    model = model or fit(default_samples(df.sparkSession))
    names = {c: f"__own_{i}" for i, c in enumerate(df.columns)}
    own = df.select(*(F.col(c).alias(n) for c, n in names.items()))
    return own.withColumn(names[text_col], _masked(F.col(names[text_col]), model)).select(*(F.col(n).alias(c) for c, n in names.items()))


def _masked(text: Column, model: list[float]) -> Column:
    def region(s: Column) -> Column:
        stop = s["byte"] + F.octet_length(s["value"])
        secret = F.when(s["kind"] == "assign", F.regexp_extract(s["value"], ASSIGN, 2)).otherwise(s["value"])
        return F.struct((stop - F.octet_length(secret)).alias("byte"), stop.alias("stop"), F.lit("[SECRET]").alias("label"))

    return replaced(text, F.transform(_all_spans(F.coalesce(text, F.lit("")), model), region))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query of operator 2 over all of ``documents``."""
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select("doc_id", *(count(k) for k in BASE_KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
