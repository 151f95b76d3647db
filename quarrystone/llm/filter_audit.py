"""Interaction audit of five filters over a sparse document-term matrix (operator 13).

1. Shards of the corpus, a few MB of text each, are counted into compressed sparse
   rows over words of their own.
2. The distinct words of every shard meet by ranges of their hash, compared as whole
   strings, and get one code each for the whole corpus.  A word that is in every
   document is one entry a shard.
3. The codes go back to the shards, which are then rows of one matrix.  The sum of a
   row is its number of words and its number of entries that of distinct words, which decide
   filters A and B.
4. C and D are counted on the bytes while the shards are built.  For E the least id of
   each text is aggregated by a digest of 128 bits and joined.
5. What the 120 orders need is only how many documents of a part fail which set of
   filters: at most 32 sets a part.  Orders are taken from these counts.

Defined results: null texts count as empty, null sources are the part "" like empty
ones; rows of equal id are each counted, and don't make each other copies; a row with a null id is never
a copy and has no label; a document that any row of ``labels`` calls good (or toxic) is good (or toxic); an
empty table gives an empty table; other columns aren't looked at.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.llm.sketches import pack, unpack
from quarrystone.llm.tables import cut_lineage
from quarrystone.llm.textblocks import text_buffers

SHARD_BYTES = 12_000_000
GROUP_WORDS = 400_000  # entries of the dictionary in one task, repeated for each shard that has them

FILTERS = "ABCDE"
MARKS = b"#$%&*|"  # characters that fail D
_BIT = {x: 1 << i for i, x in enumerate(FILTERS)}

_DOCS = "ids array<long>, parts array<string>, digests array<binary>, flags array<int>"
_CSR = "indptr binary, indices binary, counts binary"


def _shard_matrix(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of some texts and their counts as sparse rows (indptr, indices, counts); words ascend by hash."""
    lists = pc.ascii_split_whitespace(texts)  # space and 0x09 to 0x0D
    coded = lists.flatten().dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    words, code = coded.dictionary, coded.indices.to_numpy()
    hashes = pd.util.hash_array(np.asarray(words.to_pylist() or [""], dtype=object)[: len(words)], categorize=False)
    order = np.argsort(hashes, kind="stable")
    order = order[pc.binary_length(words).to_numpy()[order] > 0]  # a text that begins or ends with a space has an empty word there
    to = np.full(len(words), -1, np.int64)
    to[order] = np.arange(len(order))
    row, code = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy()), to[code]
    row, code = row[code >= 0], code[code >= 0]
    entries, counts = np.unique(row * max(1, len(order)) + code, return_counts=True)
    row = entries // max(1, len(order))
    indptr = np.searchsorted(row, np.arange(len(texts) + 1))
    return words.take(pa.array(order)), indptr.astype(np.int64), (entries - row * max(1, len(order))).astype(np.int32), counts.astype(np.int32)


def _range_of(words: list[str], groups: int) -> np.ndarray:
    """The group of each word: equal ranges of the hash, so that words ascending by hash ascend by group too."""
    return ((pd.util.hash_array(np.asarray(words, dtype=object), categorize=False) >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)).astype(np.int32)


def _flags(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """C and D of each text."""
    total = lambda of: np.diff(np.concatenate(([0], np.cumsum(of, dtype=np.int64)))[offsets])
    upper, points = total((data >= 65) & (data <= 90)), total((data & 0xC0) != 0x80)
    marked = total(np.isin(data, np.frombuffer(MARKS, np.uint8))) > 0
    return (_BIT["C"] * (100 * upper > 2 * points) + _BIT["D"] * marked).astype(np.int32)


def _local_shards(df: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """(shard, words, n_terms, the documents' own columns, sparse rows over the shard's words)."""
    src = df.select(F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.coalesce(F.col(part_col).cast("string"), F.lit("")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), itertools.count()
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SHARD_BYTES, side="right")) - 1)
                texts = batch.column(1).slice(at, to - at)
                words, *csr = _shard_matrix(texts)
                raw = data[offsets[at] : offsets[to]]
                digests = [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in itertools.pairwise((offsets[at : to + 1] - offsets[at]).tolist())]
                yield pa.RecordBatch.from_pydict(
                    {"shard": pa.array([task << 32 | next(number)], pa.int64()), "words": pa.array([words], pa.list_(pa.string())), "n_terms": pa.array([len(words)], pa.int64()),
                     "ids": pa.array([batch.column(0).slice(at, to - at)], pa.list_(pa.int64())), "parts": pa.array([batch.column(2).slice(at, to - at)], pa.list_(pa.string())),
                     "digests": pa.array([digests], pa.list_(pa.binary())), "flags": pa.array([_flags(raw, offsets[at : to + 1] - offsets[at])], pa.list_(pa.int32())),
                     **{x: pa.array([pack(y)], pa.binary()) for x, y in zip(("indptr", "indices", "counts"), csr, strict=True)}})
                at = to

    return src.mapInArrow(run, f"shard long, words array<string>, n_terms long, {_DOCS}, {_CSR}")


def _encoded(shards: DataFrame) -> DataFrame:
    """(shard, part, codes): the code in the whole corpus of each word of a shard, by ranges of the words' hash in order."""
    terms = shards.agg(F.sum("n_terms").alias("n")).first()["n"] or 0
    groups = max(8, terms // GROUP_WORDS)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, words in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if len(words):
                    part = _range_of(words.values.to_pylist(), groups)
                    cuts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
                    lists = pa.ListArray.from_arrays(pa.array(np.append(cuts, len(part)), pa.int32()), words.values)
                    yield pa.RecordBatch.from_arrays([pa.array(part[cuts]), pa.array(np.full(len(cuts), shard)), lists], ["part", "shard", "words"])

    def code(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("shard")
        lists = table.column("words").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        codes = lists.flatten().dictionary_encode().indices.to_numpy().astype(np.int64) + (key[0].as_py() << 32)
        bounds = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy())))
        return pa.table({"shard": table.column("shard"), "part": table.column("part"), "codes": pa.array([pack(codes[a:b]) for a, b in itertools.pairwise(bounds)], pa.binary())})

    dealt = shards.select("shard", "words").mapInArrow(deal, "part int, shard long, words array<string>")
    return dealt.groupBy("part").applyInArrow(code, "shard long, part int, codes binary")


def term_matrix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """The document-term matrix in shards of sparse rows.

    A shard has arrays of its documents' ids, parts, text digests and flags, and ``indptr`` (row
    bounds), ``indices`` (codes of words in the whole corpus) and ``counts`` as packed int64, int64 and int32.
    """
    local = cut_lineage(_local_shards(df, id_col, text_col, part_col))

    def run(shard: pa.Table, codes: pa.Table) -> pa.Table:
        codes = codes.sort_by("part").column("codes").to_pylist()
        code_of = np.concatenate([np.zeros(0, np.int64), *(unpack(x, "int64") for x in codes)])
        indices = [pack(code_of[unpack(x, "int32")]) for x in shard.column("indices").to_pylist()]
        return shard.set_column(shard.schema.get_field_index("indices"), "indices", pa.array(indices, pa.binary()))

    matrix = local.drop("words", "n_terms").groupBy("shard").cogroup(_encoded(local).groupBy("shard"))
    return matrix.applyInArrow(run, f"shard long, {_DOCS}, {_CSR}")


def row_measures(matrix: DataFrame) -> DataFrame:
    """(id, part, digest, n_words, n_distinct, flags) of each document, from the rows of the matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, parts, digests, flags = (batch.column(x)[i].values for x in ("ids", "parts", "digests", "flags"))
                indptr, counts = unpack(batch.column("indptr")[i].as_py(), "int64"), unpack(batch.column("counts")[i].as_py(), "int32")
                sums = np.diff(np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))[indptr])
                yield pa.RecordBatch.from_arrays([ids, parts, digests, pa.array(sums), pa.array(np.diff(indptr)), flags], ["id", "part", "digest", "n_words", "n_distinct", "flags"])

    return matrix.mapInArrow(run, "id long, part string, digest binary, n_words long, n_distinct long, flags int")


def failures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(id, part, fails) of each document: the filters that it fails, as bits of A to E from 1 to 16."""
    rows = cut_lineage(row_measures(term_matrix(df, id_col, text_col, part_col)))
    first = rows.groupBy("digest").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1").select("digest", "least")
    rows = rows.join(first, "digest", "left")
    bit = lambda x, fails: F.when(fails, _BIT[x]).otherwise(0)
    fails = F.col("flags") + bit("A", F.col("n_words") < 200) + bit("B", 100 * F.col("n_distinct") < 50 * F.col("n_words")) + bit("E", F.col("id") > F.col("least"))
    return rows.select("id", "part", fails.cast("int").alias("fails"))


def audit(fails: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """What every filter does in every order, by part; 600 rows a part."""
    good_toxic = labels.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    by_set = fails.join(good_toxic, "id", "left").groupBy("part", "fails").agg(F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))
    sets = by_set.groupBy("part").agg(F.collect_list(F.struct("fails", "n", "good", "toxic")).alias("sets"))  # 32 entries at most

    orders = ["".join(o) for o in itertools.permutations(FILTERS)]
    # Bits of the filters applied before each step, and of the step's own.
    steps = [(o, k + 1, sum(_BIT[x] for x in o[:k]), _BIT[o[k]]) for o in orders for k in range(len(o))]
    grid = F.from_json(F.lit(json.dumps([dict(zip(("filter_order", "step", "earlier", "own"), x, strict=True)) for x in steps])), "array<struct<filter_order: string, step: int, earlier: int, own: int>>")
    rows = sets.select("part", "sets", F.explode(grid).alias("at")).select("part", "sets", "at.*")

    def total(of: str, which) -> F.Column:
        return F.aggregate(F.filter("sets", which), F.lit(0).cast("long"), lambda acc, s: acc + s[of])

    has = lambda s, bits: s["fails"].bitwiseAND(bits) != 0
    earlier, own = F.col("earlier"), F.col("own")
    removed = lambda s: has(s, own) & ~has(s, earlier)
    # A document that fails k filters is removed by each of them in 120 / k of the orders.
    shapley = F.aggregate(F.filter("sets", lambda s: has(s, own)), F.lit(0).cast("long"), lambda acc, s: acc + (s["n"] * len(orders) / F.bit_count(s["fails"])).cast("long"))
    return rows.select(
        "part", "filter_order", "step",
        total("n", lambda s: ~has(s, earlier.bitwiseOR(own))).alias("kept"), total("n", removed).alias("removed"), total("n", lambda s: has(s, own) & has(s, earlier)).alias("redundant"),
        total("n", lambda s: s["fails"] == own).alias("unique_fails"), total("good", removed).alias("good_lost"), total("toxic", removed).alias("toxic_lost"), shapley.alias("shapley"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query of operator 13 over all of ``documents`` and ``labels``."""
    return audit(failures(spark.read.parquet(f"{sf_dir}/documents.parquet")), spark.read.parquet(f"{sf_dir}/labels.parquet"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents),
f AS (
  SELECT doc_id, part, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text))::INT
    + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(min(doc_id) OVER (PARTITION BY text) < doc_id, false)::INT AS fails FROM d),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
s AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
x AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) t(name, bit)),
o AS (SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM x a, x b, x c, x d, x e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
st AS (SELECT filter_order, k AS step, coalesce(list_sum(bits[1:k - 1]), 0)::INT AS earlier, bits[k] AS own FROM o, (SELECT unnest(range(1, 6))::INT AS k)),
r AS (
  SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (fails & (earlier | own) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (fails & own <> 0 AND fails & earlier = 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (fails & own <> 0 AND fails & earlier <> 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails = own), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (fails & own <> 0 AND fails & earlier = 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (fails & own <> 0 AND fails & earlier = 0), 0)::BIGINT AS toxic_lost
  FROM s, st GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r
"""
