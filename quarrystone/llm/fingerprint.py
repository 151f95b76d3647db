"""Document fingerprints by a homomorphic multiset hash (operator 8).

Every paragraph (a line with a word) is hashed to a wide vector and a text's
fingerprint is the sum of its paragraphs' vectors modulo powers of two.  So the
order of paragraphs doesn't matter, equality of multisets can be read off, and
adding or taking out a paragraph adds or subtracts its vector.

The vector has two parts: ``EXACT`` numbers of 64 bits from a cryptographic hash
of the paragraph, for equality, and ``LANES`` numbers of 32 bits that sum a sign
for each three-word shingle of the paragraph.  The second part is linear too, and
the cosine of two such sums estimates the cosine of the texts' shingle counts:
the likeness, with a standard error of about ``LANES ** -0.5``.

Neighbours by ascending id are found without a global sort in one task: ids are cut
into ranges at approximate quantiles, and where that gives too few, each range again at
its own quantiles; the first row of each range is also sent to the range before it.

Defined results: null and empty texts have the zero fingerprint; two zero
fingerprints are alike (1.0), one is unlike any other (0.0); rows of equal id are
ordered by text; null ids come last; a document that is alone is its own next one;
an empty table gives an empty table; other columns aren't looked at; a very long text
is held with its edited text and the next one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.llm.tables import two_columns
from quarrystone.llm.textblocks import mix64, scan_words, text_buffers, window_hashes

EXACT = 8
LANES = 128
SHINGLE = 3
RANGE_ROWS = 1000
MOST_CUTS = 4096  # bound of the quantiles that one aggregate finds
SAMPLED_IDS = 1 << 20  # ids from which one aggregate learns where to cut, about
MOST_RANGES = 1 << 21  # bound of the starts that every task is given: 16 MB
FLUSH_ROWS, FLUSH_CHARS = 500, 1 << 22

_NEWLINE = 10


def _paragraphs(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lines of all rows as one column, and the row of each."""
    data, offsets = text_buffers(column)
    breaks = np.flatnonzero(data == _NEWLINE) + 1
    cuts = np.union1d(offsets, breaks)
    if len(cuts) < 2:
        return pa.array([], pa.large_string()), np.zeros(0, np.int64)
    lines = pa.Array.from_buffers(pa.large_string(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())])
    return lines, np.searchsorted(offsets, cuts[:-1], side="right") - 1


def fingerprints(column: pa.Array) -> np.ndarray:
    """One row of EXACT + LANES numbers for each text."""
    n = len(column)
    out = np.zeros((n, EXACT + LANES), np.uint64)
    lines, row_of = _paragraphs(column)
    for words in scan_words(lines):
        raw = words.data.tobytes()
        own = row_of[words.first_row : words.first_row + words.n_rows]
        full = np.flatnonzero(words.counts > 0)
        if not len(full):
            continue
        digests = b"".join([hashlib.blake2b(raw[a:b].rstrip(b"\n")).digest() for a, b in zip(words.offsets[full].tolist(), words.offsets[full + 1].tolist(), strict=True)])
        exact = np.frombuffer(digests, "<u8").reshape(-1, EXACT)
        rows, first = np.unique(own[full], return_index=True)
        out[rows, :EXACT] += np.add.reduceat(exact, first, axis=0)
        hashes, begin = window_hashes(words, SHINGLE)
        of = own[np.searchsorted(words.row_end, begin, side="right")]
        short = full[words.counts[full] < SHINGLE]
        if len(short):  # a short paragraph is one shingle
            hashes = np.concatenate([hashes, exact[np.searchsorted(full, short), 0]])
            of = np.concatenate([of, own[short]])
            order = np.argsort(of, kind="stable")
            hashes, of = hashes[order], of[order]
        for start in range(0, len(hashes), 1 << 15):
            h, r = hashes[start : start + (1 << 15)], of[start : start + (1 << 15)]
            rows, first, count = np.unique(r, return_index=True, return_counts=True)
            for lane in range(0, LANES, 64):
                bits = np.unpackbits((mix64(h + np.uint64(lane)) if lane else h).view(np.uint8).reshape(-1, 8), axis=1)
                ones = np.add.reduceat(bits, first, axis=0, dtype=np.int64)
                out[rows, EXACT + lane : EXACT + lane + 64] += (2 * ones - count[:, None]).view(np.uint64)
    out[:, EXACT:] &= np.uint64(0xFFFFFFFF)
    return out


def combine(a: np.ndarray, b: np.ndarray, sign: int = 1) -> np.ndarray:
    """Fingerprint of a text with paragraphs inserted (sign 1) or deleted (sign -1)."""
    out = a + b if sign > 0 else a - b
    out[..., EXACT:] &= np.uint64(0xFFFFFFFF)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated cosine of shingle counts, row by row, within 0 and 1."""
    x, y = (v[:, EXACT:].astype(np.uint32).view(np.int32).astype(np.float64) for v in (a, b))
    nx, ny = np.sqrt((x * x).sum(1)), np.sqrt((y * y).sum(1))
    with np.errstate(invalid="ignore", divide="ignore"):
        cosine = np.clip((x * y).sum(1) / (nx * ny), 0.0, 1.0)
    cosine[(nx == 0) | (ny == 0)] = 0.0
    cosine[(a == b).all(1)] = 1.0
    return np.round(cosine, 6)


def text_of(prints: np.ndarray) -> list[str]:
    """Fingerprints as hexadecimal strings."""
    exact = prints[:, :EXACT].astype(">u8").tobytes()
    lanes = prints[:, EXACT:].astype(">u4").tobytes()
    a, b = 8 * EXACT, 4 * LANES
    return [(exact[i * a : i * a + a] + lanes[i * b : i * b + b]).hex() for i in range(len(prints))]


def fingerprint(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and the fingerprint of every text."""
    src = two_columns(df, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text_of(fingerprints(batch.column(1))), pa.string())], [id_col, "fingerprint"])

    return src.mapInArrow(run, f"{id_col} {src.dtypes[0][1]}, fingerprint string")


def range_starts(ids: DataFrame, n_rows: int, ranges: int, most_cuts: int = MOST_CUTS, sampled: int = SAMPLED_IDS) -> np.ndarray:
    """First ids of about so many ranges of equal numbers of rows of (id), which are ``n_rows``, without nulls.

    One aggregate cuts all ids; past ``most_cuts`` each range is cut again by an
    aggregate of its own group, so that no task has to find all the quantiles.  Only where to cut
    is learned from about ``sampled`` ids an aggregate, picked by their hash; every row is dealt, and rows of one id
    make one range, however many they are.
    """
    coarse = min(ranges, most_cuts)

    def cuts(n: int, rows: int) -> Column:
        picked = F.when(F.pmod(F.xxhash64("id"), F.lit(max(1, rows // sampled))) == 0, F.col("id"))
        return F.percentile_approx(picked, [i / n for i in range(n)], 10 * most_cuts)

    first = ids.agg(F.min("id").alias("low"), cuts(coarse, n_rows).alias("p")).first()
    if first["low"] is None:
        return np.zeros(0, np.int64)
    starts = np.unique(np.array([first["low"], *(first["p"] or [])[1:]], np.int64))
    fine = min(most_cuts, -(-ranges // len(starts)))
    if fine > 1:

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                part = np.searchsorted(starts, batch.column(0).to_numpy(zero_copy_only=False), side="right")
                yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), batch.column(0)], ["part", "id"])

        again = ids.mapInArrow(place, "part int, id long").groupBy("part").agg(cuts(fine, n_rows // len(starts)).alias("p")).select(F.explode(F.slice("p", 2, most_cuts)).alias("id")).distinct()
        starts = np.union1d(starts, np.array([r["id"] for r in again.collect()], np.int64))
    return starts


def with_neighbours(df: DataFrame, id_col: str, text_col: str, range_rows: int = RANGE_ROWS, most_cuts: int = MOST_CUTS) -> DataFrame:
    """Rows dealt by ranges of ids and sorted, each range followed by the next one's first row (``head``)."""
    src = two_columns(df.withColumn(id_col, F.col(id_col).cast("long")), id_col, text_col)
    ids = src.select(F.col(id_col).alias("id")).where("id is not null")
    n_rows = ids.count()
    starts = range_starts(ids, n_rows, int(min(MOST_RANGES, max(1, n_rows // range_rows))), most_cuts)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            known = ~ids.is_null().to_numpy(zero_copy_only=False)
            value = ids.fill_null(0).to_numpy(zero_copy_only=False)
            part = np.where(known, np.maximum(np.searchsorted(starts, value, side="right") - 1, 0), max(len(starts) - 1, 0)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.zeros(len(part), bool)), ids, batch.column(1)], ["part", "head", "id", "body"])
            at = np.flatnonzero(known & np.isin(value, starts))
            if len(at):
                before = (part[at] - 1) % len(starts)
                yield pa.RecordBatch.from_arrays([pa.array(before.astype(np.int32)), pa.array(np.ones(len(at), bool)), ids.take(pa.array(at)), batch.column(1).take(pa.array(at))], ["part", "head", "id", "body"])

    dealt = src.mapInArrow(deal, "part int, head boolean, id long, body string")
    return dealt.repartition("part").sortWithinPartitions("part", "head", F.col("id").asc_nulls_last(), "body")


def edited_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text, its edited text and the next document's text by fingerprint.

    In the edited text the last quarter is replaced by the first as many code
    points of the next document, by ascending id; the last is followed by the first.
    """
    schema = pa.schema([("id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def closed(rows: list[tuple], following: list[tuple]) -> pa.RecordBatch:
        own = [r[3] for r in rows]
        after = [x[3] if x is not None else "" for x in following]
        edited = [t[: len(t) - len(t) // 4] + u[: len(t) // 4] for t, u in zip(own, after, strict=True)]
        mine, changed = fingerprints(pa.array(own, pa.large_string())), fingerprints(pa.array(edited, pa.large_string()))
        # Each next document but the last is the row that follows here.
        tail = fingerprints(pa.array(after[-1:], pa.large_string()))
        same = [i + 1 < len(rows) and following[i] is rows[i + 1] for i in range(len(rows))]
        others = [i for i, ok in enumerate(same[:-1]) if not ok]
        nexts = np.concatenate([mine[1:], tail])
        if others:
            nexts[others] = fingerprints(pa.array([after[i] for i in others], pa.large_string()))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([r[2] for r in rows], pa.int64()),
                pa.array([len(t) for t in own], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
                pa.array(text_of(mine)),
                pa.array(text_of(changed)),
                pa.array(likeness(mine, changed)),
                pa.array(likeness(mine, nexts)),
            ],
            schema=schema,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for batch in batches:
            rows, following, chars = [], [], 0
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held is not None:
                    chars += len(held[3])
                    rows.append(held)
                    following.append(row if row[0] == held[0] else None)
                    held = None
                if not row[1]:
                    held = row
                if len(rows) >= FLUSH_ROWS or chars >= FLUSH_CHARS:
                    yield closed(rows, following)
                    rows, following, chars = [], [], 0
            if rows:
                yield closed(rows, following)
        if held is not None:
            yield closed([held], [None])

    out = with_neighbours(df, id_col, text_col).mapInArrow(run, "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumnRenamed("id", id_col)


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query of operator 8 over all of ``documents``."""
    return edited_pairs(spark.read.parquet(f"{sf_dir}/documents.parquet"))
