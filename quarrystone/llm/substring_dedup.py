"""Substring deduplication with a count-min prefilter (operator 3).

1. Every partition counts its windows (13 consecutive words) in a count-min
   sketch; the partial sketches are merged block by block.  Merged counts are
   never too small.
2. Only windows whose estimate is at least two are sent on, grouped by a range of
   their 96-bit hash, and there the smallest document of each is found exactly.
   A task sends only its own smallest document of a window to that group; its other
   documents have lost the window already.  So a window that is in every document
   has one entry for each few million windows read, and not one for each document.
3. For every document the windows that also start in a document with a smaller
   id come back, grouped with the texts, and the words they cover are removed.

The sketch's width follows the corpus up to ``cap_bits``; past that the
prefilter lets more through and the exact pass decides, so nothing is lost.

Defined results: null text counts as no words; documents with fewer words than a
window lose nothing; rows of equal id don't remove words from each other; a row
with a null id is neither earlier nor later than any other and loses nothing; an
empty table gives an empty table; other columns aren't looked at; a very long text is
read in one piece, which takes about 60 bytes of memory for each of its bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.llm import sketches as S
from quarrystone.llm.tables import two_columns
from quarrystone.llm.textblocks import mix64, scan_words, window_hashes

WINDOW = 13
BYTES_PER_WORD = 6  # only to size the sketch and the groups
DEPTH = 2
SLOTS_PER_WINDOW = 1.0
CAP_BITS = 29  # at most 2 ** 29 slots a row: two rows of 64 MB, as one bit a slot
GROUP_WINDOWS = 400_000
GROUP_BYTES = 12_000_000
HELD_WINDOWS = 3_000_000

_EXACT = "part int, h1 binary, h2 binary, doc binary"
_BACK = "part int, doc binary, h1 binary"


def _rows_of(words, first: np.ndarray) -> np.ndarray:
    return np.searchsorted(words.row_end, first, side="right")


def _part_of(doc: np.ndarray, parts: int) -> np.ndarray:
    return (mix64(doc.astype(np.int64).view(np.uint64)) % np.uint64(parts)).astype(np.int32)


def remove_repeated_windows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, cap_bits: int = CAP_BITS, keep_text: bool = False, inspect: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """Remove words covered by windows that also start in a document with a smaller id.

    Returns ``id_col``, n_words, n_removed, kept_sha256 and, with ``keep_text``,
    the kept words joined by one space as ``text``.  ``inspect`` is given the messages
    (part, h1, h2, doc) of the windows estimated repeated.
    """
    spark = df.sparkSession
    src = two_columns(df.withColumn(id_col, F.col(id_col).cast("long")), id_col, text_col)
    size = src.agg(F.sum(F.octet_length(text_col)).alias("bytes")).first()["bytes"] or 0
    windows = size // BYTES_PER_WORD
    width = S.width_for(windows, SLOTS_PER_WINDOW, cap_bits)
    blocks = min(width >> 3, 1 << max(4, int(np.ceil(np.log2(windows / GROUP_WINDOWS + 1)))))
    parts = max(16, size // GROUP_BYTES)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = S.PartitionSketch(width, DEPTH, blocks)
        for batch in batches:
            for words in scan_words(batch.column(1)):
                hashes, first = window_hashes(words, window)
                if len(hashes):  # a window counts once for a document
                    rows = _rows_of(words, first)
                    order = np.lexsort((hashes, rows))
                    h, r = hashes[order], rows[order]
                    sketch.add(h[np.concatenate(([True], (h[1:] != h[:-1]) | (r[1:] != r[:-1])))])
                if sketch.full(HELD_WINDOWS):
                    yield pa.RecordBatch.from_pydict(sketch.drain(), sketch.SCHEMA)
        yield pa.RecordBatch.from_pydict(sketch.drain(), sketch.SCHEMA)

    partials = src.where(F.col(id_col).isNotNull()).mapInArrow(count, "block int, slots binary, counts binary")
    bits = S.gather(S.merge(partials, width, blocks, S.at_least_two), blocks, DEPTH, width // blocks // 8)
    shared = spark.sparkContext.broadcast(bits)  # depth * width / 8 bytes, bounded by cap_bits

    exact_parts = max(16, windows // GROUP_WINDOWS // 4)

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def drain() -> pa.RecordBatch:
            h1, h2, doc = (np.concatenate([x[i] for x in held]) for i in range(3))
            held.clear()
            order = np.lexsort((doc, h2, h1))
            h1, h2, doc = h1[order], h2[order], doc[order]
            opens = np.concatenate(([True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])))
            late = doc > doc[opens][np.cumsum(opens) - 1]
            # Of each window only the least document goes on; groups of negative numbers say which others have lost it.
            part = np.where(late, -1 - _part_of(doc, parts), ((h1 >> np.uint64(32)) % np.uint64(exact_parts)).astype(np.int32))
            order = np.flatnonzero(late | opens)
            order = order[np.argsort(part[order], kind="stable")]
            part, h1, h2, doc = part[order], h1[order], h2[order], doc[order]
            cuts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True])))
            span = list(zip(cuts[:-1], cuts[1:], strict=True))
            return pa.RecordBatch.from_pydict(
                {"part": part[cuts[:-1]], "h1": [S.pack_sorted(h1[a:b]) for a, b in span], "h2": [S.pack(h2[a:b]) if part[a] >= 0 else None for a, b in span], "doc": [S.pack(doc[a:b]) for a, b in span]},
                pa.schema([("part", pa.int32()), ("h1", pa.binary()), ("h2", pa.binary()), ("doc", pa.binary())]),
            )

        n = 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for words in scan_words(batch.column(1)):
                hashes, first = window_hashes(words, window)
                keep = S.repeated(shared.value, width, hashes)
                if not len(keep):
                    continue
                rows, h1 = _rows_of(words, first[keep]), hashes[keep]
                order = np.lexsort((h1, rows))
                once = order[np.concatenate(([True], (h1[order][1:] != h1[order][:-1]) | (rows[order][1:] != rows[order][:-1])))]
                h2 = window_hashes(words, window, seed=2)[0][keep][once].astype(np.uint32)
                held.append((h1[once], h2, ids[words.first_row + rows[once]]))
                n += len(once)
                if n >= HELD_WINDOWS:
                    yield drain()
                    n = 0
        if held:
            yield drain()

    proposed = src.where(F.col(id_col).isNotNull()).mapInArrow(propose, _EXACT)
    if inspect is not None:
        inspect(proposed)

    def decide(key: tuple, table: pa.Table) -> pa.Table:
        if key[0].as_py() < 0:  # decided already
            return pa.table({"part": pa.array([-1 - key[0].as_py()] * len(table), pa.int32()), "doc": table.column("doc"), "h1": pa.array([S.pack(S.unpack_sorted(x, "uint64")) for x in table.column("h1").to_pylist()], pa.binary())})
        columns = [(S.unpack_sorted(a, "uint64"), S.unpack(b, "uint32"), S.unpack(c, "int64")) for a, b, c in zip(*(table.column(x).to_pylist() for x in ("h1", "h2", "doc")), strict=True)]
        h1, h2, doc = (np.concatenate([x[i] for x in columns]) for i in range(3))
        order = np.lexsort((doc, h2, h1))
        h1, h2, doc = h1[order], h2[order], doc[order]
        opens = np.concatenate(([True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])))
        least = doc[opens][np.cumsum(opens) - 1]
        late = doc > least
        h1, doc = h1[late], doc[late]
        part = _part_of(doc, parts)
        order = np.lexsort((h1, doc, part))
        part, h1, doc = part[order], h1[order], doc[order]
        cuts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True]))) if len(part) else np.zeros(1, np.int64)
        span = list(zip(cuts[:-1], cuts[1:], strict=True))
        return pa.table({"part": pa.array(part[cuts[:-1]], pa.int32()), "doc": pa.array([S.pack(doc[a:b]) for a, b in span], pa.binary()), "h1": pa.array([S.pack(h1[a:b]) for a, b in span], pa.binary())})

    late = proposed.groupBy("part").applyInArrow(decide, _BACK)

    # The same dealing as _part_of, so texts and the windows that come back meet.
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            part = _part_of(ids.fill_null(0).to_numpy(zero_copy_only=False), parts)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), ids, batch.column(1)], ["part", "id", "body"])

    dealt = src.mapInArrow(deal, "part int, id long, body string")

    def cut(texts: pa.Table, back: pa.Table) -> pa.Table:
        gone_doc = np.concatenate([np.zeros(0, np.int64), *(S.unpack(x, "int64") for x in back.column("doc").to_pylist())])
        gone_h1 = np.concatenate([np.zeros(0, np.uint64), *(S.unpack(x, "uint64") for x in back.column("h1").to_pylist())])
        order = np.argsort(gone_doc, kind="stable")
        gone_doc, gone_h1 = gone_doc[order], gone_h1[order]
        ids = texts.column("id").to_pylist()
        lo = np.searchsorted(gone_doc, [x or 0 for x in ids], "left")
        hi = np.searchsorted(gone_doc, [x or 0 for x in ids], "right")
        n_words, n_removed, digest, kept_text = [], [], [], []
        for words in scan_words(texts.column("body")):
            starts = words.row_start
            raw = words.data.tobytes()
            hashes, first = window_hashes(words, window)
            bounds = np.searchsorted(first, np.append(starts, words.row_end[-1] if words.n_rows else 0))
            for r in range(words.n_rows):
                i, a, b = words.first_row + r, int(starts[r]), int(words.row_end[r])
                keep = np.ones(b - a, bool)
                if ids[i] is not None and hi[i] > lo[i]:
                    at = slice(bounds[r], bounds[r + 1])
                    hit = first[at][np.isin(hashes[at], gone_h1[lo[i] : hi[i]])] - a
                    edge = np.zeros(b - a + 1, np.int64)
                    np.add.at(edge, hit, 1)
                    np.add.at(edge, hit + window, -1)
                    keep = np.cumsum(edge[:-1]) == 0
                spans = zip(words.start[a:b][keep].tolist(), words.end[a:b][keep].tolist(), strict=True)
                kept = b" ".join([raw[s:e] for s, e in spans])
                n_words.append(b - a)
                n_removed.append(int(b - a - keep.sum()))
                digest.append(hashlib.sha256(kept).hexdigest())
                kept_text.append(kept.decode("utf-8", "replace") if keep_text else None)
        return pa.table({"id": texts.column("id"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(digest, pa.string()), "text": pa.array(kept_text, pa.string())})

    out = dealt.groupBy("part").cogroup(late.groupBy("part")).applyInArrow(cut, "id long, n_words long, n_removed long, kept_sha256 string, text string")
    out = out.withColumnRenamed("id", id_col)
    return out if keep_text else out.drop("text")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query of operator 3 over all of ``documents``."""
    return remove_repeated_windows(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The same rows by brute force over exploded windows.
ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, unnest(range(1, greatest(len(w) - 11, 1))) AS p, w FROM d),
hashed AS (SELECT doc_id, p, array_to_string(w[p:p + 12], ' ') AS k FROM win),
least AS (SELECT k, min(doc_id) AS first_doc FROM hashed GROUP BY k),
gone AS (SELECT DISTINCT h.doc_id, h.p + o.o AS q FROM hashed h JOIN least l ON l.k = h.k AND h.doc_id > l.first_doc, (SELECT unnest(range(0, 13)) AS o) o),
by_doc AS (SELECT doc_id, list(q) AS qs FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(qs), 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN qs IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(qs, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN by_doc USING (doc_id)
"""
