"""Fill-in-middle by secondary-sort assembly (operator 12).

Every text is cut into pieces of whole lines, none of them over ``PIECE_BYTES``,
keyed by document and by position in the output.  One exchange brings a document's
pieces to one partition and sorts them there by that position:
``repartition`` with ``sortWithinPartitions``, the DataFrame form of
``repartitionAndSortWithinPartitions``, whose sorter spills.  The sorted pieces
stream through an incremental digest; a task holds one piece, never a document.
For restoration the pieces of the output get their place in the text from the
sentinels that begin them, are sorted again within the partition, without another
exchange, and stream through a second digest.

Pieces travel compressed.  A document is known by its id and a digest of its text,
so a task that is run again sends the same keys.

Defined results: null texts count as empty; a null id counts as the empty string in
the seed; rows of equal id and text are assembled once and returned as often as they
came, others of equal id stay apart; texts that hold a sentinel stay plain; a line
longer than a piece is cut; an empty table gives an empty table; other columns aren't looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.llm.tables import two_columns
from quarrystone.llm.textblocks import text_buffers

PIECE_BYTES = 32_768
FLUSH_BYTES = 4_000_000

PREFIX, MIDDLE, SUFFIX = b"<P>", b"<M>", b"<S>"
SEED = "7"

#: Order of the parts in the output of a form; a plain text is one part without a sentinel.
ORDER = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
#: Order of the parts in the text.
PLACE = {PREFIX: 0, MIDDLE: 1, SUFFIX: 2}

_HEAD = "id long, key binary, pos long, n long, form string, prefix_chars long, middle_chars long"


@dataclass(frozen=True)
class Rates:
    """Of 100 documents so many are transformed, and of 100 of these so many take the suffix first."""

    transformed: int = 100
    suffix_first: int = 50


def _draws(doc_id: int | None) -> list[int]:
    digest = hashlib.sha256(f"{SEED}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]


def _chunks(at: int, end: int, line_ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of whole lines of at most PIECE_BYTES; an empty part is one empty run."""
    while end - at > PIECE_BYTES:
        i = int(np.searchsorted(line_ends, at + PIECE_BYTES, side="right")) - 1
        to = int(line_ends[i]) if i >= 0 and line_ends[i] > at else at + PIECE_BYTES
        yield at, to
        at = to
    yield at, end


class _Rows:
    """Rows of a result, handed on when they have grown to FLUSH_BYTES."""

    def __init__(self, schema: list[tuple[str, pa.DataType]]) -> None:
        self.schema, self.columns, self.size = pa.schema(schema), [[] for _ in schema], 0

    def add(self, *values, size: int = 200) -> None:
        for column, value in zip(self.columns, values, strict=True):
            column.append(value)
        self.size += size

    def full(self) -> bool:
        return self.size >= FLUSH_BYTES

    def take(self) -> pa.RecordBatch:
        arrays = [pa.array(c, f.type) for c, f in zip(self.columns, self.schema, strict=True)]
        self.columns, self.size = [[] for _ in self.schema], 0
        return pa.RecordBatch.from_arrays(arrays, schema=self.schema)


_L, _B, _S = pa.int64(), pa.binary(), pa.string()
_PIECE = [("id", _L), ("key", _B), ("pos", _L), ("n", _L), ("form", _S), ("prefix_chars", _L), ("middle_chars", _L), ("data", _B)]


def output_pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rates: Rates = Rates()) -> DataFrame:  # noqa: B008
    """(id, key, pos, n, form, prefix_chars, middle_chars, data): the pieces of the outputs; what is known of a document stands with its first piece."""
    src = two_columns(df.withColumn(id_col, F.col(id_col).cast("long")), id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        out = _Rows(_PIECE)
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            lines = np.flatnonzero(data == 10) + 1
            first = np.searchsorted(lines, offsets, side="right")
            for row, doc_id in enumerate(batch.column(0).to_pylist()):
                lo, hi = int(offsets[row]), int(offsets[row + 1])
                raw, ends = data[lo:hi].tobytes(), lines[first[row] : first[row + 1]] - lo
                n = len(ends) + (hi > lo and raw[-1] != 10)
                h = _draws(doc_id)
                key = hashlib.blake2b(raw, digest_size=16).digest()
                if not raw or PREFIX in raw or SUFFIX in raw or MIDDLE in raw or h[2] % 100 >= rates.transformed:
                    form, chars, parts = "plain", (None, None), [(b"", 0, len(raw))]
                else:
                    a, b = (0 if not k else int(ends[k - 1]) if k <= len(ends) else len(raw) for k in sorted((h[0] % (n + 1), h[1] % (n + 1))))
                    form = "spm" if h[3] % 100 < rates.suffix_first else "psm"
                    of = {PREFIX: (0, a), MIDDLE: (a, b), SUFFIX: (b, len(raw))}
                    chars = tuple(int(np.count_nonzero((data[lo + x : lo + y] & 0xC0) != 0x80)) for x, y in (of[PREFIX], of[MIDDLE]))
                    parts = [(mark, *of[mark]) for mark in ORDER[form]]
                pos = 0
                for mark, x, y in parts:
                    for s, e in _chunks(x, y, ends):
                        piece = pack((mark if s == x else b"") + raw[s:e])
                        out.add(doc_id, key, pos, *((None,) * 4 if pos else (n, form, *chars)), piece, size=len(piece) + 60)
                        pos += 1
                if out.full():
                    yield out.take()
        yield out.take()

    return src.mapInArrow(run, _HEAD + ", data binary")


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True)


def assembled(pieces: DataFrame, keep_text: bool = False) -> DataFrame:
    """The outputs: pieces sorted into their documents' partitions, streamed into digests.

    A row of each document comes first (``pos`` -1, with its digest, with how many rows are
    equal to it and, with ``keep_text``, with the output); after it its pieces, each with its place in the text as ``pos``.
    """
    dealt = pieces.repartition("id", "key").sortWithinPartitions("id", "key", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        out = _Rows([*_PIECE, ("digest", _S), ("copies", _L), ("output", _S)])
        doc, digest, text, head, copies, last, place = None, None, [], None, 0, -1, 0

        def ended() -> None:
            out.add(*doc, -1, *head, None, digest.hexdigest(), copies, b"".join(text).decode() if keep_text else None)

        for doc_id, key, pos, n, form, prefix_chars, middle_chars, data in _streamed(batches):
            if (doc_id, key) != doc or digest is None:
                if digest is not None:
                    ended()
                doc, digest, text, head, copies, last, place = (doc_id, key), hashlib.sha256(), [], (n, form, prefix_chars, middle_chars), 0, -1, 0
            copies += pos == 0
            if pos == last:  # a row of equal id and text
                continue
            last, piece = pos, unpack(data)
            digest.update(piece)
            if keep_text:
                text.append(piece)
            if head[1] != "plain" and piece[:3] in PLACE:
                place = PLACE[piece[:3]] << 40
            out.add(doc_id, key, place, None, head[1], None, None, data, None, None, None, size=len(data) + 60)
            place += 1
            if out.full():
                yield out.take()
        if digest is not None:
            ended()
        yield out.take()

    return dealt.mapInArrow(run, _HEAD + ", data binary, digest string, copies long, output string")


def restored(outputs: DataFrame) -> DataFrame:
    """A row of each document with the digests of its output and of the text rebuilt from the output's pieces."""
    again = outputs.sortWithinPartitions("id", "key", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        out = _Rows([("id", _L), ("n", _L), ("form", _S), ("prefix_chars", _L), ("middle_chars", _L), ("output_sha256", _S), ("restored_sha256", _S), ("output", _S)])
        head, digest = None, hashlib.sha256()

        def ended() -> None:
            for _ in range(head[6]):
                out.add(*head[:6], digest.hexdigest(), head[7])

        for doc_id, _, pos, n, form, prefix_chars, middle_chars, data, output_digest, copies, output in _streamed(batches):
            if pos < 0:
                if head is not None:
                    ended()
                head, digest = (doc_id, n, form, prefix_chars, middle_chars, output_digest, copies, output), hashlib.sha256()
                if out.full():
                    yield out.take()
                continue
            piece = unpack(data)
            digest.update(piece[3:] if form != "plain" and piece[:3] in PLACE else piece)
        if head is not None:
            ended()
        yield out.take()

    return again.mapInArrow(run, "id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string, output string")


def fill_in_middle(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rates: Rates = Rates(), keep_text: bool = False) -> DataFrame:  # noqa: B008
    """A row of each document: (id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) and, with ``keep_text``, ``output``."""
    out = restored(assembled(output_pieces(df, id_col, text_col, rates), keep_text)).withColumnRenamed("id", id_col)
    return out if keep_text else out.drop("output")


def restore_text(output: str, form: str) -> str:
    """The text of one output."""
    if form == "plain":
        return output
    marks = [m.decode() for m in ORDER[form]]
    at = [output.index(m) for m in marks]
    parts = {m: output[a + 3 : b] for m, a, b in zip(marks, at, [*at[1:], len(output)], strict=True)}
    return "".join(parts[m.decode()] for m in sorted(PLACE, key=PLACE.__getitem__))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query of operator 12 over all of ``documents``."""
    return fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u FROM documents),
g AS (SELECT *, len(u) AS n, [('0x' || h[1:8])::BIGINT, ('0x' || h[9:16])::BIGINT, ('0x' || h[17:24])::BIGINT, ('0x' || h[25:32])::BIGINT] AS k FROM t),
c AS (
  SELECT *, least(k[1] % (n + 1), k[2] % (n + 1)) AS a, greatest(k[1] % (n + 1), k[2] % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR k[3] % 100 >= 100 THEN 'plain' WHEN k[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM g),
p AS (SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
