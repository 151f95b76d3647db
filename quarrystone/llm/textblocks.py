"""Vectorised word scanning over Arrow text columns.

A word is a maximal run of bytes other than space and the ASCII controls
0x09-0x0D.  All of these delimiters are single bytes in UTF-8, so byte offsets
of words can be found without decoding, and all words of a run of rows are hashed
at once, eight bytes a round.  Runs hold about ``PIECE_BYTES``; a longer text is one run.

Defined results: a null text counts as empty and an empty text has no words.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 20

_U = np.uint64

_DELIMITER = np.zeros(256, dtype=bool)
_DELIMITER[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every input bit reaches every output bit."""
    x = np.asarray(x, dtype=np.uint64).copy()
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Longer words go through a cryptographic hash, one by one.
LONG_WORD = 64
_HASHED_AT_ONCE = 1 << 17
_ROUND = ((_U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)), (_U(0xC2B2AE3D27D4EB4F), _U(0xA0761D6478BD642F)))
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


@dataclass
class Words:
    """Words of a run of consecutive rows; offsets are bytes of ``data``."""

    first_row: int
    n_rows: int
    data: np.ndarray
    offsets: np.ndarray  # byte offset of each row, n_rows + 1 entries
    start: np.ndarray
    end: np.ndarray
    row_end: np.ndarray  # number of words up to the end of each row
    hash: np.ndarray
    lower: bool = False

    @functools.cached_property
    def second_hash(self) -> np.ndarray:
        """A hash of each word that has nothing to do with the first."""
        return _hash_spans(self.data, self.start, self.end, self.lower, 1)

    @property
    def row_start(self) -> np.ndarray:
        return np.concatenate(([0], self.row_end[:-1])).astype(np.int64)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.row_end, prepend=0)

    @property
    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_rows), self.counts)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a text column, nulls read as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    base = int(offs[0]) if len(offs) else 0
    return raw[base : int(offs[-1])] if len(offs) else raw[:0], offs - base


def _hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False, which: int = 0) -> np.ndarray:
    """64-bit hashes of byte spans: eight bytes a round, each mixed to all bits before the next comes in.

    Spans of one length up to eight bytes never collide; spans over ``LONG_WORD`` bytes are
    hashed cryptographically.  The two hashes that ``which`` names are independent.
    """
    body = np.concatenate((_LOWER[data] if lower else data, np.zeros(8, np.uint8)))
    blocks = np.ndarray((len(data) + 1,), "<u8", body.data, strides=(1,))
    keep, spread = _ROUND[which]
    out = np.empty(len(start), dtype=np.uint64)
    for i in range(0, len(start), _HASHED_AT_ONCE):
        at, left = start[i : i + _HASHED_AT_ONCE], (end - start)[i : i + _HASHED_AT_ONCE]
        h = out[i : i + _HASHED_AT_ONCE]
        h[:] = mix64(left.astype(np.uint64) * keep + spread)
        for k in np.flatnonzero(left > LONG_WORD).tolist():
            digest = hashlib.blake2b(body[at[k] : at[k] + left[k]].tobytes(), digest_size=8, salt=bytes([which])).digest()
            h[k] = int.from_bytes(digest, "little")
        live = np.flatnonzero((left > 0) & (left <= LONG_WORD))
        at, left = at[live], left[live]
        while len(live):
            h[live] = mix64(h[live] * keep + (blocks[at] & _KEEP[np.minimum(left, 8)]) * spread)
            on = left > 8
            live, at, left = live[on], at[on] + 8, left[on] - 8
    return out


def scan_words(column: pa.Array, lower: bool = False, delimiter: np.ndarray = _DELIMITER) -> Iterator[Words]:
    """Yield the words of a text column, a bounded number of rows at a time."""
    data, offsets = text_buffers(column)
    n, row = len(offsets) - 1, 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PIECE_BYTES, side="right")) - 1)
        lo, hi = int(offsets[row]), int(offsets[stop])
        piece, offs = data[lo:hi], offsets[row : stop + 1] - lo
        inside = ~delimiter[piece]
        opens = inside.copy()
        opens[1:] &= ~inside[:-1]
        breaks = offs[:-1][offs[:-1] < hi - lo]
        opens[breaks] = inside[breaks]
        start = np.flatnonzero(opens)
        closes = inside.copy()
        closes[:-1] &= ~inside[1:]
        tails = offs[1:][offs[1:] > 0] - 1
        closes[tails] = inside[tails]
        end = np.flatnonzero(closes) + 1
        yield Words(row, stop - row, piece, offs, start, end, np.searchsorted(start, offs[1:], side="left"), _hash_spans(piece, start, end, lower), lower)
        row = stop


def _constants(k: int, seed: int) -> np.ndarray:
    return mix64(np.arange(1, k + 1, dtype=np.uint64) + _U(seed << 32)) | _U(1)


def window_hashes(words: Words, k: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``k`` consecutive words of one row, and the index of each window's first word.

    Seed 1 takes the words' first hash, others take the second: windows equal in both have equal words but for chance.
    """
    total = len(words.hash)
    if total < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    valid = np.ones(total - k + 1, dtype=bool)
    for back in range(1, k):
        at = words.row_end - back
        at = at[(at >= words.row_start) & (at >= 0) & (at < len(valid))]
        valid[at] = False
    first = np.flatnonzero(valid)
    acc = np.zeros(len(first), dtype=np.uint64)
    of = words.hash if seed == 1 else words.second_hash
    for j, c in enumerate(_constants(k, seed)):
        acc += of[first + j] * c
    return mix64(acc), first


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each row: (row, hash, second hash), sorted by row then hash.

    A row with fewer than k words, but at least one, has its whole sequence as
    its only shingle; a row without words has none.
    """
    hashes, first = window_hashes(words, k)
    second = window_hashes(words, k, seed=2)[0]
    rows = np.searchsorted(words.row_end, first, side="right")
    short = np.flatnonzero((words.counts > 0) & (words.counts < k))
    if len(short):
        found = []
        for of in (words.hash, words.second_hash):
            acc = words.counts[short].astype(np.uint64)
            for j, c in enumerate(_constants(k, 99)):
                has = words.counts[short] > j
                acc[has] += of[words.row_start[short[has]] + j] * c
            found.append(mix64(acc))
        hashes, second, rows = np.concatenate([hashes, found[0]]), np.concatenate([second, found[1]]), np.concatenate([rows, short])
    order = np.lexsort((hashes, rows))
    hashes, second, rows = hashes[order], second[order], rows[order]
    keep = np.ones(len(rows), dtype=bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    return rows[keep], hashes[keep], second[keep]
