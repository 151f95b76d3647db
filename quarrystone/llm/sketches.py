"""Counting sketches built per partition and merged by blocks of slots.

A sketch has ``depth`` rows of ``width`` slots.  A partition sends, for each
block of slots, the slots it hit and how often, as compressed gaps; a group per
block adds them up.  No task and no message ever holds a whole unmerged sketch,
and what is broadcast in the end has a size that is a parameter: ``width`` grows
with the corpus up to a stated cap.  Past the cap estimates only get larger,
never smaller, so a filter built on them loses nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from quarrystone.llm.textblocks import mix64

_U = np.uint64


def pack(a: np.ndarray) -> bytes:
    """Compress an array; the bytes of equal significance lie together."""
    if len(a) == 0:
        return b""
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(b: bytes, dtype: str) -> np.ndarray:
    if not b:
        return np.zeros(0, dtype)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(dtype)


def pack_sorted(a: np.ndarray) -> bytes:
    """Compress ascending unsigned numbers by their gaps."""
    gaps = np.diff(a, prepend=a.dtype.type(0))
    narrow = np.uint16 if len(gaps) and int(gaps.max()) < 1 << 16 else a.dtype
    return (b"n" if narrow == np.uint16 else b"w") + pack(gaps.astype(narrow))


def unpack_sorted(b: bytes, dtype: str) -> np.ndarray:
    if len(b) < 2:
        return np.zeros(0, dtype)
    return np.cumsum(unpack(b[1:], "uint16" if b[:1] == b"n" else dtype).astype(dtype), dtype=dtype)


def width_for(windows: int, slots_per_window: float, cap_bits: int, least_bits: int = 16) -> int:
    """Smallest power of two with so many slots a window, up to the cap."""
    bits = max(least_bits, int(np.ceil(np.log2(max(1, windows) * slots_per_window))))
    return 1 << min(bits, cap_bits)


def slots_of(hashes: np.ndarray, width: int, row: int) -> np.ndarray:
    return (hashes if row == 0 else mix64(hashes ^ _U(0xA5A5_0000 + row))) & _U(width - 1)


class PartitionSketch:
    """Counts of one partition, sent by blocks."""

    SCHEMA = pa.schema([("block", pa.int32()), ("slots", pa.binary()), ("counts", pa.binary())])

    def __init__(self, width: int, depth: int, blocks: int) -> None:
        self.width, self.depth, self.blocks = width, depth, blocks
        self.held: list[np.ndarray] = []
        self.n = 0

    def add(self, hashes: np.ndarray) -> None:
        self.held.append(hashes)
        self.n += len(hashes)

    def full(self, limit: int = 6_000_000) -> bool:
        return self.n >= limit

    def drain(self) -> dict[str, list]:
        """What has been counted since the last call: columns block, slots, counts."""
        out: dict[str, list] = {"block": [], "slots": [], "counts": []}
        if not self.n:
            return out
        hashes = np.concatenate(self.held)
        self.held, self.n = [], 0
        span = self.width // self.blocks
        for row in range(self.depth):
            slots = slots_of(hashes, self.width, row).astype(np.uint32)
            slots.sort()
            first = np.flatnonzero(np.concatenate(([True], slots[1:] != slots[:-1])))
            counts = np.minimum(np.diff(np.append(first, len(slots))), 65535).astype(np.uint16)
            slots = slots[first]
            cuts = np.searchsorted(slots, np.arange(self.blocks + 1, dtype=np.uint64) * _U(span))
            for b in np.flatnonzero(np.diff(cuts)):
                s = slots[cuts[b] : cuts[b + 1]] - np.uint32(b * span)
                out["block"].append(row * self.blocks + int(b))
                out["slots"].append(pack_sorted(s))
                out["counts"].append(pack(counts[cuts[b] : cuts[b + 1]]))
        return out


def added(table: pa.Table, span: int) -> np.ndarray:
    """The sum of the messages for one block."""
    total = np.zeros(span, np.int64)
    for slots, counts in zip(table.column("slots").to_pylist(), table.column("counts").to_pylist(), strict=True):
        total[unpack_sorted(slots, "uint32")] += unpack(counts, "uint16")
    return total


def merge(partials: DataFrame, width: int, blocks: int, level) -> DataFrame:
    """Add up partial sketches by block and apply ``level`` to the counts of a block: (block, packed binary)."""
    span = width // blocks

    def run(key: tuple, table: pa.Table) -> pa.Table:
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "packed": pa.array([level(added(table, span))], pa.binary())})

    return partials.select("block", "slots", "counts").groupBy("block").applyInArrow(run, "block int, packed binary")


def gather(merged: DataFrame, blocks: int, depth: int, size: int) -> np.ndarray:
    """The merged sketch, one row of bytes for each of its rows; ``size`` bytes a block, bounded by the width's cap."""
    out = np.zeros((depth, blocks * size), np.uint8)
    for block, packed in merged.collect():
        out[block // blocks, (block % blocks) * size : (block % blocks + 1) * size] = np.frombuffer(packed, np.uint8)
    return out


def at_least_two(total: np.ndarray) -> bytes:
    """One bit a slot: hit twice or more."""
    return np.packbits(total >= 2, bitorder="little").tobytes()


def repeated(bits: np.ndarray, width: int, hashes: np.ndarray) -> np.ndarray:
    """Indices of the hashes whose slots have their bit in every row; all that were counted twice are among them."""
    keep = np.arange(len(hashes))
    for row in range(len(bits)):
        slots = slots_of(hashes[keep], width, row)
        keep = keep[(bits[row][(slots >> _U(3)).astype(np.int64)] >> (slots & _U(7)).astype(np.uint8)) & 1 == 1]
    return keep
