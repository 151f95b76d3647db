"""Chunking of texts: by boundary lines, by least lines, by sliding windows, and by the coarsest separators that fit."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sections(lines: DataFrame, boundary: Column, *keys: str) -> DataFrame:
    """Chunks that start at boundary lines; lines before the first one are chunk 0: (keys, chunk, start_line, end_line, text)."""
    order = Window.partitionBy(*keys).orderBy("line_no")
    numbered = lines.withColumn("chunk", F.sum(F.when(boundary, 1).otherwise(0)).over(order))
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    grouped = numbered.groupBy(*keys, "chunk").agg(F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"), ordered.alias("ls"))
    return grouped.select(*keys, "chunk", "start_line", "end_line", F.array_join(F.transform("ls", lambda x: x["text"]), "\n").alias("text"))


def at_least(chunks: DataFrame, lines_: int) -> DataFrame:
    return chunks.where(F.col("end_line") - F.col("start_line") + 1 >= lines_)


def or_whole(chunks: DataFrame, files: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Files without any chunk become one chunk."""
    rest = files.join(chunks.select(key).distinct(), key, "left_anti")
    whole = rest.select(key, F.lit(0).cast("long").alias("chunk"), F.lit(1).alias("start_line"), F.size(F.split(text, "\n")).alias("end_line"), F.col(text).alias("text"))
    return chunks.select(key, "chunk", "start_line", "end_line", "text").unionByName(whole)


def sliding(files: DataFrame, *keys: str, text: str = "text", size: int = 1000, overlap: int = 200) -> DataFrame:
    """Windows of ``size`` characters, each ``size - overlap`` after the one before: (keys, n, start, chunk)."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.char_length(text) - overlap - 1, F.lit(0)), F.lit(step))
    return files.select(*keys, F.posexplode(F.transform(starts, lambda s: F.struct(s.alias("start"), F.substr(F.col(text), s + 1, F.lit(size)).alias("chunk")))).alias("n", "c")).select(*keys, "n", "c.start", "c.chunk")


SEPARATORS = ("\n\n", "\n", " ", "")


def _pieces(text: str, separator: str) -> list[str]:
    """The text cut before each separator; single characters for the empty one."""
    if not separator:
        return list(text)
    first, *rest = text.split(separator)
    return [p for p in (first, *(separator + r for r in rest)) if p]


def _packed(pieces: Sequence[str], size: int, overlap: int) -> Iterator[str]:
    """Runs of pieces up to a size; a run starts with the last pieces of the one before, as far as the overlap and the size allow."""
    first, length = 0, 0
    for at, piece in enumerate(pieces):
        if length + len(piece) > size:
            if at > first:
                yield "".join(pieces[first:at])
            while length > overlap or (length and length + len(piece) > size):
                length -= len(pieces[first])
                first += 1
        length += len(piece)
    if first < len(pieces):
        yield "".join(pieces[first:])


def _split(text: str, separators: Sequence[str], size: int, overlap: int) -> Iterator[str]:
    at = next(i for i, s in enumerate(separators) if s in text)
    finer, short = separators[at + 1 :], []
    for piece in _pieces(text, separators[at]):
        if len(piece) < size:
            short.append(piece)
            continue
        yield from _packed(short, size, overlap)
        short = []
        if finer:
            yield from _split(piece, finer, size, overlap)
        else:
            yield piece
    yield from _packed(short, size, overlap)


def recursive(files: DataFrame, *keys: str, text: str = "text", size: int = 1000, overlap: int = 200) -> DataFrame:
    """Chunks of at most ``size`` characters cut at the coarsest separator that gives such: (keys, n, chunk).

    Paragraphs first, then lines, words and characters. Chunks are trimmed; null, empty
    and blank texts have none.
    """
    if size < 1 or not 0 <= overlap < size:
        raise ValueError("the overlap must be less than the size")

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [c for c in (r.strip() for r in _split(t, SEPARATORS, size, overlap)) if c] if t else [])

    return files.select(*keys, F.posexplode(cut(F.col(text))).alias("n", "chunk"))
