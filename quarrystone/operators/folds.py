"""Ordered folds: state = step(state, row) over the rows of each key, in their order."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType


def rolling_fold(df: DataFrame, keys: Sequence[str], order: Sequence[str], step: Callable[[Any, dict], Any], schema: str, start: Callable[[], Any] = lambda: None, finish: Callable[[Any], dict] = lambda state: state) -> DataFrame:
    """One row of each key: its columns and what ``finish`` makes of the last state, named and typed by ``schema``.

    One exchange brings the rows of a key together in order and the fold streams over
    them, so a task holds a state and a batch of rows, however many rows a key has.  A
    lost task folds its own keys again.  ``step`` and ``finish`` should depend on nothing but
    their arguments.  Null keys are a key; rows of equal order come in any order.
    """
    kept = df.select(*keys, *(c for c in df.columns if c not in keys))
    told = StructType.fromDDL(schema)
    out = StructType([kept.schema[k] for k in keys] + told.fields)
    n = len(keys)
    arrow = kept.sparkSession.createDataFrame([], out).toArrow().schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, rows = None, None, []

        def taken() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_pylist(rows, arrow)
            rows.clear()
            return batch

        for batch in batches:
            for row in batch.to_pylist():
                key = tuple(row[k] for k in keys)
                if now is None or key != now:
                    if now is not None:
                        rows.append(dict(zip(keys, now, strict=True)) | finish(state))
                    now, state = key, start()
                state = step(state, row)
            if len(rows) >= 1000:
                yield taken()
        if now is not None:
            rows.append(dict(zip(keys, now, strict=True)) | finish(state))
        yield taken()

    assert n, "a fold needs a key"
    return kept.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, out)
