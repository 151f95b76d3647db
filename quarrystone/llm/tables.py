"""Small table helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def two_columns(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, null texts read as empty; other columns can't clash with what an operator adds."""
    return df.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias(text_col))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a table to the shared checkpoint folder and read it back.

    What came before isn't needed any more, so a lost executor costs nothing that
    is written; and the table's size is known, so joins with it are planned on
    that.  The folder is the one the session names in ``spark.checkpoint.dir``.
    Only where that is unset on a single machine, as in tests, a folder of this machine
    is set; on a cluster that is an error.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    path = f"{context.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
