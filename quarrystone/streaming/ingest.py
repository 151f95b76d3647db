"""Structured Streaming: ingest of arriving files and windowed diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarrystone.sources import versions


def arriving(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of rows from Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def diagnostics(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and type; rows that come later than ``late`` are dropped."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def latest_by_key(events: DataFrame, keys: list[str], time: str, target: str, checkpoint: str) -> StreamingQuery:
    """Append each batch's newest row of every key; ``current`` reads the newest over all batches."""

    def add(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy(*keys).agg(F.max_by(F.struct(*batch.columns), time).alias("r")).select("r.*")
        newest.withColumn("batch", F.lit(number)).write.mode("append").partitionBy("batch").parquet(target)

    return events.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, target: str, keys: list[str], time: str, compacted: str | None = None) -> DataFrame:
    """The newest row of every key over all batches, of equal times that of the later batch.

    With ``compacted``, a table that ``compact`` keeps, only batches from its last one on are read beside it.
    """
    rows = _with_batches(spark, target, compacted)
    return _newest(rows, keys, time).drop("batch")


def compact(spark: SparkSession, target: str, keys: list[str], time: str, compacted: str) -> str:
    """Publish the newest row of every key as a version of its own, so that readers need few batches; gives the version.

    A reader sees this version or the one before, whole; batches stay where they are.
    """
    return versions.publish(_newest(_with_batches(spark, target, compacted), keys, time), compacted)


def _newest(rows: DataFrame, keys: list[str], time: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), F.struct(time, "batch")).alias("r")).select("r.*")


def _with_batches(spark: SparkSession, target: str, compacted: str | None) -> DataFrame:
    rows = spark.read.parquet(target)
    rows = rows.withColumn("batch", F.col("batch").cast("long"))
    base = versions.load(spark, compacted) if compacted else None
    last = base.agg(F.max("batch")).first()[0] if base is not None else None
    # The last batch is read again: rows of it that lost to older ones change nothing.
    return rows if last is None else base.unionByName(rows.where(F.col("batch") >= last))
