"""The corpus pipeline: five stages over ``documents``, each written and read again by its runner.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept.
All but the last return the columns of documents, in their order, and any others that
the rows have, whatever their names.

Defined results of all stages: an empty table gives an empty table; rows are never
dropped for a null in a column other than the text; very long texts are worked on whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.llm import bpe, jaccard_join, mixing, quality, secret_scan
from quarrystone.llm.tables import cut_lineage

#: The mixture of the pipeline: 80 % of the tokens that are left, each document at most once.
MIXTURE = mixing.Mixture(percent=80, max_epochs=1)

#: Workers live on into other stages, so what they remember of the encoding is kept small and dropped after each task.
MEMO_ENTRIES = 150_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects.

    Null and empty texts have too few words and go; repeated rows are judged alike.
    """
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id, of several with that id the one with the least text.

    Null ids come after all others; texts without words are groups of their own.
    """
    return jaccard_join.keep_one_per_component(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets masked, and ``n_chars`` as it is then.

    Null texts stay null and keep their number.
    """
    masked = secret_scan.mask_secrets(docs)
    kind = dict(docs.dtypes)["n_chars"]
    return masked.withColumn("n_chars", F.coalesce(F.char_length("text").cast(kind), F.col("n_chars")))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mixture selects.

    Null languages and sources are the node "unknown"; rows of equal id are taken or left together within their leaf; texts without words weigh nothing.
    """
    return mixing.select_mixture(docs, MIXTURE)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Numbers of tokens and digests of ids and decoded texts, a row for each document.

    Null texts count as empty.
    """
    return bpe.round_trip_digests(docs, bpe.default_vocabulary_path(), memo_entries=MEMO_ENTRIES, keep_encoder=False)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("mixture", mixture),
    ("encoding", encoding),
]

#: Token ids and component closure with masked texts aren't expressible in SQL as a whole; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's result written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
