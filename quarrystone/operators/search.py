"""Texts that contain items of a list, both tables of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 1000  # short items in a block
MOST_BROADCAST = 32 * 1024 * 1024  # bytes of short items that are sent to every task


def _words(c: Column | str) -> Column:
    return F.array_remove(F.split(c, r"[ \t\n]+"), "")


def containing(items: DataFrame, texts: DataFrame, item_id: str, text_id: str, item: str = "text", text: str = "text", block: int = BLOCK, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """(item_id, text_id) of every text that contains an item as it stands.

    A word with others on both sides in an item stands between the same white space
    wherever the item occurs, so an equi-join on such a word finds every occurrence, which is then
    compared.  Of these words an item takes the one that is in the fewest texts; an item with one that is in none has no occurrence.
    Items of fewer than three words have no such word: they meet the texts in blocks of
    at most about ``block``, which go to every task by broadcast while they have at most ``most_broadcast`` bytes, else
    every block meets every partition of the texts.  An empty item is in every
    text that isn't null; null items and texts are in no result, null ids are ids.
    """
    own = items.select(F.col(item_id).alias("i"), F.col(item).alias("item")).where("item is not null")
    docs = texts.select(F.col(text_id).alias("t"), F.col(text).alias("text")).where("text is not null")
    # Equal items are one until the end.
    distinct = own.select("item").distinct()
    inner = F.slice(_words("item"), F.lit(2), F.greatest(F.size(_words("item")) - 2, F.lit(1)))
    candidates = distinct.where(F.size(_words("item")) > 2).select("item", F.explode(F.array_distinct(inner)).alias("word"))
    in_texts = docs.select(F.explode(F.array_distinct(_words("text"))).alias("word")).join(candidates.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"))
    rarest = candidates.join(in_texts, "word", "left").groupBy("item").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word")).alias("r")).where("r.n > 0").select("item", F.col("r.word").alias("word"))
    # Only ids go with the words; an id may be null and is one like any other.
    met = docs.select("t", F.explode(F.array_distinct(_words("text"))).alias("word")).join(rarest, "word").select("t", "item")
    met = met.join(docs.withColumnRenamed("t", "of"), F.col("t").eqNullSafe(F.col("of"))).where(F.contains("text", F.col("item"))).select("item", "t")
    short = distinct.where(F.size(_words("item")) < 3)
    size = short.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("item")), F.lit(0)).alias("bytes")).first()
    found = met
    if size["n"]:
        blocks = short.groupBy(F.pmod(F.xxhash64("item"), F.lit(-(-size["n"] // block))).alias("block")).agg(F.collect_list("item").alias("listed")).select("listed")
        blocks = F.broadcast(blocks) if size["bytes"] + 16 * size["n"] <= most_broadcast else blocks.hint("shuffle_replicate_nl")
        held = F.filter("listed", lambda x: F.contains(F.col("text"), x))
        found = met.unionByName(docs.crossJoin(blocks).select(F.explode(held).alias("item"), "t"))
    return own.join(found, "item").select(F.col("i").alias(item_id), F.col("t").alias(text_id)).distinct()
