"""One passage, or one text, in every document: groups stay small in entries, not only in rows."""

import random

import numpy as np
import pytest

from quarrystone.llm import fingerprint, jaccard_join, quality, substring_dedup
from quarrystone.llm import sketches as S

PASSAGE = " ".join(f"common{i}" for i in range(60))


@pytest.fixture(scope="module")
def hot(spark):
    rows = [(i, f"{PASSAGE} " + " ".join(f"own{i}x{k}" for k in range(30))) for i in range(4000)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(8)


def test_substring_entries_of_a_hot_window(spark, hot):
    seen = []

    def inspect(messages):
        for r in messages.where("part >= 0").collect():
            seen.extend(S.unpack_sorted(r["h1"], "uint64").tolist())

    out = substring_dedup.remove_repeated_windows(hot, inspect=inspect)
    n = {r["n_removed"]: r["count"] for r in out.groupBy("n_removed").count().collect()}
    assert n == {0: 1, 60: 3999}
    _, times = np.unique(np.array(seen, np.uint64), return_counts=True)
    assert (times > 1).sum() == 48 and times.max() <= 8  # the others are chance; one for each task, not for each document


def test_long_lists_are_ranked_in_cuts(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(400):
        own = words[:]
        for k in rng.sample(range(120), rng.choice([0, 1, 2, 3])):
            own[k] = f"x{rng.random()}"
        rows.append((i, " ".join(own)))
    rows += [(1000 + i, "a plain text of its own " + " ".join(f"z{i}y{k}" for k in range(20))) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {(r["doc_id"], r["component_id"]) for r in jaccard_join.jaccard_components(df).collect()}
    got = {(r["doc_id"], r["component_id"]) for r in jaccard_join.jaccard_components(df, list_rows=20).collect()}
    assert got == want
    assert len({c for i, c in got if i < 1000}) < 200


def test_ranges_found_in_two_steps(spark):
    ids = spark.range(0, 40_000, 4).selectExpr("id * id id").repartition(5)
    one, two = fingerprint.range_starts(ids, 10_000, 60), fingerprint.range_starts(ids, 10_000, 60, most_cuts=8)
    assert one[0] == two[0] == 0 and 50 <= len(one) <= 60 and 50 <= len(two) <= 72
    of = np.searchsorted(two, np.arange(0, 40_000, 4, dtype=np.int64) ** 2, side="right")
    assert np.bincount(of)[1:].max() < 3 * 10_000 / 60
    assert len(fingerprint.range_starts(ids.limit(0), 0, 60)) == 0


def test_ranges_from_sampled_ids(spark):
    from pyspark.sql import functions as F

    ids = spark.range(0, 40_000, 4).selectExpr("id * id id").repartition(5)
    starts = fingerprint.range_starts(ids, 10_000, 40, sampled=1000)
    assert starts[0] == 0 and 30 <= len(starts) <= 40
    of = np.searchsorted(starts, np.arange(0, 40_000, 4, dtype=np.int64) ** 2, side="right")
    assert np.bincount(of)[1:].max() < 4 * 10_000 / 40
    # A third of the rows have one id, and of few ids none may be picked: no row is lost for it.
    hot = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("a text").alias("text"))
    few = fingerprint.range_starts(hot.selectExpr("doc_id id"), 3000, 30, most_cuts=4, sampled=1)
    assert few[0] == 1 and len(few) <= 30


def test_later_rules_are_not_computed(spark):
    from pyspark.sql import functions as F

    broken = quality.Rule("broken", ("n_words",), lambda m: F.raise_error(F.lit("computed")).cast("boolean"))
    few = quality.RULES[0]
    df = spark.createDataFrame([(1, "too few"), (2, None)], "doc_id long, text string")
    assert quality.keep_good(df, rules=[few, broken], ordered=[few, broken]).collect() == []
    got = quality.judge(df, rules=[few, broken], ordered=[few, broken]).collect()
    assert [r["kept"] for r in got] == [False, False]
    with pytest.raises(Exception, match="computed"):
        quality.keep_good(df, rules=[few, broken], ordered=[broken, few]).collect()


def test_rules_by_rejection_per_cost():
    cheap, dear, rare = (quality.RULES[i] for i in (0, 1, 5))
    # bit 0: cheap, 1: dear, 2: rare; the dear one rejects most, but hardly anything that the cheap one leaves
    seen = [(0b011, 50, 5000, 900, 50), (0b010, 1, 5000, 900, 50), (0b100, 9, 5000, 900, 50), (0, 40, 5000, 900, 50)]
    assert [r.name for r in quality._greedy(seen, [cheap, dear, rare])] == [cheap.name, rare.name, dear.name]
    assert quality._greedy([], [dear, cheap]) == [dear, cheap]
