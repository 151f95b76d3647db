"""Words that collide under polynomials modulo a power of two, and rows dealt to groups."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest

from quarrystone.llm import jaccard_join, substring_dedup
from quarrystone.llm.textblocks import LONG_WORD, _hash_spans, scan_words


def thue_morse(n, a, b):
    return "".join((a, b)[i.bit_count() & 1] for i in range(n)), "".join((b, a)[i.bit_count() & 1] for i in range(n))


@pytest.mark.parametrize("n", [16, 32, 64, 128, 1024, 2048])
def test_words_do_not_collide(n):
    for a, b in (("a", "b"), ("x", "Q"), ("ab", "ba")):
        x, y = thue_morse(n, a, b)
        words = next(scan_words(pa.array([f"{x} {y} {x}"])))
        for h in (words.hash, words.second_hash):
            assert h[0] == h[2] != h[1]


def test_hashes_by_length_and_case():
    words = ["a" * k for k in range(1, 200)] + ["a" * k + "B" for k in range(100)] + ["\0" * k for k in range(1, 80)] + [f"{i:05d}x{i * 7919 % 10007}" for i in range(20_000)]
    text = " ".join(words)
    got = next(scan_words(pa.array([text])))
    assert len(set(got.hash.tolist())) == len(set(got.second_hash.tolist())) == len(set(words))
    assert len(set(got.hash.tolist()) & set(got.second_hash.tolist())) == 0
    low = next(scan_words(pa.array([text.upper()]), lower=True))
    plain = next(scan_words(pa.array([text.lower()])))
    assert (low.hash == plain.hash).all() and (low.second_hash == plain.second_hash).all()
    data = np.frombuffer(text.encode(), np.uint8)  # wherever a span lies, its hash is the same
    for length in (3, 8, 9, LONG_WORD, LONG_WORD + 1):
        at = np.array([0, 1, len(data) - length])
        one = [_hash_spans(data[a : a + length], np.array([0]), np.array([length]))[0] for a in at]
        assert _hash_spans(data, at, at + length).tolist() == one


@pytest.mark.parametrize("n", [1024, 2048])
def test_operators_keep_such_words_apart(spark, n):
    x, y = thue_morse(n, "a", "b")
    shared = " ".join(f"w{i}" for i in range(12))
    df = spark.createDataFrame([(1, f"{shared} {x} tail one"), (2, f"{shared} {y} tail two"), (3, f"{shared} {x} other")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_removed"], r["kept_sha256"]) for r in substring_dedup.remove_repeated_windows(df).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == {1: (0, sha(f"{shared} {x} tail one")), 2: (0, sha(f"{shared} {y} tail two")), 3: (13, sha("other"))}
    single = spark.createDataFrame([(1, x), (2, y), (3, x.upper()), (4, f"{x} {y}"), (5, f"{y} {x}")], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(single).collect()} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}


def test_rows_of_documents_are_dealt_by_hash(spark):
    """One row a batch, copies and rows without an id among them: every group gets about its share."""
    first = np.full(4000, 77, np.uint64)
    one_by_one = np.concatenate([jaccard_join._group_of(first[:1], pa.array([i], pa.int64()), i, 16) for i in range(4000)])
    assert (one_by_one == jaccard_join._group_of(first, pa.array(range(4000), pa.int64()), 0, 16)).all()
    for groups in (one_by_one, jaccard_join._group_of(first, pa.nulls(4000, pa.int64()), 0, 16)):
        assert np.bincount(groups, minlength=16).max() < 2 * 4000 / 16 and np.bincount(groups, minlength=16).min() > 100
    df = spark.createDataFrame([(i if i % 5 else None, f"text number {i % 200}") for i in range(600)], "doc_id long, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        assert jaccard_join.jaccard_components(df).count() == 600
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
