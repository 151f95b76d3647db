"""The pipeline's stages on odd rows: nulls, repeated ids, clashing names, empty tables, long texts."""

import corpus_pipeline as P



def _words(n, head):
    """Different words of letters."""
    return " ".join(head + "".join(chr(97 + i // 26**k % 26) for k in range(4)) for i in range(n))


PROSE, LONG, THIRD = _words(80, "w"), _words(120_000, "t"), _words(70, "third")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id int, body string, part int, node string, g int, epochs int"
ROWS = [
    (1, PROSE, "en", "src1", 1, 1, "x", 1, "n", 1, 1),
    (1, PROSE, "en", "src1", 1, 1, "x", 1, "n", 1, 1),
    (2, PROSE + " token=abcdefghijklmnop", None, None, None, None, None, None, None, None, None),
    (3, None, "en", "src1", 7, 2, "x", 1, "n", 1, 1),
    (4, "", "en", "src1", 0, 2, "x", 1, "n", 1, 1),
    (None, LONG, "de", "src2", 1, 2, "x", 1, "n", 1, 1),
    (5, "other " + LONG[: len(LONG) // 2], "de", "src2", 1, 2, "x", 1, "n", 1, 1),
    (5, THIRD, "de", "src2", 1, 2, "x", 1, "n", 1, 1),
]


def test_stages_on_odd_rows(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    kept = P.quality_rules(spark, docs, "")
    assert kept.columns == docs.columns and sorted((r["doc_id"] or 0, len(r["text"])) for r in kept.collect()) == sorted((r[0] or 0, len(r[1])) for r in ROWS if r[1])
    single = P.near_duplicates(spark, docs, "")
    assert single.columns == docs.columns
    assert sorted((r["doc_id"] or 0, (r["text"] or "")[:6]) for r in single.collect()) == sorted([(1, PROSE[:6]), (3, ""), (4, ""), (0, LONG[:6]), (5, "other "), (5, "thirda")])
    masked = P.secrets(spark, docs, "")
    assert masked.columns == docs.columns and masked.dtypes == docs.dtypes
    got = {(r["doc_id"], r["n_chars"]): r["text"] for r in masked.collect()}
    assert got[2, len(PROSE) + 15] == PROSE + " token=[SECRET]" and got[3, 7] is None and got[4, 0] == ""
    mixed = P.mixture(spark, docs, "")
    assert mixed.columns == docs.columns and 0 < mixed.count() <= len(ROWS)
    assert P.encoding(spark, docs, "").count() == len(ROWS)


def test_stages_on_an_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in P.STAGES:
        assert stage(spark, docs, "").collect() == []
