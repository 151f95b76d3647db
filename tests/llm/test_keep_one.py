from quarrystone.llm import jaccard_join

A, B, C = (" ".join(f"{x}{i}" for i in range(60)) for x in ("alpha", "beta", "gamma"))
SCHEMA = "text string, doc_id long, lang string"


def _kept(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    out = jaccard_join.keep_one_per_component(df)
    assert out.columns == df.columns
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in out.collect())


def test_rows_that_share_an_id(spark):
    # 1 stands for two different texts; 2 is alone with A, and near B; 3 is one of the near copies of B.
    rows = [(A, 1, "en"), (C, 1, "en"), (A + " more", 4, "en"), (B, 2, "en"), (B + " more", 3, "en"), (B + " more", 3, "en")]
    assert _kept(spark, rows) == sorted((False, i, t) for i, t in [(1, A), (1, C), (2, B)])


def test_an_id_in_two_components(spark):
    # 5 is kept for C only: of the group of A, 1 is the least.
    rows = [(A, 1, "en"), (A + " more", 5, "en"), (C, 5, "en")]
    assert _kept(spark, rows) == sorted((False, i, t) for i, t in [(1, A), (5, C)])


def test_rows_of_null_id(spark):
    rows = [(A, None, "en"), (A + " more", None, "en"), (B, 2, "en"), (B + " more", None, "en"), (C, None, "en"), ("", None, "en"), (None, 7, "en"), (None, 7, "en")]
    assert _kept(spark, rows) == sorted([(False, 2, B), (True, 0, A), (True, 0, C), (True, 0, ""), (False, 7, ""), (False, 7, "")])
