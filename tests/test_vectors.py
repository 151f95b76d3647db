from conftest import SF

from quarrystone.operators import vectors
from quarrystone.plans import catalogue, tables  # noqa: F401


def test_queries_in_more_than_one_block(spark, monkeypatch):
    own = spark.read.parquet(f"{SF}/embeddings.parquet")
    asked = own.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    whole = {tuple(r) for r in vectors.nearest_of_each(own, asked, 3).collect()}
    assert len(whole) == 3 * asked.count()
    monkeypatch.setattr(vectors, "MOST_QUERIES", 4)
    assert {tuple(r) for r in vectors.nearest_of_each(own, asked, 3).collect()} == whole


def test_search_at_every_twentieth_row(spark):
    got = catalogue.QUERIES["vector_topk_each"](spark, SF).collect()
    ids = [r["vec_id"] for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert {r["query_id"] for r in got} == {i for i in ids if i % 20 == 0}


def test_search_in_an_empty_table(spark, tmp_path):
    spark.read.parquet(f"{SF}/embeddings.parquet").limit(0).write.parquet(f"{tmp_path}/embeddings.parquet")
    for name in ("vector_topk", "vector_topk_each"):
        assert catalogue.QUERIES[name](spark, str(tmp_path)).collect() == []
