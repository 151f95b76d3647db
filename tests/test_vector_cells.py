import math
import random

from quarrystone.operators import vectors


def test_searches_in_cells_agree_with_a_plain_one(spark, monkeypatch):
    """Copies, ties by key, halves, infinite, short and missing vectors, in one cell and in many; what has no distance comes last."""
    random.seed(3)
    kinds = [[0.0, 0.0], [3.0, 4.0], [0.00005, 0.0], [0.00015, 0.0], [math.inf, 1.0], [1e200, 1.0], [1.0], [1.0, None], None]
    rows = [(i, random.choice(kinds), i % 3 if i % 7 else None) for i in range(120)]
    own = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    asked = own.where("vec_id % 6 = 0").withColumnRenamed("vec_id", "query_id")

    def place(a, b):
        if a is None or b is None or len(a) != len(b) or None in a or None in b:
            return 2, 0.0
        d = sum((x - y) * (x - y) for x, y in zip(a, b)) ** 0.5
        return (1, 0.0) if math.isnan(d) else (0, d if math.isinf(d) else math.floor(d * 1e4 + 0.5 + 1e-9) / 1e4)

    for within in (None, "label"):
        want = set()
        for q, a, of in rows:
            met = [(place(b, a), v) for v, b, l in rows if within is None or of is not None and l == of]
            want |= {(q, v, n + 1) for n, (_, v) in enumerate(sorted(met)[:5])} if q % 6 == 0 else set()
        for most in (2000, 7):
            monkeypatch.setattr(vectors, "MOST_QUERIES", most)
            monkeypatch.setattr(vectors, "MOST_ROWS", most * 3)
            assert {(r["query_id"], r["vec_id"], r["rank"]) for r in vectors.nearest_of_each(own, asked, 5, within=within).collect()} == want
