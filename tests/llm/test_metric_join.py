"""The metric range join against all pairs, with cells and blocks small enough that every path is taken."""

import math

import numpy as np
import pytest

from quarrystone.llm import metric_join as M

SCHEMA = "vec_id long, embedding array<double>, label int, node string, links string"


def brute(rows):
    ok = [i for i, r in enumerate(rows) if r[1] and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])]
    near = {i: set() for i in range(len(rows))}
    for i in ok:
        for j in ok:
            if i < j and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                x, y = (np.array(rows[k][1], float) / max(map(abs, rows[k][1])) for k in (i, j))
                if math.fsum(x * y) / (math.sqrt(math.fsum(x * x)) * math.sqrt(math.fsum(y * y))) >= 0.93:
                    near[i].add(j)
                    near[j].add(i)
    out = []
    for i, r in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((r[0], len(near[i]), least, r[0] is not None and r[0] == least))
    return sorted(out, key=str)


def made(n=700, dim=12, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    centres = rng.normal(size=(12, dim))
    for i in range(n):
        c = centres[0] if i % 3 == 0 else centres[rng.integers(12)] if i % 3 == 1 else rng.normal(size=dim)
        v = c / np.linalg.norm(c) + rng.normal(size=dim) * rng.choice([0.0, 0.03, 0.08, 0.12])
        rows.append((i, (v * rng.choice([1e-3, 1.0, 50.0])).tolist(), int(rng.integers(2)) if i % 50 else 0))
    return rows


ODD = [
    (9001, None, 1), (9002, [], 1), (9003, [0.0] * 12, 1), (9004, [None] + [1.0] * 11, 1), (9005, [float("nan")] * 12, 1), (9006, [float("inf")] * 12, 1),
    (9007, [1.0] * 12, None), (9008, [1.0] * 12, None), (9010, [1.0, 2.0], 1), (9011, [2.0, 4.0], 1), (9012, [1e200, 1e200], 1), (9013, [-0.0, 1.0], 5), (9014, [0.0, 1.0], 5),
    (9020, [5.0] * 12, 7), (9020, [5.0] * 12, 7), (None, [5.1] * 12, 7), (None, [1.0, -1.0], 8), (None, [1.0, -1.0], 8),
]


@pytest.mark.parametrize(("cell", "block"), [(60, 25), (4096, 4096), (4096, 40)])
def test_all_pairs(spark, cell, block):
    rows = made() + ODD
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(5)
    got = M.embedding_components(df, cell=cell, block_rows=block).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_floats_and_empty(spark):
    rows = made(150, 5, 3)
    rows = [(i, np.array(v, np.float32).tolist(), label) for i, v, label in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert sorted((tuple(r) for r in M.embedding_components(df, cell=30, block_rows=64).collect()), key=str) == brute(rows)
    none = M.embedding_components(df.where("false"))
    assert none.columns == ["vec_id", "n_links", "component_id", "kept"] and none.collect() == []


def test_tight_group_is_counted_not_compared(spark):
    """Half the rows in one tight group: its members are cores of their cell and don't meet in blocks."""
    rng = np.random.default_rng(7)
    centre = rng.normal(size=16)
    rows = [(i, (centre + rng.normal(size=16) * 0.02 if i % 2 else rng.normal(size=16)).tolist(), 0) for i in range(1200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    nodes = M._with_nodes(df, "vec_id", "embedding", "label", True).groupBy("label", "dim", "node").agg({"id": "min", "vec": "first"}).toDF("label", "dim", "node", "vec", "least").selectExpr("label", "dim", "node", "least", "1L weight", "vec")
    cells = M._pivots(nodes, M.COSINE, 200)
    kinds = M._places(nodes, cells, M.COSINE, guests=False, vectors=False).groupBy("kind").count().collect()
    assert {r["kind"]: r["count"] for r in kinds}[M._CORE] >= 600
    got = M.embedding_components(df, cell=200, block_rows=100).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_pivots_are_apart():
    rng = np.random.default_rng(2)
    unit = M._unit(np.concatenate([rng.normal(size=(40, 8)), np.ones((40, 8)) + rng.normal(size=(40, 8)) * 0.01]))
    taken = M.separated(unit, 30, M.COSINE)
    close = taken @ taken.T - 2 * np.eye(len(taken))
    assert len(taken) == 30 and close.max() < M.COSINE


def test_exact_at_the_threshold():
    x = np.array([[1.0, 0.0]])
    y = np.array([[0.93, math.sqrt(1 - 0.93**2)], [0.93 - 1e-15, math.sqrt(1 - (0.93 - 1e-15) ** 2)]])
    assert M._linked(x, y, M.COSINE).tolist() == [[y[0, 0] / math.sqrt(math.fsum(y[0] * y[0])) >= 0.93, False]]
