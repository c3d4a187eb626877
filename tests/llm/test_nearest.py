import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseline.llm import nearest

SCHEMA = "vec_id long, embedding array<float>, label int, code string"


def brute(rows, every, k):
    """rows: (id, vector or None)."""
    best = {}
    for i, v in rows:
        if i is None or not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        v = [float(np.float32(x)) for x in v]
        best[i] = min(best.get(i, v), v)
    found = []
    for q, a in best.items():
        if q % every:
            continue
        scored = []
        for i, b in best.items():
            if i != q and len(a) == len(b):
                dot = norm_a = norm_b = 0.0
                for x, y in zip(a, b):
                    dot, norm_a, norm_b = dot + x * y, norm_a + x * x, norm_b + y * y
                scored.append((-(dot / (math.sqrt(norm_a) * math.sqrt(norm_b))), i))
        found += [(q, n, i, -s) for n, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(found)


def run(spark, rows, every=5, k=5):
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], SCHEMA)
    return sorted(tuple(r) for r in nearest.neighbours(df, F.col("vec_id") % every == 0, k).collect())


def test_equals_brute_force_with_awkward_rows(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((40, 16)).round(1)
    rows = [(i, base[i].tolist()) for i in range(40)]
    rows += [(100 + i, base[3].tolist()) for i in range(12)]                    # a vector with many copies: ties
    rows += [(200, (base[3] * 2).tolist()), (201, (-base[3]).tolist())]
    rows += [(300, None), (305, []), (310, [0.0] * 16), (315, [float("nan")] + [1.0] * 15),
             (320, [float("inf")] + [1.0] * 15), (325, [None] + [1.0] * 15), (None, [1.0] * 16)]
    rows += [(5, base[5].tolist()), (400, [1.0, 0.0]), (405, [1.0, 1.0])]        # a repeated row, another dimension
    assert run(spark, rows) == brute(rows, 5, 5)


def test_few_candidates_and_none(spark):
    assert run(spark, []) == []
    assert run(spark, [(5, [1.0, 2.0])]) == []
    rows = [(5, [1.0, 2.0]), (6, [2.0, 1.0])]
    assert run(spark, rows) == brute(rows, 5, 5)


def test_many_units_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((300, 8)))]
    whole = run(spark, rows)
    monkeypatch.setattr(nearest, "BLOCK_ROWS", 32)
    monkeypatch.setattr(nearest, "CHUNK_QUERIES", 16)
    assert run(spark, rows) == whole == brute(rows, 5, 5)


@pytest.mark.parametrize("dim", [8, 64, 100])
def test_bounds_hold_the_inner_product(dim):
    rng = np.random.default_rng(dim)
    vectors, queries = rng.standard_normal((500, dim)), rng.standard_normal((40, dim))
    estimate, error = nearest.bounds(*nearest.encode(vectors), queries)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    truth = unit(queries) @ unit(vectors).T
    assert np.mean(np.abs(estimate - truth) <= error) > 0.99
    assert abs(np.mean(estimate - truth)) < 0.01
