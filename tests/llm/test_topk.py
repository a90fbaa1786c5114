"""Exact top-k over the impact-ordered index."""

import random

import numpy as np
import pytest
from pagewright.llm.topk import ImpactIndex, quantised, top_k
from pyspark.sql import functions as F


def brute(rows, k):
    out = []
    for own, q in rows:
        if own is not None and own % 50 == 0:
            found = sorted((-sum(a * b for a, b in zip(q, v)), i) for i, v in rows if i is not None and i != own and len(v) == len(q))
            out += [(own, r + 1, i, -s) for r, (s, i) in enumerate(found[:k])]
    return out


@pytest.mark.parametrize("shard_rows", [7, 8192])
def test_against_brute_force(spark, shard_rows):
    rng = random.Random(6)
    rows = [(i, [rng.randint(-4, 4) for _ in range(6)]) for i in range(0, 400, 1)]
    rows += [(401, [0] * 6), (450, [0] * 6), (500, [1, 2]), (501, [3, 4]), (None, [9] * 6), (7, rows[7][1])]
    table = spark.createDataFrame([(i, v, 1.0) for i, v in rows], "vec_id long, vector array<long>, score double")
    got = [tuple(r) for r in top_k(table, shard_rows=shard_rows).collect()]
    assert sorted(got) == sorted(brute(rows, 5))


def test_unfit_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, -0.001]), (1, [nan, 1.0]), (2, [inf, 1.0]), (3, [None, 1.0]), (4, None), (5, [1.0, 1.0]), (6, [-inf, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, e array<float>")
    got = top_k(table.select("vec_id", quantised(F.col("e")).alias("vector"))).collect()
    assert [tuple(r) for r in got] == [(0, 1, 5, 128 * 256 - 256)]


def test_empty_and_alone(spark):
    schema = "vec_id long, vector array<long>"
    assert top_k(spark.createDataFrame([], schema)).count() == 0
    assert top_k(spark.createDataFrame([(50, [1])], schema)).count() == 0


def test_index_with_large_components_and_early_stops():
    rng = np.random.default_rng(2)
    for scale in (3, 120, 1 << 29):
        rows = rng.integers(-scale, scale, (3000, 16))
        ids = rng.permutation(3000)
        index = ImpactIndex(ids, rows)
        for _ in range(5):
            query = rng.integers(-scale, scale, 16) * (rng.random(16) < 0.5)
            own = int(rng.integers(0, 3000))
            score = rows @ query
            order = [i for i in np.lexsort((ids, -score)) if ids[i] != own][:5]
            found, points = index.top(own, query, 5)
            assert found.tolist() == ids[order].tolist() and points.tolist() == score[order].tolist()
