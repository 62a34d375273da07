import numpy as np
import pytest
from pyspark.sql import functions as F

from kinesieve.llm import topk

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, every, k):
    sound = [(i, np.floor(256 * np.array(v, np.float32).astype(float))) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in {i: (i, v) for i, v in sound if i % every == 0}.values():
        scores = sorted({(-int(v @ c), i) for i, c in sound if i != q and len(c) == len(v)})[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize("shards", [10_000, 60])
def test_random(spark, shards):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(0, 0.2, 8).astype(np.float32).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(90)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = topk.top_k(df, F.col("vec_id") % 20 == 0, 5, shard_rows=shards, query_rows=16)
    assert sorted(map(tuple, got.collect())) == brute(rows, 20, 5)


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, []), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (None, [1.0, 2.0]), (6, [3.0, -1.0]), (7, [1.0, 2.0]), (8, [1.0, 2.0, 3.0]), (6, [3.0, -1.0])]
    got = topk.top_k(spark.createDataFrame([(*r, 9) for r in rows], SCHEMA + ", score int"), F.col("vec_id") % 2 == 0)
    assert sorted(map(tuple, got.collect())) == brute(rows, 2, 5)
    assert topk.top_k(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 2 == 0).collect() == []


def test_bounds_hold():
    rng = np.random.default_rng(3)
    tree = topk.BallTree(np.floor(rng.normal(0, 60, (3000, 16))), np.arange(3000), 5)
    queries = np.floor(rng.normal(0, 60, (20, 16)))
    norms = np.sqrt((queries**2).sum(1))
    for node, (i, j) in enumerate(tree.span):
        assert ((queries @ tree.points[tree.order[i:j]].T).max(1) <= tree.bounds(node, queries, norms)).all()


@pytest.mark.parametrize("times", [2, 10])
@pytest.mark.parametrize("shards", [100_000, 60])
def test_repeated_rows(spark, times, shards):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(0, 0.2, 8).astype(np.float32).tolist()) for i in range(200)]
    rows += [(1000 + i, rows[7][1]) for i in range(12)]
    df = spark.createDataFrame(rows * times, SCHEMA)
    got = topk.top_k(df, F.col("vec_id") % 20 == 0, 5, shard_rows=shards, query_rows=16)
    assert sorted(map(tuple, got.collect())) == brute(rows, 20, 5)


@pytest.mark.parametrize("shards", [100_000, 30])
def test_hot_id_with_equal_scores(spark, shards):
    # id 1 has 60 vectors that all score the same, and best, for the query
    rows = [(0, [1.0, 0.0]), *[(1, [3.0, float(i)]) for i in range(60)], *[(i, [2.0, float(i)]) for i in range(2, 30)]]
    got = topk.top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 0, 5, shard_rows=shards)
    assert sorted(map(tuple, got.collect())) == brute(rows, 100, 5)


def test_repeated_ids_of_a_point():
    points = np.array([[1.0, 2.0]] * 9)
    tree = topk.BallTree(points, np.array([4] * 6 + [5, 6, 7]), 3)
    assert [x.tolist() for x in tree.ids] == [[4, 5, 6, 7]]
