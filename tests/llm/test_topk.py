from __future__ import annotations

import numpy as np
import pytest

from codeloom.llm import topk as k

from .helpers import rows

SCHEMA = "vec_id long, embedding array<float>"


def brute(data, n):
    ids = np.array([i for i, _ in data])
    x = np.array([v for _, v in data], np.float32).astype(float)
    scores = np.round(x @ x.T, k.DIGITS)
    out = []
    for i in range(len(ids)):
        best = [j for j in np.lexsort((ids, -scores[i])) if j != i][:n]
        out += [(int(ids[i]), r, int(ids[j]), float(scores[i, j])) for r, j in enumerate(best, 1)]
    return sorted(out)


def clusters(seed, n, dim=12, spread=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, dim))
    x = centres[rng.integers(0, 8, n)] + rng.normal(size=(n, dim)) * spread
    return [(int(i) * 3, [float(np.float32(v)) for v in row]) for i, row in enumerate(x)]


@pytest.mark.parametrize(("n", "shard", "top"), [(700, 8192, 10), (700, 60, 10), (900, 37, 3), (30, 7, 50)])
def test_agrees_with_all_scores(spark, n, shard, top):
    data = clusters(n, n)
    got = sorted(tuple(r) for r in k.top_k(spark.createDataFrame(data, SCHEMA), k=top, shard_rows=shard).collect())
    want = brute(data, top)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert np.allclose([r[3] for r in got], [r[3] for r in want], atol=2e-9)


def test_ties_go_to_the_least_id(spark):
    data = [(i, [1.0, float(i % 2)]) for i in range(60)]
    for shard in (8192, 10):
        got = sorted(tuple(r) for r in k.top_k(spark.createDataFrame(data, SCHEMA), k=5, shard_rows=shard).collect())
        assert got == brute(data, 5)


def test_rows_that_do_not_count(spark):
    good = clusters(1, 40, 4)
    bad = [(None, [1.0] * 4), (500, None), (501, []), (502, [1.0, float("nan"), 0.0, 0.0]), (503, [float("inf")] * 4), (504, [1.0, None, 1.0, 1.0]), (505, [9.0] * 5), good[3], good[3]]
    df = spark.createDataFrame(good + bad, SCHEMA).selectExpr("*", "'q' AS shard", "'q' AS score", "'q' AS v", "'q' AS ids")
    assert sorted(r[:3] for r in rows(k.top_k(df, k=4))) == [r[:3] for r in brute(good, 4)]


def test_few_rows(spark):
    assert k.top_k(spark.createDataFrame([], SCHEMA)).count() == 0
    assert k.top_k(spark.createDataFrame([(1, [1.0])], SCHEMA)).count() == 0
    assert rows(k.top_k(spark.createDataFrame([(1, [1.0]), (2, [2.0])], SCHEMA))) == [(1, 1, 2, 2.0), (2, 1, 1, 2.0)]


def test_the_tree_leaves_nodes_out():
    data = sorted(clusters(5, 4000, 8, 0.05))
    x = np.array([v for _, v in data])
    tree = k.BallTree(x)
    scores, found, visits = tree.search(x, np.arange(len(x)), 10, np.full(len(x), -np.inf))
    assert visits.sum() < 0.6 * tree.leaves * len(x)
    ids = [i for i, _ in data]
    assert [(i, ids[f]) for i, row in zip(ids, found) for f in row] == [(r[0], r[2]) for r in brute(data, 10)]


def test_waves_leave_shards_out(spark):
    data = clusters(7, 3000, 6, 0.02)
    out = k.search(spark.createDataFrame(data, SCHEMA), k=3, shard_rows=60).collect()
    assert len(out) == 3000 and out[0]["of_shards"] >= 40
    assert sum(r["shards"] for r in out) < 0.5 * sum(r["of_shards"] for r in out)
    assert sum(r["leaves"] for r in out) < 0.5 * sum(r["of_leaves"] for r in out)


def test_stated_queries_and_text_ids(spark):
    data = clusters(3, 500)
    df = spark.createDataFrame(data, SCHEMA).selectExpr("concat('id', lpad(cast(vec_id as string), 6, '0')) AS vec_id", "embedding")
    asked = df.where("endswith(vec_id, '00')")
    got = sorted(tuple(r) for r in k.top_k(df, asked, k=4, shard_rows=50).collect())
    want = [(f"id{a:06}", r, f"id{b:06}") for a, r, b, _ in brute(data, 4) if a % 100 == 0]
    assert [r[:3] for r in got] == sorted(want) and want


def test_hot_cells_are_cut(spark, monkeypatch):
    """Most rows are near one pivot or equal: cells have more shards than ranges, and none is large."""
    monkeypatch.setattr(k, "RANGES", 4)
    monkeypatch.setattr(k, "PIVOT_BYTES", 3 * 8 * 5)
    rng = np.random.default_rng(1)
    same = [float(v) for v in rng.normal(size=5).astype(np.float32)]
    data = [(i, same if i % 3 == 0 else [float(v) for v in rng.normal(size=5).astype(np.float32)]) for i in range(1200)]
    df = spark.createDataFrame(data, SCHEMA)
    got = sorted(tuple(r) for r in k.top_k(df, k=4, shard_rows=25).collect())
    assert [r[:3] for r in got] == [r[:3] for r in brute(data, 4)]
    clean = k.vectors(df)
    sizes = [r["n"] for r in k.Shards(clean, 5, 1200, 25).trees.select("n").collect()]
    assert sum(sizes) == 1200 and max(sizes) <= 100 and len(sizes) >= 30
