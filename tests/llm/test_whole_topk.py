"""Exact scores of components of any size, and query ids that repeat."""

import random

from palimpsest.llm import topk


def brute(rows, k, every=100):
    v = [(i, [int(x * 1024 // 1) for x in xs]) for i, xs in rows]
    out = set()
    for q in {i for i, _ in v if i % every == 0}:
        asked = {tuple(x) for i, x in v if i == q}
        best = sorted(((-sum(a * b for a, b in zip(x, y)), j) for x in asked for j, y in v if j != q))[:k]
        out |= {(q, n, j, max(-(1 << 63), min((1 << 63) - 1, -s))) for n, (s, j) in enumerate(best, 1)}
    return out


def test_against_all_pairs(spark):
    rng = random.Random(3)
    for scale in (1.0, 1e5, 1e12):
        rows = [(i, [float(round(rng.uniform(-1, 1), 2)) * scale for _ in range(6)]) for i in [*range(0, 250), 100, 200, 200, 7]]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        got = {(r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df, k=5).collect()}
        assert got == brute(rows, 5)


def test_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_BYTES", 8 * 4 * 2)
    rng = random.Random(4)
    rows = [(i, [float(rng.randrange(-3, 4)) for _ in range(4)]) for i in [*range(0, 60), 10, 10, 20]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {(r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df, every=10, k=3).collect()}
    assert got == brute(rows, 3, 10)


def test_very_long_vectors(spark):
    rows = [(i, [float((i * j) % 5 - 2) for j in range(20_000)]) for i in range(8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df, k=3).collect()} == brute(rows, 3)
