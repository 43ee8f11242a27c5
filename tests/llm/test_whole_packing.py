"""Packing of many sources: real names and weights at any count, with the result of few."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import packing


@pytest.mark.parametrize("weights", [None, {"s0": 1.0, "s1": 1.0, "s2": 4.0, "s3": 0.5, "s4": 1.0}])
def test_blocks_give_what_few_queues_give(spark, monkeypatch, weights):
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.expr("repeat('some words here ', cast(id * 7 % 50 as int))").alias("text"), F.when(F.col("id") % 6 < 5, F.concat(F.lit("s"), F.col("id") % 6)).alias("source")).repartition(3)
    few = packing.pack(docs, window=32, weights=weights).collect()
    monkeypatch.setattr(packing, "MAX_QUEUES", 2)
    monkeypatch.setattr(packing, "BLOCK", 3)
    many = packing.pack(docs, window=32, weights=weights).collect()
    # the offsets inside a queue depend on the partitions, which are the same
    assert sorted(map(repr, many)) == sorted(map(repr, few)) and max(r.sequence_id for r in few) > 20


def test_more_sources_than_queues(spark):
    n = packing.MAX_QUEUES + 200
    docs = spark.range(2 * n).select(F.col("id").alias("doc_id"), F.lit("a b c d e f g h i j k l m n o").alias("text"), F.concat(F.lit("host"), F.col("id") % n).alias("source"))
    weights = {f"host{i}": 3.0 if i < 10 else 1.0 for i in range(n)}
    got = packing.pack(docs, weights=weights).collect()
    assert {r.queue for r in got} == set(weights)
    served = {}
    for r in got:
        if r.sequence_id < 2:
            served[r.queue] = served.get(r.queue, 0) + r.length
    share = 2 * 4096 / sum(weights.values())
    assert all(abs(served.get(q, 0) - w * share) <= 1 for q, w in weights.items())
    seen = {}
    for r in got:
        seen.setdefault(r.doc_id, []).append((r.start, r.length))
    assert all(sum(x for _, x in p) == r.doc_tokens for r in got for p in [seen[r.doc_id]])


def test_key_is_the_token_of_that_rank():
    plan = packing.Schedule([5, 9, 3, 9, 1], [1.0, 2.0, 1.0, 2.0, 0.3])
    order = sorted(((q + 0.5) / w, s) for s, (t, w) in enumerate(zip(plan.totals, plan.w, strict=True)) for q in range(t))
    assert [plan.key(x) for x in range(plan.total)] == order
    assert (plan.upto(np.inf) == plan.totals).all()
