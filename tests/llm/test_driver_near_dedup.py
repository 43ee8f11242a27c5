"""What near-duplicate detection has the driver hold: nothing that grows with the corpus, however small its files are."""

import pytest

from palimpsest import session
from palimpsest.llm import near_dedup

BASE = [" ".join(f"v{g}w{i}" for i in range(60)) for g in range(3)]
ROWS = [(i, f"{BASE[i % 3]} end {i}") for i in range(12)] + [(20, BASE[0]), (20, BASE[0]), (21, ""), (22, None)]


@pytest.fixture
def plans(spark, monkeypatch):
    """Plans of the tables that are written, as planned from files' sizes."""
    found = []

    def written(df, *args, **named):
        found.append(df._jdf.queryExecution().executedPlan().toString())
        return session.written(df, *args, **named)

    monkeypatch.setattr(near_dedup, "written", written)
    return found


def test_classes_and_sets_are_not_broadcast(spark, plans):
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "10485760b"
    got = near_dedup.near_duplicates(spark.createDataFrame(ROWS, "doc_id long, text string"), 3, 85)
    plans.append(got._jdf.queryExecution().executedPlan().toString())
    assert sum("SortMergeJoin" in p for p in plans) > 5 and not any("Broadcast" in p for p in plans)
    assert {r.doc_id: r.component_id for r in got.collect()} == {i: i % 3 for i in range(12)} | {20: 0, 21: 21, 22: 22}


def test_kept_ids_are_broadcast_only_while_few(spark, plans, monkeypatch):
    docs = spark.createDataFrame([*ROWS, (30, "kept, and twice there"), (30, "kept, and twice there")], "doc_id long, text string")
    monkeypatch.setattr(session, "BROADCAST_ROWS", 0)
    got = near_dedup.drop_near_duplicates(docs, 3, 85)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert sorted(r.doc_id for r in got.collect()) == [0, 1, 2, 21, 22, 30]
