"""The pipeline's stages on nulls, repeated rows, very long texts and empty tables."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from palimpsest.session import table  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = "The harbour lay still in the morning, and nobody who came down to the quay had seen the boats go out. "
ROWS = [
    (1, PROSE * 3 + "First of them all.", "en", "a", 1), (2, None, "en", "a", None), (3, "", None, None, 0), (4, " \n\t", "de", "b", 3), (None, PROSE * 3 + "Without an id, yet here.", None, None, None),
    (5, PROSE * 3 + "First of them all.", "en", "a", 1), (6, "Some other words that stand by themselves and are no copy of anything else here at all.", "en", "b", 1),
    (6, "Some other words that stand by themselves and are no copy of anything else here at all.", "en", "b", 1), (7, " ".join(f"w{i % 997}x{i}" for i in range(60_000)), "en", "c", 1),
]


def run(spark, docs, sf_dir):
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], sf_dir).cache())
    return out


def test_odd_rows(spark, sf_dir):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    out = run(spark, docs, sf_dir)
    assert all(d.columns == docs.columns for d in out[:5])
    ids = [sorted((r.doc_id for r in d.collect()), key=repr) for d in out]
    assert set(ids[2]) <= set(ids[1]) <= set(ids[0]) and len(ids[3]) < len(ids[2])
    assert ids[3].count(6) == ids[2].count(6) // 2 and not {1, 5} <= set(ids[3])
    assert not {2, 3, 4} & set(ids[4]) and set(ids[4]) <= set(ids[3]) and set(ids[5]) == set(ids[4])


def test_empty_table(spark, sf_dir):
    out = run(spark, spark.createDataFrame([], SCHEMA), sf_dir)
    assert [d.count() for d in out] == [0] * 6


def test_run_deletes_what_it_wrote(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.count() > docs.count() / 2
