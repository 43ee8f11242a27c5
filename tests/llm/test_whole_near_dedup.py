"""One document of a group stays, whatever its ids."""

import tracemalloc

import pyarrow as pa

from palimpsest.llm import near_dedup


def test_one_of_a_group_without_unique_ids(spark):
    base = " ".join(f"w{i}" for i in range(200))
    rows = [(None, base), (None, base + " x"), (7, "a " + base.replace("w", "v")), (7, base.replace("w", "v")), (8, base.replace("w", "v")), (1, ""), (2, "")]
    kept = near_dedup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id for r in kept), key=repr) == [1, 2, 7, None] and set(map(tuple, kept)) <= set(rows)


def test_a_worker_holds_the_words_of_one_text(spark, monkeypatch):
    """The functions that read whole texts, on a batch of long ones: what they hold beside it does not grow with its rows."""
    docs = spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")
    runs, frame = [], type(docs)
    plain = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, f, *args, **named: runs.append(f) or plain(self, f, *args, **named))
    near_dedup.sketches(docs, 3)
    near_dedup.sets_of(docs, spark.createDataFrame([(0, 1)], "node long, class_id long"), 3, "doc_id", "text")
    texts = [" ".join(f"w{(i * j * j + j) % 3001}" for j in range(4000)) for i in range(600)]
    column, ids = pa.array(texts, pa.string()), pa.array(range(600), pa.int64())
    maker = near_dedup.Sketcher(3)
    for run, columns in ((runs[0], [ids, ids, column]), (runs[1], [column])):
        batch = pa.record_batch(columns, names=[str(i) for i in range(len(columns))])
        rows = 0
        tracemalloc.start()
        for found in run(iter([batch])):
            for i in range(0, found.num_rows, 50):
                words = near_dedup.words_of(texts[rows + i])
                assert found.column("fp")[i].as_py() == near_dedup.fingerprint(words)
                if "hashes" in found.schema.names:
                    assert found.column("hashes")[i].as_py() == maker.hashes(words).tobytes()
            rows += found.num_rows
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert rows == 600 and peak < 12 << 20, peak
