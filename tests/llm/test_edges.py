"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import extraction, language_id, media, mixing, near_dedup, packing, quality, topk, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, epoch string, queue int"
LONG = "lorem ipsum dolor " * 20_000
ROWS = [
    (1, "A plain text. With two sentences.", "en", "a", 33, 0.0, "x", 1),
    (2, None, "en", None, None, None, None, None),
    (3, "", None, "a", 0, None, None, None),
    (4, " \n\t ", "de", "b", 4, None, None, None),
    (None, "A text without an id, of some words.", "de", "b", 1, None, None, None),
    (5, LONG, "fr", "c", len(LONG), None, None, None),
    (6, "A plain text. With two sentences.", "en", "a", 33, None, None, None),
    (6, "A plain text. With two sentences.", "en", "a", 33, None, None, None),
    (7, "😀 İstanbul ß <|endoftext|> \x1c end", "es", "b", 9, None, None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 1, 0), (4, 0, 1), (None, 1, 1), (5, None, None), (99, 0, 1)], "doc_id long, quality int, toxic int")


def test_toxicity(docs, none, labels):
    model = toxicity.train(docs, labels)
    got = toxicity.score_toxicity(docs, model)
    assert got.count() == len(ROWS) and {r.score for r in got.collect()} == {0.0}
    assert toxicity.score_toxicity(none, toxicity.train(none, labels)).count() == 0
    assert toxicity.drop_toxic(docs, model).columns == docs.columns


def test_toxicity_offsets():
    model = toxicity.SentenceModel({"idiot": 20.0}, -4.6)
    text = "İ fine. You idiot! End"
    score, spans = model.score(text)
    assert score > 0.99 and [text[a:b] for a, b, _ in spans] == [" You idiot!"]


def test_warc(spark):
    big = "<p>" + "x" * 200
    pages = spark.createDataFrame([(3, "u3", big, 1), (1, "u\n1", big, 1), (2, None, "small", 1), (4, "u", None, 1), (None, "n", big, 1), (3, "u3", big, 1)], "page_id long, url string, html string, digest int")
    got = warc.resolved(warc.assemble(warc.parse_archives(warc.write_archives(pages))))
    rows = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in got.collect()), key=repr)
    assert rows == sorted([(1, "response", None, 203), (2, "response", None, 5), (3, "revisit", 1, 203), (3, "revisit", 1, 203), (4, "response", None, 0), (None, "revisit", 1, 203)], key=repr)
    assert warc.resolved(warc.assemble(warc.parse_archives(warc.write_archives(pages.where("page_id = 77"))))).count() == 0


def test_warc_reads_plain_and_broken_archives():
    part = warc.record("response", "<urn:uuid:1>", [("WARC-Target-URI", "u")], b"HTTP/1.1 200 OK\r\n\r\nbody")
    assert [b for _, _, b in warc.read_records(part + part[:20])] == [b"HTTP/1.1 200 OK\r\n\r\nbody"]
    plain = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 4\r\n\r\nbody\r\n\r\n"
    assert [b for _, _, b in warc.read_records(plain * 2)] == [b"body"] * 2


def test_warc_links_either_way(spark):
    one = lambda kind, rid, to: ("a", 0, kind, rid, to, "u", "d", None, None, [], None)
    records = spark.createDataFrame([one("response", "r", ["q"]), one("request", "q", []), one("metadata", "m", ["r"]), one("metadata", "o", ["gone"])], warc.RECORD_SCHEMA)
    row = warc.assemble(records).collect()
    assert len(row) == 1 and [x.record_id for x in row[0].requests] == ["q"] and [x.record_id for x in row[0].metadata] == ["m"]


def test_extraction(spark):
    pages = spark.createDataFrame([(1, None, None, "t"), (2, "u", "", "t"), (3, "u", "<article><p>Long &amp; short<!-- x", "t"), (4, "u", "</p></div>text <b", "t"), (3, "u", "<script>x", "t")], "page_id long, url string, html string, text string")
    got = [(r.page_id, r.text, r.n_chars) for r in extraction.extract(pages).orderBy("page_id", "n_chars").collect()]
    assert got[0] == (1, "", 0) and got[1] == (2, "", 0) and (3, "Long & short", 12) in got and (3, "", 0) in got
    assert extraction.extract(pages.where("page_id > 9")).count() == 0


def test_language(docs, none):
    trees = language_id.train(docs, F.lit(True))
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(docs, trees).collect()}
    assert got[2] == got[3] == got[4] == ("und", 0.0) and got[6][0] == "en"
    empty = language_id.train(none, F.lit(True))
    assert {r.lang_pred for r in language_id.predict(docs, empty).collect()} == {"und"}
    assert language_id.predict(none, trees).count() == 0


def test_quality(docs, none, labels):
    model = quality.train(docs, labels)
    out = quality.drop_bad(docs, model)
    assert out.columns == docs.columns and quality.drop_bad(none, model).count() == 0
    assert quality.drop_bad(docs, quality.train(none, labels)).count() == len(ROWS)


def test_packing(docs, none):
    got = packing.pack(docs, window=64).collect()
    assert sorted({r.doc_id for r in got}, key=repr) == [1, 2, 3, 4, 5, 6, 7, None]
    assert {(r.doc_tokens, r.length) for r in got if r.doc_id in (2, 3, 4)} == {(1, 1)}
    assert packing.pack(none).count() == 0


def test_top_k(spark):
    inf = float("inf")
    rows = [(0, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (2, [1.0, 0.5], 1), (100, [-1.0, 0.0], 1), (3, None, 1), (4, [None, 1.0], 1), (5, [inf, 1.0], 1), (6, [1.0], 1), (None, [1.0, 1.0], 1), (2, [1.0, 0.5], 1), (7, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = [(r.query_id, r.rank, r.vec_id) for r in topk.top_k(df, k=3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2), (0, 3, 2), (100, 1, 0), (100, 2, 1), (100, 3, 2)]
    assert topk.top_k(df.where("vec_id < 0")).count() == 0


def test_media(docs, none):
    got = {r.doc_id: r for r in media.read_avi(media.encode_avi(docs)).collect()}
    assert got[2].payload_bytes == got[3].payload_bytes == 192 and got[2].media_sha256 == got[3].media_sha256
    assert got[5].n_bytes == len(LONG) and got[5].clips[0].first_frame == 0
    assert media.read_avi(media.encode_avi(none)).count() == 0
    broken = media.read_avi(media.encode_avi(docs).withColumn("media", F.lit(b"no")))
    assert {r.feature for r in broken.collect()} == {None}


def test_near_dedup(docs, none):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs, 3, 85).collect()}
    assert got[1] == (4, 1, True) and got[6] == (4, 1, False) and got[2] == (0, 2, True) and got[4] == (0, 4, True)
    assert got[None][1] is None and got[None][2]
    assert near_dedup.near_duplicates(none).count() == 0
    kept = near_dedup.drop_near_duplicates(docs, 3, 85)
    assert kept.columns == docs.columns and kept.count() == len(ROWS) - 2


def test_mixing(docs, none):
    out = mixing.mix(docs)
    assert out.columns[: len(docs.columns)] == docs.columns and "_epoch" in out.columns
    assert {r.doc_id for r in out.collect()} <= {1, 5, 6, 7, None}
    assert mixing.mix(none).count() == 0 and mixing.mix(docs, budget=0).count() == 0
