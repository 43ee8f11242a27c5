"""Operators held against plain versions, exact round trips and held-out accuracy."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import extraction, language_id, media, mixing, near_dedup, packing, quality, toxicity
from palimpsest.llm.sampling import held_out
from palimpsest.session import table

BIG = "/root/testdata/sf0.01"


def test_near_dedup_links_all(spark):
    rng = random.Random(1)
    word = lambda: rng.choice("abcdefghij") + str(rng.randrange(300))
    texts = []
    for _ in range(25):
        base = [word() for _ in range(rng.randrange(4, 120))]
        for _ in range(rng.randrange(1, 12)):
            copy = list(base)
            for _ in range(rng.randrange(0, 5)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df, 3, 85).collect()}
    sets = [near_dedup.shingles_of(near_dedup.words_of(t), 3) for t in texts]
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    assert got == {i: (len(sets[i]), root(i)) for i in range(len(texts))}


def test_components(spark):
    rng = random.Random(2)
    links = [(a, a + 1) for a in range(0, 40)] + [(100, x) for x in range(101, 160)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    up = {x: x for e in links for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    got = {r.node: r.comp for r in near_dedup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for x in up if any(x in e and e[0] != e[1] for e in links)}


def test_packing_is_a_partition_of_all_ids(spark):
    docs = table(spark, BIG, "documents").limit(150).cache()
    got = packing.pack(docs).collect()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    want = {r.doc_id: np.array(tok.encode(r.text, add_special_tokens=False).ids + [2], "<u4") for r in docs.collect()}
    pieces, windows = {}, {}
    for r in got:
        ids = want[r.doc_id][r.start : r.start + r.length]
        assert len(ids) == r.length > 0 and zlib.crc32(ids.tobytes()) == r.ids_crc32 and bytes(r.ids) == ids.tobytes() and r.doc_tokens == len(want[r.doc_id])
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length, r.queue))
    for doc, ids in want.items():
        at = 0
        for s, n in sorted(pieces[doc]):
            assert s == at
            at += n
        assert at == len(ids)
    total, sizes = sum(map(len, want.values())), []
    totals = {}
    for r in got:
        totals[r.queue] = totals.get(r.queue, 0) + r.length
    for k in sorted(windows):
        at = 0
        for o, n, _ in sorted(windows[k]):
            assert o == at
            at += n
        sizes.append(at)
        for q, t in totals.items():
            assert abs(sum(n for _, n, x in windows[k] if x == q) - at * t / total) <= 2
    assert all(s == 4096 for s in sizes[:-1]) and sum(sizes) == total


@pytest.mark.parametrize("weights", [None, [1.0, 1.0, 1.0, 5.0]])
def test_schedule_is_monotone_and_exact(weights):
    plan = packing.Schedule([1000, 3, 70_000, 12], weights)
    x = np.arange(0, plan.total + 100, 7)
    c = plan.served(x)
    assert (c.sum(1) == np.minimum(x, plan.total)).all() and (np.diff(c, axis=0) >= 0).all() and (c[-1] == plan.totals).all()
    order = sorted((((q + 0.5) / w, s) for s, (t, w) in enumerate(zip(plan.totals, plan.w, strict=True)) for q in range(t)))[:5000]
    for n in (1, 17, 999, 5000):
        assert plan.served(np.array([n]))[0].tolist() == [sum(s == k for _, s in order[:n]) for k in range(4)]


def test_odd_texts_have_the_tokenizers_ids():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    texts = ["", "It's THE end's 12½ ²x…", "<|endoftext|> a", "é é İ ſ ﬁ x", "a\x1cb\x85c", "日本 русский 😀!!", "x'll 'S don't", "a" * 3000]
    enc = packing.WordEncoder(packing.default_tokenizer(), 2)
    assert [np.frombuffer(b, enc.dtype).tolist() for b in enc.encode(texts)] == [tok.encode(t, add_special_tokens=False).ids + [2] for t in texts]


def test_media_round_trip_and_general_decoder():
    payload = np.random.default_rng(3).integers(0, 256, 3 * media.FRAME_BYTES - 192, dtype=np.uint8).tobytes()
    frames = media.code_payload(payload)
    avi = media.Avi(media.write_avi(frames, len(payload)))
    assert [avi.frame(i) for i in range(3)] == frames and avi.payload_bytes == len(payload)
    back = media.read_scans([media.scan_of(f) for f in frames])
    assert back.tobytes()[: len(payload)] == payload
    blocks, planes = media.decode_frame(frames[0])
    value = np.frombuffer(payload[: media.FRAME_BYTES], np.uint8).astype(int)
    assert (np.stack(blocks, 1).ravel() == value - np.where(value >= 128, 127, 128)).all() and planes[0].shape == (32, 32)


def test_shots():
    flat = lambda v, n: np.full((n, media.FRAME_BYTES), v, np.uint8)
    hist = media.histograms(np.vstack([flat(10, 5), flat(200, 4), flat(90, 3)]))
    assert [(a, b) for a, b, _, _ in media.clips_of(hist, 25.0)] == [(0, 5), (5, 9), (9, 12)]


def test_media_query(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    want = {}
    for r in docs.collect():
        raw = r.text.encode()
        padded = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        want[r.doc_id] = (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
    got = {r.doc_id: (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in media.op8_avi_motion_jpeg(spark, "/root/testdata/sf0.001").collect()}
    assert got == want


def test_language_codes_are_exact():
    texts = {"a": [b"abracadabra abra", b"cadabra"], "b": [b"bobbob bob ob"]}
    trees = language_id.ContextTrees(texts, order=2, least=1)
    # every context's distribution sums to one, for every language
    size = trees.begin
    p = np.exp2(-trees.cost.reshape(trees.nodes, trees.base, -1)[:, 1:size].astype(float)).sum(1) + np.exp2(-(trees.cost.reshape(trees.nodes, trees.base, -1)[:, 0].astype(float) - 8))
    assert np.allclose(p, 1, atol=1e-4)
    whole = trees.bits([b"abracadabra bob"])
    old, language_id.CHUNK = language_id.CHUNK, 4
    try:
        assert np.allclose(trees.bits([b"abracadabra bob"]), whole)
    finally:
        language_id.CHUNK = old


def test_language_accuracy(spark):
    got = language_id.op4_language_id(spark, BIG).join(table(spark, BIG, "documents").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.98


def test_toxicity_accuracy(spark):
    got = toxicity.op1_toxicity(spark, BIG).join(table(spark, BIG, "labels"), "doc_id").where("held_out").collect()
    assert sum(r.predicted for r in got if not r.toxic) == 0
    assert sum(r.predicted for r in got if r.toxic) >= 0.6 * sum(r.toxic for r in got)


def test_quality_accuracy(spark):
    got = quality.op5_quality(spark, BIG).join(table(spark, BIG, "labels"), "doc_id").where("held_out").collect()
    assert sum(r.kept for r in got if r.quality) >= 0.97 * sum(r.quality for r in got)
    assert sum(r.kept for r in got if not r.quality) <= 0.1 * len([r for r in got if not r.quality])


def test_quality_shrinks_sparse_sites(spark):
    rows = [("h1", "p", 4.0)] * 500 + [("h2", "p", -4.0)] * 500 + [("h3", "p", -4.0)]
    rates, base = quality.site_rates(spark.createDataFrame(rows, "host string, path string, e double"))
    r = {x["host"]: x.path_rate for x in rates.collect()}
    assert r["h2"] < r["h3"] < base + 0.05 < r["h1"]


def test_extraction_labels():
    tree = extraction.train()
    for page in extraction.LABELLED:
        blocks = extraction.blocks_of(page)
        assert tree.predict(extraction.matrix_of(blocks)).tolist() == [b.keep for b in blocks]


def test_extraction_text():
    page = "<html><head><title>t</title><style>p{}</style></head><body><nav><a href=x>Home</a></nav><article><h1>One &amp; two</h1><p>First\n para <b>bold</b>.<p>Sh.<br></article><footer>&copy; x</footer></body>"
    assert extraction.main_text(page, extraction.train()) == "One & two\n\nFirst para bold.\n\nSh."


def test_mixing_budgets(spark):
    rows = [(i, "w " * 10, "en", s) for s, n in (("a", 1), ("b", 50), ("c", 50)) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = mixing.mix(docs, budget=600, max_epochs=2, domain=F.lit("d"))
    got = {r.source: (r.t, r.b) for r in out.groupBy("source").agg(F.sum("take_tokens").alias("t"), F.max("leaf_budget").alias("b")).collect()}
    # a holds 10 tokens, 20 in two epochs; its shortage goes to its siblings
    assert got == {"a": (20, 20), "b": (290, 290), "c": (290, 290)}


def test_held_out(spark):
    got = spark.range(50).select("id", held_out("id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in got)


def test_near_dedup_in_one_large_group(spark):
    """Copies of one text changed more and less, so that many share entries and do not link."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(100)]
    texts = []
    for _ in range(400):
        copy = list(base)
        for _ in range(rng.randrange(0, 9)):
            copy[rng.randrange(100)] = f"x{rng.randrange(10_000)}"
        texts.append(" ".join(copy))
    sets = [near_dedup.shingles_of(near_dedup.words_of(t), 3) for t in texts]
    comp = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if comp[i] != comp[j] and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((comp[i], comp[j]))
                comp = [a if c == b else c for c in comp]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df, 3, 85).collect()} == dict(enumerate(comp))
    assert 5 < len(set(comp)) < 350
