"""Keywords, text functions, redaction, checks, graphs and planning on small cases."""

import json
import re

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import keywords as kw
from palimpsest.functions import text as tx
from palimpsest.operators import graph, merge, redact, scan, verify


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "v string").select(make(F.col("v")).alias("r")).first()[0]


@pytest.mark.parametrize("text", ["", "a", "a\nb", "a\r\nb\r\n", "\n\n", "x\x0by\x0cz\x1cq\x85w ", "no end", "\r\r\n"])
def test_lines_are_those_of_python(spark, text):
    assert one(spark, text, tx.split_lines) == text.splitlines(keepends=True)


def test_keywords():
    assert kw.normalize([" b ", "a", "b", ""]) == ["b", "a"]
    assert kw.longest_first(["a", "bb", "c"]) == ["bb", "a", "c"]
    for bad in ([], [" "], ["x" * 151], [str(i) for i in range(101)]):
        with pytest.raises(kw.KeywordError):
            kw.normalize(bad)


@pytest.mark.parametrize("word", ["C++", "a.b", "x\\Ey", "(r)", "$1", "ß"])
def test_keywords_are_literal(spark, word):
    pattern = kw.spark_pattern([word])
    assert one(spark, f"_{word.upper()}_{word}_ab", lambda c: F.size(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)))) == len(re.findall(re.escape(word), f"_{word.upper()}_{word}_ab", re.I))


@pytest.mark.parametrize("change", [{"schema_version": 2}, {"schema_version": True}, {"name": ""}, {"name": "x" * 81}, {"name": "a\nb"}, {"keywords": []}, {"keywords": ["a;b"]}, {"keywords": [1]}, {"keywords": "a"}, {"more": 1}])
def test_bad_profiles(change):
    with pytest.raises(kw.KeywordError):
        kw.read_profile(json.dumps({"schema_version": 1, "name": "ours", "keywords": ["a"]} | change).encode())


def test_profile_keeps_first():
    assert kw.read_profile(b'\xef\xbb\xbf{"schema_version":1,"name":"n","keywords":["b","a","b"]}')["keywords"] == ["b", "a"]


def test_block_mode_keeps_mark_and_line_end(spark):
    text = "﻿Draft one\r\nkeep\nDraft\x0bDraft last"
    assert one(spark, text, lambda c: redact.clean_text(c, ["draft"], block=True)) == "﻿\r\nkeep\n"
    assert one(spark, text, lambda c: redact.clean_text(c, ["draft"])) == "﻿ one\r\nkeep\n\x0b last"


def test_context_of_long_lines(spark):
    line = "x " * 300 + "token" + " y" * 400
    found = scan.line_findings(spark.createDataFrame([(1, line)], "doc_id long, text string"), ["token"], ["doc_id"]).first()
    at = line.index("token")
    assert found["context"] == " ".join(line[max(0, at - 110) : at + 350].split())[:500]


def test_split_runs(spark):
    runs = spark.createDataFrame([("p", i, t) for i, t in enumerate(["Keep ", "Confi", "dential", " tail"])] + [("q", 0, "none"), ("q", 1, None)], "p string, i int, t string")
    got = {(r.p, r.i): r.cleaned for r in redact.clip_runs(runs, ["confidential"], ["p"], "i", "t").collect()}
    assert got == {("p", 0): "Keep ", ("p", 1): "", ("p", 2): "", ("p", 3): " tail", ("q", 0): "none", ("q", 1): ""}
    block = {(r.p, r.i): r.cleaned for r in redact.clip_runs(runs, ["confidential"], ["p"], "i", "t", block=True).collect()}
    assert block[("p", 0)] == "" and block[("q", 0)] == "none"


def test_reachability_with_a_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "node string")
    assert sorted(r.node for r in graph.reachable(edges, seeds).collect()) == ["a", "b", "c"]
    many = graph.reachable_by_source(edges.withColumn("source", F.lit("s")), seeds.withColumn("source", F.lit("s")))
    assert sorted(r.node for r in many.collect()) == ["a", "b", "c"]


def test_sheet_names():
    assert merge.sheet_names([["Summary"], ["Summary", "Summary (2)"]]) == [["Summary"], ["Summary (3)", "Summary (2)"]]
    assert len(merge.sheet_names([["n" * 31], ["N" * 31]])[1][0]) == 31


def test_label_states(spark):
    state = lambda e, r: spark.range(1).select(merge.label_signature(F.create_map(F.lit("enabled"), F.lit(e), F.lit("removed"), F.lit(r))).alias("s")).first().s
    assert state("0", "1") is None and state("true", "false") is not None


def test_multiset_difference(spark):
    a, b = (spark.createDataFrame([(x,) for x in s], "v string") for s in ("aab", "abc"))
    assert sorted(map(tuple, verify.multiset_difference(a, b).collect())) == [("a", "left"), ("c", "right")]


@pytest.mark.parametrize(("row", "column", "name"), [(0, 0, "A1"), (9, 25, "Z10"), (0, 26, "AA1"), (0, 701, "ZZ1"), (0, 702, "AAA1"), (1048575, 16383, "XFD1048576"), (1048576, 0, None)])
def test_a1(spark, row, column, name):
    assert spark.createDataFrame([(row, column)], "r long, c long").select(tx.a1_reference(F.col("r"), F.col("c"))).first()[0] == name


def test_store_id(spark):
    want = "0123456789abcdef0123456789abcdef"
    for spelling in ("{01234567-89AB-CDEF-0123-456789ABCDEF}", f"urn:uuid:{want}", want):
        assert one(spark, spelling, tx.store_id) == want
    assert one(spark, "no", tx.store_id) is None


def test_natural_order(spark):
    names = ["b10", "b9", "A2", "a1", "b09"]
    df = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "n string, i int")
    assert [r.n for r in df.orderBy(tx.natural_key(F.col("n")), "i").collect()] == ["a1", "A2", "b9", "b09", "b10"]
