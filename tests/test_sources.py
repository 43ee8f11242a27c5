"""Readers and sinks on generated documents."""

import io
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from palimpsest.plans import fixtures
from palimpsest.sources import documents, html, mail, opc, pdf, sinks
from palimpsest.streaming import dropfolder


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "utf-16-le", "utf-16-be", "cp950"])
def test_decoding(encoding):
    body = "Blueberry 藍莓\r\nPears\r\n"
    raw = ("﻿" + body if "16" in encoding else body).encode(encoding)
    text, found = documents.decode_bytes(raw)
    assert found == encoding and text.lstrip("﻿") == body


def test_package_guards():
    def zipped(*names):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for n in names:
                z.writestr(n, b"x")
        return out.getvalue()

    with pytest.warns(UserWarning):
        doubled = zipped("a", "a")
    for raw in (b"no", doubled, zipped("../a"), zipped("/a")):
        with pytest.raises(opc.PackageError):
            opc.read_parts(raw)
    with pytest.raises(opc.PackageError):
        opc.parse(b'<!DOCTYPE a [<!ENTITY b "c">]><a/>')


def test_package_round_trip(spark):
    raw = fixtures.docx()
    files = spark.createDataFrame([("a", bytearray(raw))], "source string, content binary")
    back = opc.packages(opc.parts_of(files)).first().content
    assert opc.read_parts(bytes(back)) == opc.read_parts(raw)


def test_protection_and_fields():
    body = '<w:p><w:r><w:instrText>Draft</w:instrText></w:r><w:r><w:delText>Draft</w:delText></w:r><w:r w:x="MSIP_Label_1"><w:t>Draft</w:t></w:r></w:p>'
    found = {kind: protected for _, kind, _, _, protected in opc.text_groups("word/document.xml", dict(opc.read_parts(fixtures.docx(body)))["word/document.xml"])}
    assert found == {"field": False, "deleted": False, "text": True, "attribute": True}


def test_relationships(spark):
    files = spark.createDataFrame([("a", bytearray(fixtures.docx()))], "source string, content binary")
    assert [(r.owner, r.rid, r.target, r.external) for r in opc.rels_of(opc.parts_of(files)).collect()] == [("", "r1", "word/document.xml", False)]


def test_mail_clean_keeps_the_rest():
    out = mail.clean(fixtures.EML, re.compile("blueberry", re.I))
    msg = mail.message(out)
    assert str(msg["Subject"]) == "Picking " and msg["From"] == "orchard@example.org"
    parts = {p: x for p, x, _ in mail.walk(msg)}
    assert parts["0.0"].get_content().splitlines() == [" rows", "Pears"]
    assert b"Blueberry trays" in parts["0.1"].get_payload(decode=True)
    with pytest.raises(ValueError):
        mail.clean(b"DKIM-Signature: x\r\n" + fixtures.EML, re.compile("x"))


def test_attachment_budget(spark):
    rows = [("m", 1, "0.1", "t", True, "a.txt", None, bytearray(b"x" * 10), False), ("m", 2, "0.2", "t", True, "b.exe", None, bytearray(b"x"), False)]
    got = mail.inspected_attachments(spark.createDataFrame(rows, mail.PARTS_SCHEMA), (".txt",)).collect()
    assert sorted((r.path, r.inspected) for r in got) == [("0.1", True), ("0.2", False)]


def test_html_slots():
    rows = html.slots('<p id="x">Blue<b>ber<i>ry</i></b> note</p><script>Draft</script>')
    blocks = {}
    for block, _, kind, _, text in rows:
        if kind == "text":
            blocks.setdefault(block, []).append(text)
    assert "Blueberry note" in map("".join, blocks.values())
    assert ("code", "Draft") in {(k, t) for _, _, k, _, t in rows}


def test_pdf_state_and_escapes():
    items = list(pdf.text_items(rb"/F 10 Tf (a\)\101) Tj [(x) -5 (y)] TJ", {"F": (32, [500.0] * 95)}))
    assert [(i[2], i[3]) for i in items] == [("a)A", True), ("xy", True)]
    assert items[1][4] == -1005.0


def test_legacy_preflight():
    assert documents.legacy_problem(b"{\\rtf1 {\\object x}}", ".rtf") == "embedded object"
    assert documents.legacy_problem(b"{\\rtf1}", ".rtf") is None
    assert documents.legacy_problem(b"x", ".doc") == "no OLE file"


def test_files_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_bytes(b"Draft")
    (tmp_path / "in/b.exe").write_bytes(b"x")
    (tmp_path / "in/c.doc").write_bytes(b"x")
    good, bad = documents.read_files(spark, f"file://{tmp_path}/in")
    assert [r.suffix for r in good.collect()] == [".txt"]
    assert sorted(r.message for r in bad.collect()) == ["unsupported format", "unsupported_legacy"]
    out = spark.createDataFrame([("a.cleaned.txt", bytearray(b"x"))], "name string, content binary")
    assert sinks.write_files(out, str(tmp_path / "out")).first().error is None
    assert "exists" in sinks.write_files(out, str(tmp_path / "out")).first().error
    sinks.write_report(good.select("source"), f"file://{tmp_path}/report")
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        sinks.write_report(good.select("source"), f"file://{tmp_path}/report")


def test_profile_store(tmp_path):
    store = sinks.ProfileStore(tmp_path)
    one = store.save({"schema_version": 1, "name": "ours", "keywords": ["a"]})
    (tmp_path / f"{'0' * 32}.json").write_text("broken")
    assert store.list()[1] == 1 and store.startup_words() == list(sinks.DEFAULT_WORDS)
    store.set_startup(one)
    assert store.startup_words() == ["a"]
    with pytest.raises(sinks.KeywordError):
        store.load("../x")


def test_stream_equals_batch(spark, tmp_path):
    (tmp_path / "a.txt").write_text("keep\nDraft one\n")
    q = dropfolder.stream_findings(spark, f"file://{tmp_path}", ["draft"]).writeStream.format("memory").queryName("found").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [(r.n, r.context) for r in spark.sql("SELECT n, context FROM found").collect()] == [(2, "Draft one")]


def test_summary(spark):
    df = spark.sql("SELECT array(named_struct('location', 'l', 'category', 'c', 'context', 'x')) f")
    assert df.select(sinks.summary(F.col("f"), F.lit("completed"), F.lit(1))).first()[0] == "status: completed\nmatches: 1\nl | c | x"


def test_html_clean():
    word = re.compile("blueberry", re.I)
    page = '<p title="Blueberry">Blue<b><i>berry</i></b> &amp; n&#111;te</p><script>Blueberry</script><p>keep</p>'
    assert html.clean(page, word) == '<p title="Blueberry"><b><i></i></b> &amp; n&#111;te</p><script>Blueberry</script><p>keep</p>'
    assert html.clean(page, word, block=True) == '<p title="Blueberry"><b><i></i></b></p><script>Blueberry</script><p>keep</p>'
    assert html.clean("<p>a&lt;blueberry&gt;</p>", word) == "<p>a&lt;&gt;</p>"


def test_pdf_clean():
    word = re.compile("blueberry", re.I)
    out = pdf.clean(fixtures.pdf(), word)
    objs = pdf.objects(out)
    stream = pdf.stream_of(objs[4])
    assert b"[-6025.000000] TJ" in stream and b"(Open air) Tj" in stream and b"berry" not in stream
    assert int(re.search(rb"startxref\n(\d+)", out)[1]) == out.index(b"xref\n0 ")
    with pytest.raises(ValueError, match="safe"):
        pdf.clean(fixtures.pdf(), re.compile("^x$"))
    with pytest.raises(ValueError, match="protected"):
        pdf.clean(fixtures.pdf() + b"/Encrypt 9 0 R", word)


def test_mail_html_part():
    raw = b"Subject: s\r\nMIME-Version: 1.0\r\nContent-Type: text/html; charset=utf-8\r\n\r\n<p>Blue<b>berry</b> note</p>\r\n"
    out = mail.message(mail.clean(raw, re.compile("blueberry", re.I)))
    assert out.get_content().strip() == "<p><b></b> note</p>"
