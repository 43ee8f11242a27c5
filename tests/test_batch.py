"""Cleaning of selections, custom XML stores, batches and merges."""

import re

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import batch, cleaning, slots, stores
from palimpsest.operators.office import Package
from palimpsest.plans import fixtures
from palimpsest.sources import opc, pdf

KEY, OTHER = "0123456789abcdef0123456789abcdef", "f" * 32


def frame(spark, *rows):
    return spark.createDataFrame([(n, "." + n.partition(".")[2], bytearray(b)) for n, b in rows], "source string, suffix string, content binary")


def test_selections_are_checked():
    raw = b"A\r\nblueberry\r\nblueberry\r\n"
    found, _ = cleaning.matched(raw, ".txt", re.compile("blueberry", re.I))
    second = next(i for i, x in found.items() if x[1] == "3")
    assert cleaning.clean_file(raw, ".txt", ["Blueberry"], [second])[0] == b"A\r\nblueberry\r\n\r\n"
    assert cleaning.clean_file(b"\xef\xbb\xbfblueberry pie\r\nb", ".txt", ["Blueberry"], None, block=True)[0] == b"\xef\xbb\xbf\r\nb"
    for ids, suffix, words, block in (["0" * 24], ".txt", ["blueberry"], False), ([], ".txt", ["blueberry"], False), (None, ".csv", ["blueberry"], True), (None, ".csv", ["a,b"], False), (None, ".json", ["blueberry"], False):
        with pytest.raises(opc.PackageError):
            cleaning.clean_file(raw, suffix, words, ids, block)


def test_stale_files_are_refused(spark):
    files = frame(spark, ("a.txt", b"blueberry")).withColumn("digest", F.lit("0" * 64))
    assert cleaning.clean_selected(files, ["blueberry"], digest="digest").first().error == "changed since the scan"


def test_attachments_two_levels_deep():
    inner = fixtures.EML.replace(b"Subject: Picking Blueberry", b"Subject: inner")
    outer = b"Subject: outer\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary=y\r\n\r\n--y\r\nContent-Type: application/octet-stream\r\nContent-Disposition: attachment; filename=in.eml\r\n\r\n" + inner + b"\r\n--y--\r\n"
    found = [x for x in slots.slots_of_bytes(outer, ".eml") if x[0] == "slot" and "Blueberry" in (x[4] or "")]
    assert {(x[7], x[8], x[5]) for x in found} == {("0.0", "in.eml", False), ("0.0|0.1", "in.eml\x1ftrays.txt", False)}


def test_sheets_headers_comments_and_protection():
    sheet = f'<worksheet xmlns="{opc.S}"><sheetData><row r="1"><c r="A1" t="str"><v>plum</v></c></row></sheetData><headerFooter><oddHeader>&amp;"plum,Bold"x plum</oddHeader><oddFooter>plum</oddFooter></headerFooter></worksheet>'
    notes = f'<comments xmlns="{opc.S}"><commentList><comment ref="A1"><text><r><t>pl</t></r><r><t>um</t></r></text></comment></commentList></comments>'
    parts = {"xl/workbook.xml": f'<workbook xmlns="{opc.S}"/>'.encode(), "xl/comments1.xml": notes.encode(), "xl/worksheets/sheet1.xml": sheet.encode()}
    raw = fixtures.package("xl/workbook.xml", parts)
    found = sorted((x[3], x[5]) for x in slots.slots_of_bytes(raw, ".xlsx", re.compile("plum")) if x[0] == "slot" and "plum" in x[4])
    assert found == sorted([(slots.SHEET["cell"], True), (slots.SHEET["header"], False), (slots.SHEET["header"], True), (slots.SHEET["comment"], True)])
    out, changes, left = cleaning.clean_file(raw, ".xlsx", ["plum"], None)
    assert changes == 3 and left == 2
    closed = fixtures.package("xl/workbook.xml", parts | {"xl/worksheets/sheet1.xml": sheet.replace("<sheetData>", "<sheetProtection/><sheetData>").encode()})
    assert not [x for x in slots.slots_of_bytes(closed, ".xlsx", re.compile("plum")) if x[0] == "slot" and x[5] and "plum" in x[4] and "sheet1" in x[1]]


def test_theme_names_and_properties():
    raw = fixtures.talk(["one"])
    out, changes, left = cleaning.clean_file(raw, ".pptx", ["Orchard"], None)
    parts = dict(opc.read_parts(out))
    assert b'name="1"' in parts["ppt/theme/theme1.xml"] and b"<vt:lpstr>1</vt:lpstr><vt:lpstr>2</vt:lpstr>" in parts["docProps/app.xml"] and left == 0


def test_pdf_properties_annotations_and_pages():
    raw = fixtures.pdf().replace(b"trailer<</Root 1 0 R>>", b"6 0 obj<</Title(Blueberry plan)/Trapped(no)>>endobj\n7 0 obj<</Type/Annot/Contents(blueberry?)>>endobj\ntrailer<</Root 1 0 R/Info 6 0 R>>").replace(b"/MediaBox", b"/Annots[7 0 R]/MediaBox")
    found = {(x[1], x[2]): x[5] for x in slots.slots_of_bytes(raw, ".pdf") if x[0] == "slot" and "lueberry" in x[4]}
    assert found == {("page:1", "6"): True, ("page:1", "annot:0:/Contents"): False, ("metadata", "/Title"): True}
    out, changes, left = cleaning.clean_file(raw, ".pdf", ["blueberry"], None)
    assert (changes, left) == (2, 1) and pdf.properties_of(out, pdf.objects(out))["Title"] == " plan" and len(pdf.pages_of(pdf.objects(out))) == 1


def test_stores_are_attached_again():
    sources = [Package(fixtures.stored(KEY, "<a>1</a>")), Package(fixtures.stored(OTHER, "<b/>"))]
    merged = Package(fixtures.stored(KEY, "<a >1</a>"))
    document = merged.parts["word/document.xml"].decode()
    control = re.search("<w:sdt>.*</w:sdt>", document)[0]
    merged.parts["word/document.xml"] = document.replace(control, control + control.replace(KEY, OTHER.upper())).encode()
    assert stores.preserve_after_merge(merged, sources) == [OTHER] and not merged.problems()
    assert set(stores.stores_of(Package(merged.raw()))) == {KEY, OTHER} and "customXml/item2.xml" in merged.parts
    with pytest.raises(opc.PackageError, match="different data"):
        stores.merged([sources[0], Package(fixtures.stored(KEY, "<a>2</a>"))])
    with pytest.raises(opc.PackageError, match="bound"):
        stores.preserve_after_merge(Package(fixtures.stored(KEY, "<a>1</a>")), sources)
    stray = Package(fixtures.stored(KEY, "<a/>"))
    stray.parts["customXml/item9.xml"] = b"<x/>"
    with pytest.raises(opc.PackageError, match="no store"):
        stores.stores_of(stray)


def test_store_changes(spark):
    one, two = (stores.read_stores(frame(spark, ("a.docx", fixtures.stored(KEY, d)), ("b.docx", fixtures.stored(OTHER, "<b/>")))) for d in ("<a/>", "<a>x</a>"))
    assert [(r.source, r.id) for r in stores.store_changes(one, two).collect()] == [("a.docx", KEY)] and stores.store_changes(one, one).count() == 0


def test_merged_workbooks_are_compared(spark):
    sources = frame(spark, ("1.xlsx", fixtures.book({"Crop": "apples"}, ("Rate",))), ("2.xlsx", fixtures.book({"crop": "pears"}, ("Tax",))))
    files = spark.createDataFrame([("m", 1, "1.xlsx"), ("m", 2, "2.xlsx")], "merge string, book long, source string")
    plan, problems = batch.workbook_plan(files, sources)
    assert problems.count() == 0
    good = frame(spark, ("m", fixtures.book({"Crop": "apples", "crop (2)": "pears"}, ("Rate", "Tax"))))
    assert batch.workbook_differences(files, plan, sources, good).count() == 0
    bad = frame(spark, ("m", fixtures.book({"Crop": "apples", "crop (2)": "plums"}, ("Rate",))))
    assert sorted(r.side for r in batch.workbook_differences(files, plan, sources, bad).collect()) == ["actual", "expected", "expected"]


def test_merged_decks_are_compared(spark):
    sources = frame(spark, ("1.pptx", fixtures.talk(["a", "b"], (1,))), ("2.pptx", fixtures.talk(["c"])))
    files = spark.createDataFrame([("m", 1, "1.pptx"), ("m", 2, "2.pptx")], "merge string, book long, source string")
    assert batch.slide_differences(files, sources, frame(spark, ("m", fixtures.talk(["a", "c"]))), skip_hidden=True).count() == 0
    assert batch.slide_differences(files, sources, frame(spark, ("m", fixtures.talk(["c", "a"]))), skip_hidden=True).count() == 4


def test_prepared_decks_and_reports(spark):
    deck = frame(spark, ("t.pptx", fixtures.talk(["a", "b"])), ("x.pptx", b"no"))
    out = batch.prepare(deck, notes=True, prune=True)
    got = {r.source: r for r in out.collect()}
    parts = dict(opc.read_parts(bytes(got["t.pptx"].content)))
    assert b"<Notes>0</Notes>" in parts["docProps/app.xml"] and b'size="2"' in parts["docProps/app.xml"] and got["x.pptx"].error
    skipped = spark.createDataFrame([("s.pdf",)], "path string")
    assert sorted(r.status for r in batch.batch_report(out, skipped).collect()) == ["done", "failed", "skipped"]


def test_files_are_moved(spark):
    files = spark.createDataFrame([(i, c) for i, c in enumerate("abcde", 1)], "ord long, name string")
    moved = batch.moved(files, spark.createDataFrame([(4,), (5,)], "ord long"), 2).orderBy("ord").collect()
    assert "".join(r.name for r in moved) == "adebc" and [r.ord for r in moved] == [1, 2, 3, 4, 5]
