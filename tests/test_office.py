"""Edits of packages: what goes, and that all else keeps its bytes."""

import pytest

from palimpsest.operators import office
from palimpsest.plans import fixtures
from palimpsest.sources import opc

WORDS = ["Blueberry"]
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
P = "http://schemas.openxmlformats.org/presentationml/2006/main"


def cleaned(raw, **options):
    package = office.Package(raw)
    package.clean_texts(office.pattern_of(WORDS), options.get("block", False))
    package.clean_sheets(office.pattern_of(WORDS), options.get("block", False), options.get("refs"))
    return package


def test_split_runs_and_untouched_bytes():
    raw = fixtures.docx()
    before, after = dict(opc.read_parts(raw)), cleaned(raw).parts
    assert after["word/document.xml"] == before["word/document.xml"].replace(b">Blue<", b"><").replace(b">berry<", b"><")
    assert {p: b for p, b in after.items() if p != "word/document.xml"} == {p: b for p, b in before.items() if p != "word/document.xml"}
    assert b"Ship" not in cleaned(raw, block=True).parts["word/document.xml"]


def test_fields_and_labels_stay():
    body = '<w:p><w:r><w:instrText>Blueberry</w:instrText></w:r></w:p><w:p w:a="MSIP_Label_x"><w:r><w:t>Blueberry</w:t></w:r></w:p><w:p><w:r><w:delText>Blueberry &amp; x</w:delText></w:r></w:p>'
    out = cleaned(fixtures.docx(body)).parts["word/document.xml"]
    assert out.count(b"Blueberry") == 2 and b"<w:delText> &amp; x</w:delText>" in out


def test_only_the_selected_cell_is_inlined():
    out = cleaned(fixtures.xlsx(), refs={("xl/worksheets/sheet1.xml", "A2")}).parts
    sheet = out["xl/worksheets/sheet1.xml"]
    assert b'<c r="A2" t="inlineStr">' in sheet and b'<c r="B4" t="s"><v>0</v></c>' in sheet and b"<f>6*7</f>" in sheet
    assert b"Blue" in out["xl/sharedStrings.xml"]
    assert b"Blue" not in cleaned(fixtures.xlsx()).parts["xl/sharedStrings.xml"]


def deck():
    rel = lambda i, kind, target: f'<Relationship Id="{i}" Type="{R}/{kind}" Target="{target}"/>'
    rels = lambda *x: f'<Relationships xmlns="{opc.RELATIONSHIPS}">{"".join(x)}</Relationships>'.encode()
    parts = [
        ("[Content_Types].xml", b'<Types xmlns="t">' + b"".join(f'<Override PartName="/ppt/{k}s/{k}{i}.xml" ContentType="x"/>'.encode() for k in ("slideMaster", "slideLayout") for i in (1, 2)) + b"</Types>"),
        ("_rels/.rels", rels(rel("a", "officeDocument", "ppt/presentation.xml"))),
        ("ppt/presentation.xml", f'<p:presentation xmlns:p="{P}" xmlns:r="{R}"><p:sldMasterIdLst><p:sldMasterId r:id="m1"/><p:sldMasterId r:id="m2"/></p:sldMasterIdLst></p:presentation>'.encode()),
        ("ppt/_rels/presentation.xml.rels", rels(rel("m1", "slideMaster", "slideMasters/slideMaster1.xml"), rel("m2", "slideMaster", "slideMasters/slideMaster2.xml"), rel("s1", "slide", "slides/slide1.xml"))),
        ("ppt/slides/slide1.xml", b"<s/>"),
        ("ppt/slides/_rels/slide1.xml.rels", rels(rel("l", "slideLayout", "../slideLayouts/slideLayout2.xml"))),
    ]
    for i in (1, 2):
        parts += [
            (f"ppt/slideMasters/slideMaster{i}.xml", f'<p:m xmlns:p="{P}" xmlns:r="{R}"><p:sldLayoutIdLst><p:sldLayoutId r:id="l"/></p:sldLayoutIdLst></p:m>'.encode()),
            (f"ppt/slideMasters/_rels/slideMaster{i}.xml.rels", rels(rel("l", "slideLayout", f"../slideLayouts/slideLayout{i}.xml"), rel("t", "theme", f"../theme/theme{i}.xml"))),
            (f"ppt/slideLayouts/slideLayout{i}.xml", b"<l/>"),
            (f"ppt/slideLayouts/_rels/slideLayout{i}.xml.rels", rels(rel("m", "slideMaster", f"../slideMasters/slideMaster{i}.xml"))),
            (f"ppt/theme/theme{i}.xml", b"<t/>"),
        ]
    return opc.write_package(parts)


def test_prune():
    package = office.Package(deck())
    package.prune_template()
    assert not package.problems()
    assert [p for p in package.parts if "1.xml" in p and "slide1" not in p] == [] and "ppt/theme/theme2.xml" in package.parts
    assert package.parts["ppt/presentation.xml"].count(b"sldMasterId ") == 1


def test_word_comments_go_revisions_stay():
    body = '<w:p><w:commentRangeStart w:id="1"/><w:ins w:author="Ann"><w:r><w:t>x</w:t></w:r></w:ins><w:r><w:commentReference w:id="1"/></w:r></w:p>'
    parts = dict(opc.read_parts(fixtures.docx(body)))
    kind = "application/vnd.openxmlformats-officedocument.wordprocessingml.comments+xml"
    parts["[Content_Types].xml"] = parts["[Content_Types].xml"].replace(b"</Types>", f'<Override PartName="/word/comments.xml" ContentType="{kind}"/></Types>'.encode())
    parts["word/comments.xml"] = b"<c/>"
    parts["word/_rels/document.xml.rels"] = f'<Relationships xmlns="{opc.RELATIONSHIPS}"><Relationship Id="c" Type="{R}/comments" Target="comments.xml"/></Relationships>'.encode()
    package = office.Package(opc.write_package(list(parts.items())))
    package.remove_word_comments()
    assert "word/comments.xml" not in package.parts and not package.problems()
    out = package.parts["word/document.xml"]
    assert b"comment" not in out and b'<w:ins w:author="Ann">' in out


def test_packages_as_rows(spark):
    signed = opc.write_package([*opc.read_parts(fixtures.docx()), ("_xmlsignatures/s.xml", b"<s/>")])
    rows = [("a", fixtures.docx()), ("b", signed), ("c", b"no"), ("d", deck())]
    df = spark.createDataFrame([(n, bytearray(b)) for n, b in rows], "source string, content binary")
    got = {r.source: r for r in office.clean_packages(df, WORDS, prune=True).collect()}
    assert got["a"].edits == 2 and got["b"].error == "signed" and got["c"].content is None and got["d"].removed == 3
    again = spark.createDataFrame([("a", bytearray(got["a"].content))], "source string, content binary")
    assert office.clean_packages(again, WORDS).first().edits == 0


def test_missing_targets_are_reported():
    parts = dict(opc.read_parts(fixtures.docx()))
    del parts["word/document.xml"]
    assert len(office.Package(opc.write_package(list(parts.items()))).problems()) == 2
    with pytest.raises(opc.PackageError):
        office.nodes_of(b"<!DOCTYPE a><a/>")


def test_sheet_notes_go_controls_stay():
    vml = '<xml xmlns:v="urn:schemas-microsoft-com:vml" xmlns:x="urn:schemas-microsoft-com:office:excel">' + "".join(
        f'<v:shape id="{i}"><x:ClientData ObjectType="{k}"><x:Row>0</x:Row><x:Column>{c}</x:Column></x:ClientData></v:shape>' for i, k, c in (("n", "Note", 0), ("t", "Note", 1), ("b", "Button", 0))
    ) + "</xml>"
    rel = lambda i, kind, target: f'<Relationship Id="{i}" Type="{R}/{kind}" Target="{target}"/>'
    parts = dict(opc.read_parts(fixtures.xlsx())) | {
        "[Content_Types].xml": b"<Types/>",
        "_rels/.rels": f'<Relationships xmlns="{opc.RELATIONSHIPS}">{rel("a", "officeDocument", "xl/workbook.xml")}</Relationships>'.encode(),
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{opc.RELATIONSHIPS}">{rel("a", "worksheet", "worksheets/sheet1.xml")}</Relationships>'.encode(),
        "xl/comments1.xml": f'<comments xmlns="{opc.S}"><commentList><comment ref="A1"/><comment ref="B1"/></commentList></comments>'.encode(),
        "xl/threadedComments/t1.xml": b'<T><threadedComment ref="B1"/></T>',
        "xl/drawings/v.vml": vml.encode(),
        "xl/worksheets/_rels/sheet1.xml.rels": f'<Relationships xmlns="{opc.RELATIONSHIPS}">{rel("c", "comments", "../comments1.xml")}{rel("t", "threadedComment", "../threadedComments/t1.xml")}{rel("v", "vmlDrawing", "../drawings/v.vml")}</Relationships>'.encode(),
    }
    raw = opc.write_package(list(parts.items()))
    package = office.Package(raw)
    package.remove_sheet_annotations(threaded=False)
    assert b'ref="B1"' in package.parts["xl/comments1.xml"] and b'ref="A1"' not in package.parts["xl/comments1.xml"]
    assert b'id="n"' not in package.parts["xl/drawings/v.vml"] and b'id="t"' in package.parts["xl/drawings/v.vml"] and b'id="b"' in package.parts["xl/drawings/v.vml"]
    package = office.Package(raw)
    package.remove_sheet_annotations()
    assert "xl/comments1.xml" not in package.parts and "xl/threadedComments/t1.xml" not in package.parts and not package.problems()


def test_labels_and_guards():
    from palimpsest.operators import inspect

    def labelled(state):
        rel = f'<Relationship Id="l" Type="http://x/classificationlabels" Target="docMetadata/LabelInfo.xml"/>'
        parts = dict(opc.read_parts(fixtures.docx()))
        parts["_rels/.rels"] = parts["_rels/.rels"].replace(b"</Relationships>", rel.encode() + b"</Relationships>")
        parts["docMetadata/LabelInfo.xml"] = f"<labelList><label {state}/></labelList>".encode()
        return inspect.inspected("a", opc.write_package(list(parts.items())))

    assert "id=x" in labelled('id="x" siteId="s" enabled="1" removed="0"')[-2]
    assert labelled('id="x" siteId="s" enabled="0" removed="1"')[-2:] == ("", None)
    assert labelled('id="x" siteId="s" enabled="0" removed="0"')[-1]
    assert inspect.editable_attribute(opc.W, "pStyle", f"{opc.W}}}val") and not inspect.editable_attribute(opc.W, "pStyle", f"{R}}}id")
    import re

    assert not inspect.header_is_editable('&"Draft,Bold"x', re.compile("draft", re.I)) and inspect.header_is_editable("Draft", re.compile("draft", re.I))
