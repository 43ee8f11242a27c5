"""One findings table for files of all formats: every searchable text of a file is a slot, matched in the JVM.

Parsers only cut files into slots (part, path, category, text, whether cleaning may touch it); keywords, ids, contexts and
vetoes are DataFrame operations on them. Attachments of mail are cut like files of their own, two levels deep within a
budget of bytes; their findings are scan-only. What is not looked into is a note, what cannot be read an error row.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import keywords as kw
from palimpsest.functions import text as tx
from palimpsest.operators import scan
from palimpsest.operators.inspect import editable_attribute, flag
from palimpsest.operators.office import MAIN, Node, nodes_of
from palimpsest.session import written
from palimpsest.sources import documents as files
from palimpsest.sources import html, mail, pdf
from palimpsest.sources.opc import A, RUNS, S, W, PackageError, _map, problem_of, read_parts

SLOTS_SCHEMA = "source string, kind string, part string, path string, category string, text string, cleanable boolean, place string, outer string, names string"
PACKAGES = {".docx": "Word", ".pptx": "PowerPoint", ".xlsx": "Excel"}
#: Categories of findings (fixed values: ids are made of them).
OFFICE = {"text": "文字段落", "deleted": "修訂刪除文字", "field": "欄位指令（只掃描）", "other": "屬性／其他文字", "attribute": "內部名稱／屬性"}
SHEET = {
    "shared": "共用文字（所有引用，只掃描）", "cell": "儲存格文字", "result": "公式結果（只掃描）", "formula": "公式（只掃描）", "header": "Excel 頁首頁尾",
    "comment": "Excel 註解", "other": "Excel 屬性／圖形文字", "attribute": "Excel 名稱／屬性（只掃描）",
}
MAIL = {"subject": "郵件標題", "attachment": "附件名稱（只掃描）", "line": "郵件純文字行", "block": "郵件 HTML 段落", "attribute": "郵件 HTML 屬性（只掃描）", "code": "郵件樣式／指令（只掃描）"}
PDF = {"item": "PDF 文字區塊（整個刪除）", "property": "PDF 文件屬性", "xmp": "PDF XMP（只掃描）", "annotation": "PDF 註解（只掃描）"}
HEADERS = ("oddHeader", "evenHeader", "firstHeader", "oddFooter", "evenFooter", "firstFooter")
#: Properties of a PDF that cleaning may change (fixed values).
PDF_PROPERTIES = ("Title", "Author", "Subject", "Keywords", "Creator", "Producer")

Slot = tuple[str, str | None, str | None, str | None, str | None, bool | None, str | None, str, str]


def slot(part: str, path: str, category: str, text: str | None, cleanable: bool, place: str | None = None) -> Slot:
    return "slot", part, path, category, text or "", cleanable, place, "", ""


def note(text: str, kind: str = "note") -> Slot:
    return kind, None, None, None, text, None, None, "", ""


def paths_of(nodes: list[Node]) -> dict[int, str]:
    """XPath of each node by id: names with their prefixes, * for elements of a default namespace, and a number where
    siblings of that name (any siblings, for *) exist."""
    out: dict[int, str] = {}
    for n in nodes:
        if n.parent is None:
            out[id(n)] = "/" + step_of(n)
        counts, seen = Counter(step_of(c) for c in n.children), Counter()
        for i, c in enumerate(n.children, 1):
            step = step_of(c)
            seen[step] += 1
            many, place = (len(n.children) > 1, i) if step == "*" else (counts[step] > 1, seen[step])
            out[id(c)] = f"{out[id(n)]}/{step}" + (f"[{place}]" if many else "")
    return out


def step_of(n: Node) -> str:
    return f"{n.prefix}:{n.name}" if n.prefix else "*" if n.ns else n.name


def clark(attribute: str) -> str:
    ns, _, name = attribute.rpartition("}")
    return f"{{{ns}}}{name}" if ns else name


def protected_part(part: str) -> bool:
    return part.startswith(("_xmlsignatures/", "customXml/")) or "labelinfo" in part.lower() or part.endswith(".rels") or part == "[Content_Types].xml"


def protected(part: str, node: Node) -> bool:
    """Signatures, labels and custom XML, and whatever stands below a label's name."""
    if protected_part(part):
        return True
    chain = list(node.up())
    if any("mip_label_" in v.lower() for a in chain for v in a.attrs.values()):
        return True
    return part == "docProps/custom.xml" and any(a.name == "property" and re.search("msip|sensitivity|label", a.attrs.get("name", ""), re.I) for a in chain)


def paragraphs_of(nodes: list[Node]) -> dict[tuple[int, str], tuple[Node, list[Node]]]:
    """Runs with a text by their paragraph and kind (text, deleted, field), in document order."""
    out: dict[tuple[int, str], tuple[Node, list[Node]]] = {}
    for n in nodes:
        if n.ns in (W, A) and n.name in RUNS and n.text:
            paragraph = next((a for a in n.up() if a is not n and (a.ns, a.name) == (n.ns, "p")), n)
            out.setdefault((id(paragraph), RUNS[n.name]), (paragraph, []))[1].append(n)
    return out


def office_slots(parts: dict[str, bytes]) -> Iterator[Slot]:
    """Word and PowerPoint: paragraphs, other texts and attributes of all parts, in package order."""
    for part, payload in parts.items():
        if not part.endswith(".xml"):
            continue
        nodes = nodes_of(payload)
        paths, runs = paths_of(nodes), set()
        for (_, kind), (paragraph, own) in paragraphs_of(nodes).items():
            runs.update(map(id, own))
            ok = kind != "field" and not any(protected(part, n) for n in own)
            yield slot(part, paths[id(paragraph)] + ("" if kind == "text" else f"/{kind}"), OFFICE[kind], "".join(n.text for n in own), ok)
        for n in nodes:
            closed = None
            if n.text.strip() and id(n) not in runs:
                closed = protected(part, n)
                yield slot(part, f"{paths[id(n)]}/text", OFFICE["other"], n.text, not closed and part.startswith(("docProps/", "ppt/", "word/")))
            for k, v in n.attrs.items():
                ok = editable_attribute(n.ns, n.name, k) and not protected(part, n)
                yield slot(part, f"{paths[id(n)]}/@{clark(k)}", OFFICE["attribute"], v, ok)


def texts_below(node: Node, name: str = "t") -> list[Node]:
    """Elements of that name below ``node``, in document order."""
    out = [node] if node.name == name else []
    return [*out, *(x for c in node.children for x in texts_below(c, name))]


def sheet_slots(parts: dict[str, bytes], pattern: re.Pattern | None = None) -> Iterator[Slot]:
    """Excel: shared strings, cells, formulas, headers and footers, comments, other texts and attributes.

    A protected sheet is scan-only, and so are the comments of all parts behind one in the package's order; a header is
    scan-only where a keyword hits the name of a font in it."""
    items = [n for n in nodes_of(parts["xl/sharedStrings.xml"]) if n.name == "si"] if "xl/sharedStrings.xml" in parts else []
    shared = ["".join(t.text for t in texts_below(si)) for si in items]
    for i, text in enumerate(shared):
        yield slot("xl/sharedStrings.xml", str(i), SHEET["shared"], text, False)
    closed: set[str] = set()
    for part, payload in parts.items():
        if not part.endswith(".xml"):
            continue
        nodes = nodes_of(payload)
        root = nodes[0]
        paths = paths_of(nodes)
        if any(c.name == "sheetProtection" for c in root.children):
            closed.add(part)
        if any(c.name == "workbookProtection" for c in root.children):
            yield note("the workbook's structure is protected", "veto")
        if re.fullmatch(r"xl/worksheets/[^/]+\.xml", part):
            for n in nodes:
                if n.ns == S and n.name == "c":
                    v, f = (next((c for c in n.children if c.name == x), None) for x in ("v", "f"))
                    kind, ref, value = n.attrs.get("t"), n.attrs.get("r", ""), ""
                    if kind == "s" and v is not None:
                        if not v.text.strip().isdigit() or int(v.text) >= len(shared):
                            raise PackageError("no such shared string")
                        value = shared[int(v.text)]
                    elif kind == "inlineStr":
                        value = "".join(t.text for t in texts_below(n))
                    elif kind == "str" and v is not None:
                        value = v.text
                    yield slot(part, f"cell:{ref}", SHEET["cell" if f is None else "result"], value, f is None and part not in closed, f"{part} · {ref}")
                    if f is not None:
                        yield slot(part, f"formula:{ref}", SHEET["formula"], f.text, False, f"{part} · {ref}")
                elif n.name in HEADERS:
                    hit = pattern is not None and any(pattern.search(x) for x in re.findall(r'&"[^"]*"', n.text))
                    yield slot(part, f"{paths[id(n)]}/text", SHEET["header"], n.text, part not in closed and not hit)
        elif part.startswith("xl/comments"):
            for n in nodes:
                if n.ns == S and n.name == "comment":
                    yield slot(part, paths[id(n)], SHEET["comment"], "".join(t.text for t in texts_below(n)), not closed, f"{part} · {n.attrs.get('ref', '')}")
        elif part != "xl/sharedStrings.xml":
            for n in nodes:
                ok = not protected(part, n) and (part.startswith("docProps/") or (n.ns, n.name) == (A, "t"))
                yield slot(part, f"{paths[id(n)]}/text", SHEET["other"], n.text, ok)
                for k, v in n.attrs.items():
                    yield slot(part, f"{paths[id(n)]}/@{clark(k)}", SHEET["attribute"], v, False)


def package_slots(raw: bytes, kind: str, pattern: re.Pattern | None) -> Iterator[Slot]:
    parts = dict(read_parts(raw))
    if dict(MAIN)[kind] not in parts or not {"[Content_Types].xml", "_rels/.rels"} <= set(parts):
        raise PackageError("required parts are missing")
    yield from sheet_slots(parts, pattern) if kind == "Excel" else office_slots(parts)
    media = sum(p.startswith(("ppt/media/", "word/media/", "xl/media/")) for p in parts)
    embedded = sum(p.startswith(("ppt/embeddings/", "word/embeddings/", "xl/embeddings/", "ppt/activeX/", "word/activeX/")) for p in parts)
    if media:
        yield note(f"{media} pictures are not read")
    if embedded:
        yield note(f"{embedded} embedded objects are not read")
    if any(p.startswith("_xmlsignatures/") for p in parts):
        yield note("signed", "veto")
    if "word/settings.xml" in parts and flag(nodes_of(parts["word/settings.xml"]), "documentProtection", "enforcement"):
        yield note("protected against editing", "veto")


def pdf_slots(raw: bytes) -> Iterator[Slot]:
    """Text-show operators, properties, XMP and annotations; pages without a text are notes."""
    if not raw.startswith(b"%PDF-"):
        raise PackageError("no PDF file")
    objs = pdf.objects(raw)
    open_ = not pdf.protected(raw, objs)
    if not open_:
        yield note("encrypted, signed or labelled", "veto")
    for n, page in enumerate(pdf.pages_of(objs), 1):
        items = list(pdf.page_items(page, objs))
        for idx, _, text, safe, _ in items:
            yield slot(f"page:{n}", str(idx), PDF["item"], text, open_ and safe, f"PDF 第 {n} 頁 · 文字區塊 {idx + 1}")
        if not any(x[2].strip() for x in items):
            yield note(f"page {n} has no text that can be read")
        for j, key, text in pdf.annotations_of(page, objs):
            yield slot(f"page:{n}", f"annot:{j}:/{key}", PDF["annotation"], text, False)
    for key, text in pdf.properties_of(raw, objs).items():
        yield slot("metadata", f"/{key}", PDF["property"], text, open_ and key in PDF_PROPERTIES, f"PDF 屬性 · /{key}")
    for text in pdf.xmp_of(objs):
        yield slot("metadata", "XMP", PDF["xmp"], text, False)
    yield note("pictures, forms and attachments of PDF files are not read")


def mail_slots(raw: bytes, pattern: re.Pattern | None, depth: int, budget: list[int]) -> Iterator[Slot]:
    """The subject, text lines, HTML blocks and attributes, and attachments within their limits."""
    msg = mail.message(raw)
    open_ = not mail.sealed(msg)
    if not open_:
        yield note("signed, encrypted or with a message inside", "veto")
    yield slot("headers", "Subject", MAIL["subject"], str(msg.get("Subject", "")), open_)
    for path, part, attached in mail.walk(msg):
        kind, filename = part.get_content_type(), part.get_filename()
        if attached:
            payload = part.get_payload(decode=True)
            suffix = "." + filename.rpartition(".")[2].lower() if filename and "." in filename else ""
            yield slot("attachment", path, MAIL["attachment"], filename, False)
            fit = payload and suffix in files.SUFFIXES and suffix not in files.LEGACY_SUFFIXES and depth < mail.MAX_DEPTH and len(payload) <= mail.MAX_ATTACHMENT
            if not fit or budget[0] + len(payload) > mail.MAX_ATTACHMENTS:
                yield note(f"attachment {filename} is not read: format, size or depth")
                continue
            budget[0] += len(payload)
            for kind, p, q, category, text, _, place, outer, names in slots_of_bytes(payload, suffix, pattern, depth + 1, budget):
                if kind == "slot":
                    yield kind, p, q, category, text, False, place, f"{path}|{outer}".strip("|"), f"{filename}\x1f{names}".strip("\x1f")
                elif kind != "veto":
                    yield note(f"attachment {filename}: {text}")
        elif kind == "text/plain":
            for i, line in enumerate(part.get_content().splitlines(keepends=True)):
                yield slot(f"email:{path}", str(i), MAIL["line"], line, open_, f"郵件正文 · 第 {i + 1} 行")
        elif kind == "text/html":
            blocks: dict[int, list[str]] = {}
            for n, (block, _, what, name, text) in enumerate(html.slots(part.get_content())):
                if what == "text":
                    blocks.setdefault(block, []).append(text)
                else:
                    yield slot(f"html:{path}", f"{block}/@{name}" if what == "attribute" else f"{n}/text", MAIL[what], text, False)
            for block, texts in blocks.items():
                yield slot(f"html:{path}", str(block), MAIL["block"], "".join(texts), open_, "郵件 HTML 正文")
    yield note("pictures of mails are not read")


def text_slots(raw: bytes, suffix: str) -> Iterator[Slot]:
    text, _ = files.decode_bytes(raw)
    if text is None:
        raise PackageError("no known encoding")
    for i, line in enumerate(text.splitlines(keepends=True), 1):
        yield slot("text", str(i), scan.LINE_CATEGORY, line, suffix not in files.SCAN_ONLY, f"第 {i} 行")


def slots_of_bytes(raw: bytes, suffix: str, pattern: re.Pattern | None = None, depth: int = 0, budget: list[int] | None = None) -> Iterator[Slot]:
    """The slots of one file; errors are rows. pattern: the keywords, which headers of sheets need."""
    try:
        if suffix in PACKAGES:
            yield from package_slots(raw, PACKAGES[suffix], pattern)
        elif suffix == ".pdf":
            yield from pdf_slots(raw)
        elif suffix == ".eml":
            yield from mail_slots(raw, pattern, depth, [0] if budget is None else budget)
        elif suffix in files.TEXT_SUFFIXES:
            yield from text_slots(raw, suffix)
        else:
            yield note("unsupported format", "error")
    except Exception as error:  # parsers meet files of any kind; one of them must not end the job
        yield note(problem_of(error), "error")


def slots_of(documents: DataFrame, words: Sequence[str]) -> DataFrame:
    """SLOTS_SCHEMA of ``documents`` (source, suffix, content)."""
    pattern = re.compile("|".join(map(re.escape, kw.longest_first(kw.normalize(list(words))))), re.I)

    def make(source: str, suffix: str, content: bytes | None) -> Iterator[tuple]:
        for row in slots_of_bytes(content or b"", suffix, pattern):
            yield source, *row

    return _map(documents.select("source", "suffix", "content"), SLOTS_SCHEMA, make)


def scan_documents(documents: DataFrame, words: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(findings, notes) of ``documents`` (source, suffix, content).

    findings: source, id, part, path, location, category, context, matches, cleanable, text. notes: source, kind (note,
    veto or error), text. Only slots with a keyword are kept."""
    slots = slots_of(documents, words)
    held = written(slots.where((F.col("kind") != "slot") | F.col("text").rlike(kw.spark_pattern(list(words)))), "slots")
    notes = held.where("kind <> 'slot'").select("source", "kind", "text")
    found = scan.findings(held.where("kind = 'slot'"), words, ["source", "place", "outer", "names"], F.col("part"), F.col("path"), F.col("category"), "text", F.col("cleanable"))
    paths = F.reverse(F.filter(F.split("outer", "\\|"), lambda p: p != ""))
    whole_id = F.aggregate(paths, F.col("id"), lambda done, p: F.substring(F.sha2(F.encode(F.concat(p, done), "utf-8"), 256), 1, 24))
    names = F.transform(F.filter(F.split("names", "\x1f"), lambda n: n != ""), lambda n: F.concat(F.lit("附件 "), n, F.lit(" · ")))
    placed = found.withColumns({"id": whole_id, "location": F.concat(F.array_join(names, ""), F.coalesce("place", "location"))})
    vetoed = notes.where("kind in ('veto', 'error')")
    return scan.veto(placed.drop("place", "outer", "names"), vetoed, "source"), notes


def report(findings: DataFrame, notes: DataFrame) -> DataFrame:
    """source, findings, match_count, status: partial where something was not looked into."""
    counted = findings.groupBy("source").agg(F.count("*").alias("findings"), F.sum(F.size("matches")).cast("long").alias("match_count"))
    noted = notes.groupBy("source").agg(F.bool_or(F.col("kind") == "error").alias("failed"), F.bool_or(F.col("kind") == "note").alias("partial"))
    both = counted.join(noted, "source", "full_outer")
    status = F.when(F.col("failed"), "failed").when(F.col("partial"), "partial").otherwise("completed")
    return both.select("source", F.coalesce("findings", F.lit(0)).alias("findings"), F.coalesce("match_count", F.lit(0)).alias("match_count"), status.alias("status"))
