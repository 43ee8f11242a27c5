"""Edits of Office packages, one package a task: keyword cleaning, comment removal, template pruning.

XML is edited by byte spans: a parser gives each element's place in the part, and only the spans of edited texts,
values and removed elements are replaced. All else keeps its bytes, so formatting, formulas and unknown extensions
cannot change; what an edit may touch is decided here, and ``verify`` checks it again on the result.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict, deque
from collections.abc import Callable, Iterator
from xml.parsers import expat
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame

from palimpsest.functions.keywords import longest_first, normalize
from palimpsest.functions.text import REVISION_NAMES
from palimpsest.sources.opc import A, PackageError, RUNS, S, W, _map, problem_of, read_parts, write_package

START_TAG = re.compile(rb"<[^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*>")
#: Parts that pruning may delete (fixed values).
PRUNABLE = ("ppt/slideMasters/", "ppt/slideLayouts/", "ppt/theme/", "ppt/media/")
MAIN = (("Word", "word/document.xml"), ("PowerPoint", "ppt/presentation.xml"), ("Excel", "xl/workbook.xml"))
COMMENT_KINDS = ("comments", "commentsextended", "commentsids", "commentsextensible")
ANCHORS = ("commentReference", "commentRangeStart", "commentRangeEnd")
RESULT_SCHEMA = "source string, content binary, edits int, removed int, error string"


class Node:
    __slots__ = ("attrs", "begin", "children", "close", "end", "inner", "name", "ns", "parent", "prefix", "text")

    def __init__(self, ns: str, name: str, attrs: dict[str, str], begin: int, inner: int, parent: Node | None, prefix: str = ""):
        self.prefix = prefix
        self.ns, self.name, self.attrs, self.begin, self.inner, self.parent = ns, name, attrs, begin, inner, parent
        self.close = self.end = inner
        self.text, self.children = "", []

    def up(self) -> Iterator[Node]:
        node: Node | None = self
        while node is not None:
            yield node
            node = node.parent


def named(tag: str) -> tuple[str, str, str]:
    """(namespace, local name, prefix) of a parser's name."""
    parts = tag.split("}")
    return ("", parts[0], "") if len(parts) == 1 else (parts[0], parts[1], parts[2] if len(parts) > 2 else "")


def nodes_of(payload: bytes) -> list[Node]:
    """Elements in document order, with their places in ``payload``."""
    if b"<!DOCTYPE" in payload.upper() or payload[:2] in (b"\xff\xfe", b"\xfe\xff"):
        raise PackageError("document type or encoding that is not edited")
    found: list[Node] = []
    stack: list[Node] = []
    parser = expat.ParserCreate(namespace_separator="}")
    parser.namespace_prefixes = True

    def start(tag: str, attrs: dict[str, str]) -> None:
        ns, name, prefix = named(tag)
        at = parser.CurrentByteIndex
        own = {(f"{space}}}{local}" if space else local): v for (space, local, _), v in zip(map(named, attrs), attrs.values(), strict=True)}
        node = Node(ns, name, own, at, START_TAG.match(payload, at).end(), stack[-1] if stack else None, prefix)
        if stack:
            stack[-1].children.append(node)
        found.append(node)
        stack.append(node)

    def end(_: str) -> None:
        node, at = stack.pop(), parser.CurrentByteIndex
        if payload[node.inner - 2 : node.inner] != b"/>":
            node.close, node.end = at, payload.index(b">", at) + 1

    def data(text: str) -> None:
        if not stack[-1].children:
            stack[-1].text += text

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, data
    try:
        parser.Parse(payload, True)
    except expat.ExpatError as error:
        raise PackageError("malformed XML") from error
    return found


def applied(payload: bytes, edits: list[tuple[int, int, bytes]]) -> bytes:
    """``payload`` with spans replaced; a span inside a replaced one is dropped."""
    out, at = [], 0
    for a, b, new in sorted(edits, key=lambda e: (e[0], -e[1])):
        if a >= at:
            out += [payload[at:a], new]
            at = b
    return b"".join([*out, payload[at:]])


def clipped(texts: list[str], pattern: re.Pattern, block: bool) -> list[str]:
    """Runs of one paragraph without what matches in their joined text; in block mode without anything."""
    whole = "".join(texts)
    spans = [m.span() for m in pattern.finditer(whole)]
    if not spans:
        return texts
    if block:
        return [""] * len(texts)
    keep = bytearray(b"\1") * len(whole)
    for a, b in spans:
        keep[a:b] = bytes(b - a)
    out, at = [], 0
    for t in texts:
        out.append("".join(c for c, k in zip(t, keep[at : at + len(t)], strict=True) if k))
        at += len(t)
    return out


def pattern_of(words: list[str]) -> re.Pattern:
    return re.compile("|".join(map(re.escape, longest_first(normalize(words)))), re.I)


class Package:
    """Parts by name, with the relationships between them."""

    def __init__(self, raw: bytes):
        self.parts = dict(read_parts(raw))
        self.edits = self.removed = 0
        if any(n.startswith("_xmlsignatures/") for n in self.parts):
            raise PackageError("signed")

    def raw(self) -> bytes:
        return write_package(list(self.parts.items()))

    def edit(self, part: str, edits: list[tuple[int, int, bytes]]) -> None:
        if edits:
            self.parts[part] = applied(self.parts[part], edits)
            self.edits += len(edits)

    # relationships ---------------------------------------------------------------------------------------------------

    @staticmethod
    def rels_name(part: str) -> str:
        folder, _, name = part.rpartition("/")
        return f"{folder}/_rels/{name}.rels".lstrip("/")

    def links(self, part: str) -> list[tuple[Node, str | None]]:
        """Relationships of a part with their targets (null: outside the package)."""
        from urllib.parse import unquote

        name = self.rels_name(part)
        if name not in self.parts:
            return []
        out = []
        for n in nodes_of(self.parts[name]):
            if n.name != "Relationship":
                continue
            target = unquote(n.attrs.get("Target", "").partition("#")[0])
            steps: list[str] = []
            for step in (target if target.startswith("/") else f"{part.rpartition('/')[0]}/{target}").split("/"):
                if step == "..":
                    if not steps:
                        raise PackageError("target outside the package")
                    steps.pop()
                elif step not in ("", "."):
                    steps.append(step)
            out.append((n, None if n.attrs.get("TargetMode") == "External" else "/".join(steps)))
        return out

    def of_kind(self, part: str, kind: str) -> list[str]:
        return [t for n, t in self.links(part) if t and n.attrs.get("Type", "").endswith("/" + kind)]

    def reach(self, roots: set[str]) -> set[str]:
        seen, todo = set(), deque(roots)
        while todo:
            part = todo.popleft()
            if part not in seen:
                if part and part not in self.parts:
                    raise PackageError(f"missing part {part}")
                seen.add(part)
                todo.extend(t for _, t in self.links(part) if t)
        return seen

    def content_types(self) -> dict[str, str]:
        kinds = {n.attrs["PartName"].lstrip("/"): n.attrs["ContentType"] for n in nodes_of(self.parts["[Content_Types].xml"]) if n.name == "Override"}
        return {p: kinds[p] for p in self.parts if p in kinds}

    def delete(self, parts: set[str]) -> None:
        """Takes parts out, with their relationships, their content types and the links to them."""
        for name in [n for n in self.parts if n.endswith(".rels")]:
            folder, _, leaf = name.rpartition("/")
            owner = f"{folder.removesuffix('_rels').rstrip('/')}/{leaf.removesuffix('.rels')}".lstrip("/")
            if owner not in parts:
                self.edit(name, [(n.begin, n.end, b"") for n, t in self.links(owner) if t in parts])
        for part in parts:
            self.removed += self.parts.pop(part, None) is not None
            self.parts.pop(self.rels_name(part), None)
        types = "[Content_Types].xml"
        self.edit(types, [(n.begin, n.end, b"") for n in nodes_of(self.parts[types]) if n.attrs.get("PartName", "").lstrip("/") in parts])

    def drop(self, seeds: set[str]) -> None:
        """Deletes parts and what only they lead to; what others share stays."""
        if not seeds:
            return
        candidates = self.reach(seeds)
        before = dict(self.parts)
        self.delete(seeds)
        rest = (candidates - self.reach({""})) - seeds
        if any(p.startswith(("customXml/", "_xmlsignatures/")) or "labelinfo" in p.lower() for p in rest):
            self.parts = before
            raise PackageError("a protected part would go")
        self.delete(rest)

    def main(self) -> tuple[str, str]:
        """(kind, main part)."""
        return next(((k, p) for k, p in MAIN if p in self.parts), ("", ""))

    def refuse_unfit(self) -> None:
        """Strict formats, ActiveX and external objects are not edited."""
        kind, main = self.main()
        root = nodes_of(self.parts[main])[0] if kind else None
        if root is None or root.ns.startswith("http://purl.oclc.org/"):
            raise PackageError("strict or unknown format")
        if any("/activex/" in p.lower() for p in self.parts):
            raise PackageError("ActiveX")
        links = [n for p in self.parts if p.endswith(".rels") for n in nodes_of(self.parts[p])]
        if any(n.attrs.get("TargetMode") == "External" and not n.attrs.get("Type", "").endswith("/hyperlink") for n in links):
            raise PackageError("external objects")

    # edits -----------------------------------------------------------------------------------------------------------

    def clean_texts(self, pattern: re.Pattern, block: bool) -> None:
        """Paragraph texts of Word and PowerPoint parts, and document properties. Fields and protected nodes stay."""
        for part in [p for p in self.parts if p.startswith(("word/", "ppt/", "docProps/")) and p.endswith(".xml")]:
            payload, runs, edits = self.parts[part], defaultdict(list), []
            for n in nodes_of(payload):
                if not n.text or any("mip_label_" in v.lower() or "msip_label_" in v.lower() for a in n.up() for v in a.attrs.values()):
                    continue
                if n.ns in (W, A) and n.name in RUNS:
                    if n.name != "instrText":
                        paragraph = next((a for a in n.up() if (a.ns, a.name) == (n.ns, "p")), n)
                        runs[id(paragraph), n.name].append(n)
                elif part.startswith("docProps/") and not n.children and pattern.search(n.text) and not re.search("msip|sensitivity|label", (n.parent or n).attrs.get("name", ""), re.I):
                    edits.append((n.inner, n.close, escape(pattern.sub("", n.text)).encode()))
            for own in runs.values():
                for n, new in zip(own, clipped([n.text for n in own], pattern, block), strict=True):
                    if new != n.text:
                        edits.append((n.inner, n.close, escape(new).encode()))
            self.edit(part, edits)

    def clean_sheets(self, pattern: re.Pattern, block: bool, refs: set[tuple[str, str]] | None = None) -> None:
        """Cells (of ``refs``: part and name, or all) that match get their own text; shared strings stay for the others,
        and are emptied where no cell is left that uses them. Formulas and protected sheets stay."""
        name = "xl/sharedStrings.xml"
        shared = [["".join(t.text for t in _below(si, "t")), si] for si in nodes_of(self.parts[name]) if si.name == "si"] if name in self.parts else []
        touched, used = set(), set()
        for part in [p for p in self.parts if re.fullmatch(r"xl/worksheets/[^/]+\.xml", p)]:
            nodes, edits = nodes_of(self.parts[part]), []
            closed = any(n.name == "sheetProtection" for n in nodes)
            for c in (n for n in nodes if n.ns == S and n.name == "c"):
                v, kind = next((k for k in c.children if k.name == "v"), None), c.attrs.get("t")
                index = int(v.text) if kind == "s" and v is not None and v.text.strip().isdigit() else None
                if kind == "s" and v is not None and (index is None or index >= len(shared)):
                    raise PackageError("no such shared string")
                texts = [shared[index][0]] if index is not None else [t.text for t in _below(c, "t")] if kind == "inlineStr" else [v.text] if kind == "str" and v is not None else []
                formula = any(k.name == "f" for k in c.children)
                wanted = refs is None or (part, c.attrs.get("r", "")) in refs
                if closed or formula or not wanted or not pattern.search("".join(texts)):
                    used.add(index)
                    continue
                touched.add(index)
                new = "".join(clipped(["".join(texts)], pattern, block))
                attrs = "".join(f' {k}="{escape(x, {chr(34): "&quot;"})}"' for k, x in c.attrs.items() if k != "t")
                edits.append((c.begin, c.end, f'<c{attrs} t="inlineStr"><is><t xml:space="preserve">{escape(new)}</t></is></c>'.encode()))
            self.edit(part, edits)
        unused = (touched - used) - {None}
        if unused:
            self.edit(name, [(t.inner, t.close, b"") for i in unused for t in _below(shared[i][1], "t") if t.close > t.inner])

    def remove_word_comments(self) -> None:
        """Comment parts and anchors go; people stay only if a revision names them; revisions stay."""
        kinds = {p: t.rsplit(".", 1)[-1].partition("+")[0].lower() for p, t in self.content_types().items()}
        gone = {p for p, k in kinds.items() if p.startswith("word/") and k in COMMENT_KINDS}
        authors = set()
        for part in [p for p in self.parts if p.startswith("word/") and p.endswith(".xml") and p not in gone]:
            nodes = nodes_of(self.parts[part])
            authors |= {v for n in nodes if n.name in REVISION_NAMES for k, v in n.attrs.items() if k.endswith("}author")}
            self.edit(part, [(n.begin, n.end, b"") for n in nodes if n.ns == W and n.name in ANCHORS])
        for part in [p for p, k in kinds.items() if k == "people" and p in self.parts]:
            people = [n for n in nodes_of(self.parts[part]) if n.name == "person"]
            strangers = [n for n in people if not any(k.endswith("author") and v in authors for k, v in n.attrs.items())]
            if len(strangers) == len(people):
                gone.add(part)
            else:
                self.edit(part, [(n.begin, n.end, b"") for n in strangers])
        self.drop(gone)

    def prune_template(self) -> None:
        """Masters and layouts that no slide uses go, with what only they lead to."""
        deck = "ppt/presentation.xml"
        slides = self.of_kind(deck, "slide")
        layouts = {x for s in slides for x in exactly_one(self.of_kind(s, "slideLayout"), s)}
        masters = {x for one in layouts for x in exactly_one(self.of_kind(one, "slideMaster"), one)}
        all_ = {p for p in self.parts if re.fullmatch(r"ppt/(?:slideMasters|slideLayouts)/[^/]+\.xml", p)}
        unused = all_ - layouts - masters
        if not slides or not unused:
            return
        candidates = self.reach(unused)
        for owner, entry in [(deck, "sldMasterId"), *((m, "sldLayoutId") for m in masters)]:
            ids = {n.attrs.get("Id") for n, t in self.links(owner) if t in unused}
            self.edit(owner, [(n.begin, n.end, b"") for n in nodes_of(self.parts[owner]) if n.name == entry and any(k.endswith("}id") and v in ids for k, v in n.attrs.items())])
            self.edit(self.rels_name(owner), [(n.begin, n.end, b"") for n, t in self.links(owner) if t in unused])
        live = self.reach({""})
        self.delete({p for p in candidates - live if p.startswith(PRUNABLE)})

    def remove_slide_annotations(self, notes: bool = True, comments: bool = True) -> None:
        """Speaker notes and comments (of either kind) of all slides, with the lists of their authors."""
        gone = set()
        for part in [p for p in self.parts if re.fullmatch(r"ppt/slides/[^/]+\.xml", p)]:
            for n, t in self.links(part):
                kind = n.attrs.get("Type", "").rpartition("/")[2]
                if t and ((notes and kind == "notesSlide") or (comments and kind.lower() == "comments")):
                    gone.add(t)
        if comments:
            gone.update(t for n, t in self.links("ppt/presentation.xml") if t and n.attrs.get("Type", "").rpartition("/")[2] in ("commentAuthors", "authors"))
        self.drop(gone)

    def remove_sheet_annotations(self, threaded: bool = True, notes: bool = True) -> None:
        """Threaded comments and notes of all sheets. A comment whose cell has a thread belongs to the thread; the boxes
        of removed ones go from the drawings, other shapes stay."""
        for sheet in [p for p in self.parts if re.fullmatch(r"xl/worksheets/[^/]+\.xml", p)]:
            of = {k: [t for n, t in self.links(sheet) if t and n.attrs.get("Type", "").lower().endswith("/" + k)] for k in ("threadedcomment", "comments", "vmldrawing")}
            threads = {n.attrs.get("ref") for t in of["threadedcomment"] for n in nodes_of(self.parts[t]) if n.name == "threadedComment"}
            gone = set(of["threadedcomment"]) if threaded else set()
            cells: set[str | None] = set()
            for part in of["comments"]:
                own = [n for n in nodes_of(self.parts[part]) if n.name == "comment"]
                out = [n for n in own if (threaded if n.attrs.get("ref") in threads else notes)]
                cells.update(n.attrs.get("ref") for n in out)
                if len(out) == len(own):
                    gone.add(part)
                else:
                    self.edit(part, [(n.begin, n.end, b"") for n in out])
            for part in of["vmldrawing"]:
                edits = []
                for n in nodes_of(self.parts[part]):
                    data = next((c for c in n.children if c.name == "ClientData" and c.attrs.get("ObjectType") == "Note"), None) if n.name == "shape" else None
                    if data is not None:
                        at = {c.name: c.text.strip() for c in data.children}
                        if at.get("Row", "").isdigit() and at.get("Column", "").isdigit() and a1(int(at["Row"]), int(at["Column"])) in cells:
                            edits.append((n.begin, n.end, b""))
                self.edit(part, edits)
            self.drop(gone)

    def problems(self) -> list[str]:
        """What makes the package invalid."""
        found = []
        for name in [n for n in self.parts if n.endswith(".rels")]:
            folder, _, leaf = name.rpartition("/")
            owner = f"{folder.removesuffix('_rels').rstrip('/')}/{leaf.removesuffix('.rels')}".lstrip("/")
            if owner and owner not in self.parts:
                found.append(f"relationships without a part: {name}")
            links = self.links(owner)
            found += [f"missing part: {t}" for _, t in links if t and t not in self.parts]
            found += [f"repeated id in {name}: {i}" for i, n in Counter(n.attrs.get("Id") for n, _ in links).items() if n > 1]
        types = nodes_of(self.parts["[Content_Types].xml"]) if "[Content_Types].xml" in self.parts else []
        found += [f"content type without a part: {n.attrs['PartName']}" for n in types if n.name == "Override" and n.attrs["PartName"].lstrip("/") not in self.parts]
        return found


def _below(node: Node, name: str) -> list[Node]:
    out, todo = [], [node]
    while todo:
        n = todo.pop()
        if n.name == name and n is not node:
            out.append(n)
        todo.extend(reversed(n.children))
    return out


def a1(row: int, column: int) -> str:
    name, column = "", column + 1
    while column:
        column, digit = divmod(column - 1, 26)
        name = chr(65 + digit) + name
    return f"{name}{row + 1}"


def exactly_one(found: list[str], owner: str) -> list[str]:
    if len(found) != 1:
        raise PackageError(f"not exactly one layout or master: {owner}")
    return found


def edit_packages(documents: DataFrame, work: Callable[[Package, str], None]) -> DataFrame:
    """RESULT_SCHEMA from source, content: a package whose edit fails or would leave it invalid is an error row and has
    no content."""

    def make(source: str, content: bytes) -> Iterator[tuple]:
        try:
            package = Package(content)
            media = {p: b for p, b in package.parts.items() if "/media/" in p or "/embeddings/" in p}
            work(package, source)
            bad = package.problems() + [f"media changed: {p}" for p, b in media.items() if package.parts.get(p, b) != b]
            if bad:
                raise PackageError("; ".join(bad))
            yield source, package.raw(), package.edits, package.removed, None
        except Exception as error:  # parsers meet files of any kind; one of them must not end the job
            yield source, None, 0, 0, problem_of(error)

    return _map(documents.select("source", "content"), RESULT_SCHEMA, make)


def clean_packages(documents: DataFrame, words: list[str], block: bool = False, comments: bool = False, prune: bool = False) -> DataFrame:
    """Keyword cleaning of packages, with comments, notes and unused templates removed if asked for."""
    normalize(words)

    def work(package: Package, source: str) -> None:
        pattern = pattern_of(words)
        package.refuse_unfit()
        if any(n.name == "documentProtection" and n.attrs.get(f"{W}}}enforcement", "1").lower() not in ("0", "false", "off") for n in nodes_of(package.parts.get("word/settings.xml", b"<a/>"))):
            raise PackageError("protected against editing")
        if any(n.name == "workbookProtection" for n in nodes_of(package.parts.get("xl/workbook.xml", b"<a/>"))):
            raise PackageError("protected against editing")
        package.clean_texts(pattern, block)
        package.clean_sheets(pattern, block)
        if comments and "word/document.xml" in package.parts:
            package.remove_word_comments()
        if comments and "ppt/presentation.xml" in package.parts:
            package.remove_slide_annotations()
        if comments and "xl/workbook.xml" in package.parts:
            package.remove_sheet_annotations()
        if prune and "ppt/presentation.xml" in package.parts:
            package.prune_template()

    return edit_packages(documents, work)
