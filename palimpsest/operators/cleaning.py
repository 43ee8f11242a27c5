"""Cleaning of selected findings, in files of all formats: checked before, verified after, scanned again.

A selection names findings by source and id. A file is refused, as an error row, if an id is unknown or scan-only, if it
changed since its scan, or if anything but what was selected would differ afterwards. Names are changed with all that
refers to them: a style's id with its references, a theme's name with the document's properties, a shape's id with the
places that link to it.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator, Sequence
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import keywords as kw
from palimpsest.operators import slots as sl
from palimpsest.operators.inspect import editable_attribute, labels_of
from palimpsest.operators.office import Node, Package, clipped, nodes_of
from palimpsest.sources import documents as files
from palimpsest.sources import mail, pdf
from palimpsest.sources.opc import RUNS, A, PackageError, S, W, _map, problem_of

RESULT_SCHEMA = "source string, name string, content binary, digest string, changes int, matches_left int, error string"
VML = "urn:schemas-microsoft-com:vml"
ATTRIBUTE = re.compile(rb"""([^\s=<>/"']+)\s*=\s*("[^"]*"|'[^']*')""")

Chosen = list[tuple[str, str, str, str]]  # part, path, category, text


def short_digest(text: str, digits: int) -> str:
    return hashlib.sha256(text.encode()).hexdigest()[:digits]


def finding_id(part: str, path: str, category: str, text: str) -> str:
    return short_digest(json.dumps([part, path, category, text], ensure_ascii=False), 24)


def value_spans(payload: bytes, node: Node) -> dict[str, tuple[int, int]]:
    """Places of a start tag's attribute values by name, namespace declarations left out."""
    found = [m for m in ATTRIBUTE.finditer(payload, node.begin, node.inner) if not re.match(rb"xmlns(:|$)", m[1])]
    return {k: (m.start(2) + 1, m.end(2) - 1) for k, m in zip(node.attrs, found, strict=True)}


def quoted(text: str) -> bytes:
    return escape(text, {'"': "&quot;", "'": "&apos;"}).encode()


class OfficeCleaner:
    """The edits of one Word or PowerPoint package."""

    def __init__(self, package: Package, pattern: re.Pattern, block: bool, chosen: Chosen):
        self.package, self.pattern, self.block = package, pattern, block
        self.by_part: dict[str, list[tuple[str, str, str]]] = {}
        for part, path, category, text in chosen:
            self.by_part.setdefault(part, []).append((path, category, text))
        self.nodes = {p: nodes_of(b) for p, b in package.parts.items() if p.endswith(".xml") and not sl.protected_part(p)}
        self.at = {p: {path: n for n, path in zip(ns, map(sl.paths_of(ns).__getitem__, map(id, ns)), strict=True)} for p, ns in self.nodes.items() if p in self.by_part}
        self.style_ids = {n.attrs.get(f"{W}}}styleId", "") for n in self.nodes.get("word/styles.xml", []) if (n.ns, n.name) == (W, "style")} - {""}
        self.renamed, self.themes = self._renames()

    def _attributes(self) -> Iterator[tuple[str, str, Node, str, str]]:
        """(part, path, element, attribute, value) of the selected attributes."""
        for part, rows in self.by_part.items():
            for path, category, text in rows:
                if category == sl.OFFICE["attribute"]:
                    place, _, name = path.rpartition("/@")
                    node = self.at[part][place]
                    yield part, path, node, next(k for k in node.attrs if sl.clark(k) == name), text

    def _renames(self) -> tuple[dict[str, str], dict[str, str]]:
        """Old to new names of styles and shapes, and of themes."""
        renamed, themes = {}, {}
        for part, path, node, attribute, value in self._attributes():
            own = attribute.rpartition("}")[2]
            if part == "word/styles.xml" and own == "styleId" or part.startswith("word/") and attribute == f"{W}}}val" and value in self.style_ids:
                renamed[value] = f"CleanStyle_{short_digest(value, 12)}"
                if renamed[value] in self.style_ids:
                    raise PackageError("a neutral style name is taken")
            elif node.ns == VML and attribute == "id":
                renamed[value] = f"CleanShape_{short_digest(value, 12)}"
            elif node.name == "theme" and own == "name" and re.fullmatch(r"ppt/theme/[^/]+\.xml", part):
                themes[value] = self.pattern.sub("", value).strip() or f"CleanName_{short_digest(part + path, 10)}"
        return renamed, themes

    def _renamed(self, value: str) -> str | None:
        if value.startswith("#") and value[1:] in self.renamed:
            return "#" + self.renamed[value[1:]]
        return self.renamed.get(value)

    def run(self) -> None:
        before = {p: b for p, b in self.package.parts.items()}
        for part, nodes in self.nodes.items():
            payload, edits = self.package.parts[part], {}
            for path, category, _ in self.by_part.get(part, []):
                edits |= self._edits_of(part, path, category, nodes)
            if self.renamed:
                for n in nodes:
                    linked = {k: new for k, v in n.attrs.items() if (new := self._renamed(v)) is not None}
                    if linked and not sl.protected(part, n):
                        spans = value_spans(payload, n)
                        edits |= {spans[k]: quoted(new) for k, new in linked.items()}
            if part == "docProps/app.xml" and self.themes:
                edits |= {(n.inner, n.close): escape(self.themes[n.text]).encode() for n in nodes if not n.children and n.text in self.themes}
            self.package.edit(part, [(a, b, new) for (a, b), new in edits.items() if payload[a:b] != new])
        self._verify(before)

    def _edits_of(self, part: str, path: str, category: str, nodes: list[Node]) -> dict[tuple[int, int], bytes]:
        payload, at = self.package.parts[part], self.at[part]
        if category in (sl.OFFICE["text"], sl.OFFICE["deleted"]):
            kind = "deleted" if category == sl.OFFICE["deleted"] else "text"
            own = sl.paragraphs_of(nodes)[id(at[path.removesuffix("/deleted") if kind == "deleted" else path]), kind][1]
            return {(n.inner, n.close): escape(new).encode() for n, new in zip(own, clipped([n.text for n in own], self.pattern, self.block), strict=True) if new != n.text}
        if category == sl.OFFICE["attribute"]:
            place, _, name = path.rpartition("/@")
            node = at[place]
            attribute = next(k for k in node.attrs if sl.clark(k) == name)
            value = node.attrs[attribute]
            new = self._renamed(value) or self.pattern.sub("", value).strip() or f"CleanName_{short_digest(part + path, 10)}"
            return {value_spans(payload, node)[attribute]: quoted(new)}
        node = at[path.removesuffix("/text")]
        end = node.children[0].begin if node.children else node.close
        return {(node.inner, end): escape(self.themes.get(node.text, self.pattern.sub("", node.text))).encode()}

    def _verify(self, before: dict[str, bytes]) -> None:
        """Nothing but texts and names that may change differs, and every renamed style is there."""
        for part, payload in self.package.parts.items():
            if part.startswith(("word/", "ppt/")) and payload != before[part] and masked(payload) != masked(before[part]):
                raise PackageError(f"more than texts and names would change: {part}")
        styles = self.package.parts.get("word/styles.xml")
        there = {n.attrs.get(f"{W}}}styleId") for n in nodes_of(styles) if n.name == "style"} if styles else set()
        if any(v.startswith("CleanStyle_") and v not in there for v in self.renamed.values()):
            raise PackageError("a style's new name is missing")


def masked(payload: bytes) -> list[tuple]:
    """A part's elements with what cleaning may change left out: equal before and after."""
    out = []
    for n in nodes_of(payload):
        text = "" if n.ns in (W, A) and n.name in RUNS and n.name != "instrText" or n.name in ("text", "t") or not n.children else n.text.strip()
        attrs = tuple((k, "" if editable_attribute(n.ns, n.name, k) or v.lstrip("#").startswith("Clean") else v) for k, v in n.attrs.items())
        out.append((n.ns, n.name, text, attrs if n.ns != VML else tuple(k for k, _ in attrs)))
    return out


def clean_sheets(package: Package, pattern: re.Pattern, block: bool, chosen: Chosen) -> None:
    """Selected cells get a text of their own; comments, headers, footers and other texts are edited in place."""
    cells = {(part, path.removeprefix("cell:")) for part, path, _, _ in chosen if path.startswith("cell:")}
    before = dict(package.parts)
    for part in {p for p, path, _, _ in chosen if not path.startswith("cell:")}:
        payload = package.parts[part]
        nodes = nodes_of(payload)
        at = {path: n for n, path in zip(nodes, map(sl.paths_of(nodes).__getitem__, map(id, nodes)), strict=True)}
        edits = []
        for p, path, category, _ in chosen:
            if p != part or path.startswith("cell:"):
                continue
            if category == sl.SHEET["comment"]:
                own = sl.texts_below(at[path])
                edits += [(n.inner, n.close, escape(new).encode()) for n, new in zip(own, clipped([n.text for n in own], pattern, block), strict=True) if new != n.text]
            else:
                node = at[path.removesuffix("/text")]
                new = "" if block and category == sl.SHEET["other"] and node.ns == A else pattern.sub("", node.text)
                edits.append((node.inner, node.children[0].begin if node.children else node.close, escape(new).encode()))
        package.edit(part, edits)
    if cells:
        package.clean_sheets(pattern, block, cells)
    for part, payload in before.items():
        if re.fullmatch(r"xl/worksheets/[^/]+\.xml", part) and kept_cells(part, payload, cells) != kept_cells(part, package.parts[part], cells):
            raise PackageError(f"formulas or cells that were not selected would change: {part}")


def kept_cells(part: str, payload: bytes, cells: set[tuple[str, str]]) -> list[bytes]:
    """The bytes of the formulas, and of all cells but the selected ones."""
    return [payload[n.begin : n.end] for n in nodes_of(payload) if n.ns == S and (n.name == "f" or n.name == "c" and (part, n.attrs.get("r", "")) not in cells)]


def preserved(package: Package) -> tuple:
    """What cleaning must not touch: labels and their links, custom XML, protected properties, media."""
    parts = package.parts
    custom = nodes_of(parts["docProps/custom.xml"]) if "docProps/custom.xml" in parts else []
    marked = sorted((n.attrs.get("name", ""), n.text) for n in custom if sl.protected("docProps/custom.xml", n))
    kept = {p: b for p, b in parts.items() if "labelinfo" in p.lower() or p.startswith("customXml/") or "/media/" in p or "/embeddings/" in p}
    return kept, labels_of(package), marked


def clean_package(raw: bytes, kind: str, pattern: re.Pattern, block: bool, chosen: Chosen, prune: bool) -> bytes:
    package = Package(raw)
    package.refuse_unfit()
    before = preserved(package)
    if kind == "Excel":
        clean_sheets(package, pattern, block, chosen)
    else:
        OfficeCleaner(package, pattern, block, chosen).run()
    if preserved(package) != before:
        raise PackageError("labels, custom XML or media would change")
    if prune and kind == "PowerPoint":
        package.prune_template()
    if bad := package.problems():
        raise PackageError("; ".join(bad))
    out = package.raw()
    if Package(out).parts != package.parts:
        raise PackageError("the written package reads back otherwise")
    return out


def clean_mail(raw: bytes, pattern: re.Pattern, block: bool, chosen: Chosen) -> bytes:
    paths = {"Subject"} if any(part == "headers" for part, *_ in chosen) else set()
    places: dict[str, set[int]] = {}
    for part, path, _, _ in chosen:
        if part != "headers":
            places.setdefault(part.partition(":")[2], set()).add(int(path))
    return mail.clean(raw, pattern, paths | set(places), block, places)


def clean_pdf(raw: bytes, pattern: re.Pattern, chosen: Chosen) -> bytes:
    items = {(int(part.partition(":")[2]), int(path)) for part, path, _, _ in chosen if part.startswith("page:")}
    keys = {path.lstrip("/") for part, path, _, _ in chosen if part == "metadata"}
    out = pdf.clean(raw, pattern, items) if items else raw
    out = pdf.clean_properties(out, pattern, keys) if keys else out
    if pdf.boxes_of(pdf.objects(out)) != pdf.boxes_of(pdf.objects(raw)):
        raise PackageError("pages would change")
    return out


def clean_lines(raw: bytes, pattern: re.Pattern, block: bool, chosen: Chosen) -> bytes:
    text, encoding = files.decode_bytes(raw)
    lines = (text or "").splitlines(keepends=True)
    for _, path, _, line in chosen:
        mark = "\ufeff" if line.startswith("\ufeff") and path == "1" else ""
        end = "\r\n" if line.endswith("\r\n") else "\n" if line.endswith("\n") else ""
        lines[int(path) - 1] = mark + end if block else pattern.sub("", line)
    return "".join(lines).encode(encoding or "utf-8")


def check_mode(suffix: str, words: Sequence[str], block: bool) -> None:
    """Tables of text keep their rows and separators."""
    if suffix in (".csv", ".tsv"):
        if block:
            raise PackageError("no block mode for CSV and TSV")
        if any(c in w for w in words for c in ('"', "\r", "\n", "," if suffix == ".csv" else "\t")):
            raise PackageError("keywords with quotes, separators or line ends in CSV or TSV")


def matched(raw: bytes, suffix: str, pattern: re.Pattern) -> tuple[dict[str, tuple], list[str]]:
    """(findings by id: part, path, category, text, cleanable; vetoes and errors) of a file."""
    found, bad = {}, []
    for kind, part, path, category, text, ok, _, outer, _ in sl.slots_of_bytes(raw, suffix, pattern):
        if kind == "slot" and not outer and pattern.search(text):
            found[finding_id(part, path, category, text)] = (part, path, category, text, ok)
        elif kind in ("veto", "error"):
            bad.append(text)
    return found, bad


def clean_file(raw: bytes, suffix: str, words: Sequence[str], ids: Sequence[str] | None, block: bool = False, prune: bool = False) -> tuple[bytes, int, int]:
    """(cleaned bytes, findings cleaned, matches left). ids null: all that may be cleaned."""
    check_mode(suffix, words, block)
    pattern = re.compile("|".join(map(re.escape, kw.longest_first(kw.normalize(list(words))))), re.I)
    found, bad = matched(raw, suffix, pattern)
    if bad or suffix in files.SCAN_ONLY:
        raise PackageError("; ".join(bad) or "scan-only format")
    wanted = [i for i, x in found.items() if x[4]] if ids is None else list(dict.fromkeys(ids))
    if any(i not in found or not found[i][4] for i in wanted):
        raise PackageError("selected findings that are gone or scan-only")
    if not wanted and not (prune and suffix == ".pptx"):
        raise PackageError("nothing selected")
    chosen = [found[i][:4] for i in wanted]
    if suffix in sl.PACKAGES:
        out = clean_package(raw, sl.PACKAGES[suffix], pattern, block, chosen, prune)
    elif suffix == ".eml":
        out = clean_mail(raw, pattern, block, chosen)
    elif suffix == ".pdf":
        out = clean_pdf(raw, pattern, chosen)
    else:
        out = clean_lines(raw, pattern, block, chosen)
    after, bad = matched(out, suffix, pattern)
    if bad:
        raise PackageError(f"the cleaned file cannot be scanned: {'; '.join(bad)}")
    return out, len(chosen), sum(len(pattern.findall(x[3])) for x in after.values())


def clean_selected(documents: DataFrame, words: Sequence[str], selection: DataFrame | None = None, block: bool = False, prune: bool = False, digest: str | None = None) -> DataFrame:
    """RESULT_SCHEMA from ``documents`` (source, suffix, content).

    selection: source, id; sources without a selected id are not touched; null selects all that may be cleaned. digest: a
    column with the content's digest at its scan; a file that is another by now is refused."""
    kw.normalize(list(words))
    scanned = F.lit(None).cast("string") if digest is None else F.col(digest)
    wide = documents.select("source", "suffix", "content", scanned.alias("scanned"))
    if selection is None:
        wide = wide.withColumn("ids", F.lit(None).cast("array<string>"))
    else:
        wide = wide.join(selection.groupBy("source").agg(F.array_sort(F.collect_set("id")).alias("ids")), "source")

    def make(source: str, suffix: str, content: bytes | None, scanned: str | None, ids: list[str] | None) -> Iterator[tuple]:
        try:
            if scanned is not None and scanned != hashlib.sha256(content or b"").hexdigest():
                raise PackageError("changed since the scan")
            out, changes, left = clean_file(content or b"", suffix, words, ids, block, prune)
            stem, dot, end = source.rpartition(".")
            yield source, f"{stem}.cleaned{dot}{end}", out, hashlib.sha256(out).hexdigest(), changes, left, None
        except Exception as error:  # parsers meet files of any kind; one of them must not end the job
            yield source, None, None, None, 0, None, problem_of(error)

    return _map(wide.select("source", "suffix", "content", "scanned", "ids"), RESULT_SCHEMA, make)


def changed_parts(before: DataFrame, after: DataFrame) -> DataFrame:
    """source, part, change (modified or deleted) of packages' parts (source, part, payload)."""
    old = before.where("part is not null").select("source", "part", F.sha2("payload", 256).alias("was"))
    new = after.where("part is not null").select("source", "part", F.sha2("payload", 256).alias("now"))
    kept = new.select("source").distinct()
    joined = old.join(kept, "source", "left_semi").join(new, ["source", "part"], "left")
    change = F.when(F.col("now").isNull(), "deleted").when(F.col("now") != F.col("was"), "modified")
    return joined.select("source", "part", change.alias("change")).where("change is not null")

