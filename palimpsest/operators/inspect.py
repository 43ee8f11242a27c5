"""What a package holds and what speaks against editing or merging it: one row each, so that guards are filters."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

from palimpsest.functions.text import REVISION_NAMES
from palimpsest.operators.office import Node, Package, nodes_of
from palimpsest.sources.opc import A, PackageError, W, _map, problem_of, read_parts

FALSE = ("0", "false", "off")
LABEL_LIST = "labelList"
MERGE_BLOCKERS = ("xl/externalLinks/", "xl/pivotTables/", "xl/pivotCache/", "xl/model/")
STATS_SCHEMA = (
    "source string, kind string, slides int, hidden_slides int, notes_slides int, comment_parts int, masters int, layouts int, themes int, word_comments int, revisions int, tracking boolean, "
    "threaded_comments int, sheet_notes int, sheets int, hidden_sheets int, media int, embedded int, protected boolean, strict boolean, active_x boolean, external_links boolean, "
    "merge_blocked boolean, date1904 boolean, labels string, error string"
)

#: Attributes that hold names a user sees, by element and attribute (fixed values); namespace null: any.
EDITABLE = (
    (None, ("cNvPr", "docPr"), ("name", "descr", "title")),
    (A, ("theme", "clrScheme", "fontScheme", "fmtScheme"), ("name",)),
    (W, ("style",), ("styleId",)),
    (W, ("name", "link", "basedOn", "next", "pStyle", "rStyle", "tblStyle"), ("val",)),
    ("urn:schemas-microsoft-com:vml", ("shape", "rect", "oval", "roundrect"), ("id",)),
)


def editable_attribute(ns: str, name: str, attribute: str) -> bool:
    """Whether an attribute is a name that cleaning may change. Relationship attributes never are."""
    outer, _, own = attribute.rpartition("}")
    if "/relationships" in outer:
        return False
    return any((space is None or space == ns) and name in names and own in attributes for space, names, attributes in EDITABLE)


def header_is_editable(text: str, pattern: re.Pattern) -> bool:
    """A sheet's header or footer is not edited where a keyword hits the name of a font in it."""
    return not any(pattern.search(control) for control in re.findall(r'&"[^"]*"', text))


def labels_of(package: Package) -> list[str]:
    """Active sensitivity labels as sorted attributes; a record that is neither active nor history is an error."""
    parts = [t for n, t in package.links("") if t and n.attrs.get("Type", "").endswith("/classificationlabels")]
    known = {p for p in package.parts if p.lower().endswith("/labelinfo.xml")}
    if len(parts) > 1 or not known <= set(parts):
        raise PackageError("labels without a clear relationship")
    found = []
    for n in nodes_of(package.parts[parts[0]]) if parts else []:
        if n.name == LABEL_LIST:
            continue
        state = tuple(str(n.attrs.get(k, d)).lower() in ("1", "true") for k, d in (("enabled", ""), ("removed", "0")))
        if state == (False, True):
            continue
        if state != (True, False) or not n.attrs.get("id") or not n.attrs.get("siteId"):
            raise PackageError("label state that cannot be told")
        found.append("; ".join(f"{k}={v}" for k, v in sorted((n.attrs | {"enabled": "1", "removed": "0"}).items())))
    return sorted(found)


def flag(nodes: list[Node], name: str, attribute: str) -> bool:
    """An on/off element: absent is off, without a value is on."""
    one = next((n for n in nodes if n.name == name), None)
    return one is not None and next((v for k, v in one.attrs.items() if k.rpartition("}")[2] == attribute), "1").lower() not in FALSE


def inspected(source: str, raw: bytes) -> tuple:
    empty = (None,) * 24
    try:
        parts = dict(read_parts(raw))
        if any(n.startswith("_xmlsignatures/") for n in parts):
            return source, *empty, "signed"
        package = Package(raw)
        kind = next((k for k, p in (("Word", "word/document.xml"), ("PowerPoint", "ppt/presentation.xml"), ("Excel", "xl/workbook.xml")) if p in parts), "")
        count = lambda rule: sum(bool(re.fullmatch(rule, p)) for p in parts)
        nodes = {p: nodes_of(b) for p, b in parts.items() if p.endswith(".xml")}
        of = lambda prefix, name: sum(n.name == name for p, ns in nodes.items() if p.startswith(prefix) for n in ns)
        slides = [ns for p, ns in nodes.items() if re.fullmatch(r"ppt/slides/[^/]+\.xml", p)]
        sheets = [n for n in nodes.get("xl/workbook.xml", []) if n.name == "sheet"]
        settings, book = nodes.get("word/settings.xml", []), nodes.get("xl/workbook.xml", [])
        links = [n for p in parts if p.endswith(".rels") for n in nodes_of(parts[p]) if n.attrs.get("TargetMode") == "External"]
        root = nodes.get({"Word": "word/document.xml", "PowerPoint": "ppt/presentation.xml", "Excel": "xl/workbook.xml"}.get(kind, ""), [])
        return (
            source, kind, len(slides), sum(ns[0].attrs.get("show", "1").lower() in ("0", "false") for ns in slides), count(r"ppt/notesSlides/[^/]+\.xml"), count(r"ppt/comments/[^/]+\.xml"),
            count(r"ppt/slideMasters/[^/]+\.xml"), count(r"ppt/slideLayouts/[^/]+\.xml"), count(r"ppt/theme/[^/]+\.xml"), of("word/comments", "comment"),
            sum(n.name in REVISION_NAMES and (n.ns == W or n.ns.startswith("http://schemas.microsoft.com/office/word/")) for p, ns in nodes.items() if p.startswith("word/") for n in ns),
            flag(settings, "trackRevisions", "val"), of("xl/threadedComments/", "threadedComment"), of("xl/comments", "comment"), len(sheets), sum(n.attrs.get("state") in ("hidden", "veryHidden") for n in sheets),
            sum("/media/" in p for p in parts), sum("/embeddings/" in p or "/activeX/" in p for p in parts), flag(settings, "documentProtection", "enforcement") or any(n.name == "workbookProtection" for n in book),
            bool(root) and root[0].ns.startswith("http://purl.oclc.org/"), any("/activex/" in p.lower() for p in parts), any(not n.attrs.get("Type", "").endswith("/hyperlink") for n in links),
            any(p.startswith(MERGE_BLOCKERS) or p == "xl/connections.xml" for p in parts), any(n.name == "workbookPr" and n.attrs.get("date1904", "0") in ("1", "true") for n in book),
            " | ".join(labels_of(package)), None,
        )
    except Exception as error:  # parsers meet files of any kind
        return source, *empty, problem_of(error)


def stats_of(documents: DataFrame) -> DataFrame:
    """STATS_SCHEMA from source, content; a package that cannot be read has its error and nothing else."""

    def make(source: str, content: bytes) -> Iterator[tuple]:
        yield inspected(source, content or b"")

    return _map(documents.select("source", "content"), STATS_SCHEMA, make)


def merge_problems(stats: DataFrame) -> DataFrame:
    """source, problem: what keeps packages from being merged with the others of ``stats``, one row each."""
    from pyspark.sql import functions as F

    kinds = stats.where("error is null").groupBy("kind").agg(F.count_distinct("date1904").alias("systems"), F.count_distinct(F.when(F.col("labels") != "", F.col("labels"))).alias("label_sets"))
    joined = stats.join(kinds.withColumnRenamed("kind", "k"), F.col("kind") == F.col("k"), "left")
    problem = (
        F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("merge_blocked"), "external links, pivots, connections or a model").when(F.col("active_x"), "ActiveX")
        .when(F.col("external_links"), "external objects").when(F.col("strict"), "strict format").when(F.col("systems") > 1, "different date systems").when(F.col("label_sets") > 1, "different labels")
    )
    return joined.select("source", problem.alias("problem")).where("problem is not null")
