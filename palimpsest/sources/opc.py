"""Office packages: ZIP parts, relationships, content types, XML nodes, text groups, cells.

Only parsing is Python; matching, joins and checks on the rows are DataFrame operations.
"""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_ENTRIES, MAX_BYTES = 25_000, 600 << 20
#: Bytes of the rows that are made before they go on.
BATCH_BYTES = 8 << 20
#: Namespaces (fixed values).
W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
A = "http://schemas.openxmlformats.org/drawingml/2006/main"
S = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
RELATIONSHIPS = "http://schemas.openxmlformats.org/package/2006/relationships"
RUNS = {"t": "text", "delText": "deleted", "instrText": "field"}

PARTS_SCHEMA = "source string, ord int, part string, payload binary, error string"
RELS_SCHEMA = "source string, owner string, rid string, type string, target string, external boolean, error string"
GROUPS_SCHEMA = "source string, part string, path string, kind string, ord int, text string, protected boolean, error string"
CELLS_SCHEMA = "source string, part string, ord int, ref string, kind string, value string, formula string, sheet_protected boolean, error string"


class PackageError(ValueError):
    """A package that is not read; becomes an error row."""


def problem_of(error: Exception) -> str:
    """An error row's message."""
    return str(error) if isinstance(error, PackageError) else f"{type(error).__name__}: {error}"


def read_parts(raw: bytes) -> list[tuple[str, bytes]]:
    """Parts in their order, behind the guards against bombs, duplicates, encryption and odd paths."""
    try:
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            entries = z.infolist()
            if len(entries) > MAX_ENTRIES or sum(e.file_size for e in entries) > MAX_BYTES:
                raise PackageError("too many entries or too large")
            if max(Counter(e.filename for e in entries).values(), default=1) > 1:
                raise PackageError("duplicate names")
            if any(e.flag_bits & 1 for e in entries):
                raise PackageError("encrypted")
            if any("\\" in e.filename or e.filename.startswith("/") or ".." in e.filename.split("/") for e in entries):
                raise PackageError("odd path")
            return [(e.filename, z.read(e)) for e in entries if not e.is_dir()]
    except (zipfile.BadZipFile, zipfile.LargeZipFile, OSError, RuntimeError, NotImplementedError) as error:
        raise PackageError("no readable package") from error


def write_package(parts: list[tuple[str, bytes]]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, allowZip64=True) as z:
        for name, payload in parts:
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            info.compress_type = zipfile.ZIP_DEFLATED
            z.writestr(info, payload)
    return out.getvalue()


def parse(payload: bytes) -> ET.Element:
    """XML without a document type, so without entities."""
    if b"<!DOCTYPE" in payload.upper():
        raise PackageError("document type in XML")
    try:
        return ET.fromstring(payload)
    except ET.ParseError as error:
        raise PackageError("malformed XML") from error


def split_tag(tag: str) -> tuple[str, str]:
    ns, _, name = tag.rpartition("}")
    return ns[1:], name


def paths_of(root: ET.Element) -> dict[ET.Element, str]:
    """Place of each element: names with a number among equal siblings; an element alone of its name has none."""
    out = {root: "/" + split_tag(root.tag)[1]}
    for parent in root.iter():
        counts, seen = Counter(c.tag for c in parent), Counter()
        for c in parent:
            if isinstance(c.tag, str):
                seen[c.tag] += 1
                out[c] = f"{out[parent]}/{split_tag(c.tag)[1]}" + (f"[{seen[c.tag]}]" if counts[c.tag] > 1 else "")
    return out


def labelled(element: ET.Element) -> bool:
    return any("msip_label_" in v.lower() or "mip_label_" in v.lower() for v in element.attrib.values())


def text_groups(part: str, payload: bytes) -> Iterator[tuple[str, str, int, str, bool]]:
    """(path, kind, ord, text, protected) of runs: grouped by paragraph and kind (text, deleted, field), other element
    texts ('other') and attributes ('attribute')."""
    root = parse(payload)
    paths, up = paths_of(root), {c: p for p in root.iter() for c in p}

    def above(e: ET.Element) -> Iterator[ET.Element]:
        while e is not None:
            yield e
            e = up.get(e)

    closed = part.startswith(("_xmlsignatures/", "customXml/")) or "labelinfo" in part.lower()
    for n, e in enumerate(root.iter()):
        ns, name = split_tag(e.tag)
        chain = list(above(e))
        protected = closed or any(map(labelled, chain)) or (part == "docProps/custom.xml" and any(re.search("msip|sensitivity|label", a.get("name", ""), re.I) for a in chain))
        if name in RUNS and ns in (W, A):
            if e.text:
                paragraph = next((a for a in chain[1:] if split_tag(a.tag) == (ns, "p")), e)
                yield paths[paragraph] + ("" if name == "t" else f"/{RUNS[name]}"), RUNS[name], n, e.text, protected
        elif e.text and e.text.strip():
            yield paths[e] + "/text", "other", n, e.text, protected
        for k, v in e.attrib.items():
            yield f"{paths[e]}/@{k}", "attribute", n, v, protected


def shared_strings(parts: dict[str, bytes]) -> list[str]:
    raw = parts.get("xl/sharedStrings.xml")
    return ["".join(t.text or "" for t in si.iter(f"{{{S}}}t")) for si in parse(raw)] if raw else []


def sheet_cells(payload: bytes, shared: list[str]) -> Iterator[tuple[int, str, str, str, str | None, bool]]:
    """(ord, ref, kind, value, formula, sheet_protected)."""
    root = parse(payload)
    protected = root.find(f"{{{S}}}sheetProtection") is not None
    for n, c in enumerate(root.iter(f"{{{S}}}c")):
        kind, v, f = c.get("t", "n"), c.find(f"{{{S}}}v"), c.find(f"{{{S}}}f")
        value = (v.text if v is not None else "") or ""
        if kind == "s":
            if not value.isdigit() or int(value) >= len(shared):
                raise PackageError("no such shared string")
            value = shared[int(value)]
        elif kind == "inlineStr":
            value = "".join(t.text or "" for t in c.iter(f"{{{S}}}t"))
        yield n, c.get("r", ""), kind, value, None if f is None else f.text or "", protected


def _map(df: DataFrame, schema: str, make: Callable[..., Iterator[tuple]]) -> DataFrame:
    """Rows made from each row of ``df``, in batches of bounded rows and bytes: one input row can make very many."""
    columns = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0

        def batch() -> pa.RecordBatch:
            return pa.record_batch([pa.array([r[k] for r in rows], kinds[k]) for k in range(len(columns))], names=columns)

        for b in batches:
            for i in range(b.num_rows):
                for r in make(*(c[i].as_py() for c in b.columns)):
                    rows.append(r)
                    size += sum(len(v) for v in r if isinstance(v, str | bytes))
                    if len(rows) >= 1024 or size >= BATCH_BYTES:
                        yield batch()
                        rows, size = [], 0
        if rows:
            yield batch()

    simple = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64()}
    kinds = [simple[c.strip().split(" ")[1]] for c in schema.split(",")]
    return df.mapInArrow(run, schema)


def parts_of(documents: DataFrame) -> DataFrame:
    """PARTS_SCHEMA from source, content: a package that cannot be read is one row with an error."""

    def make(source: str, content: bytes | None) -> Iterator[tuple]:
        try:
            for i, (name, payload) in enumerate(read_parts(content or b"")):
                yield source, i, name, payload, None
        except PackageError as error:
            yield source, None, None, None, str(error)

    return _map(documents.select("source", "content"), PARTS_SCHEMA, make)


def rels_of(parts: DataFrame) -> DataFrame:
    """RELS_SCHEMA; targets as written."""

    def make(source: str, part: str, payload: bytes) -> Iterator[tuple]:
        folder, _, name = part.rpartition("/")
        owner = (folder.removesuffix("_rels").rstrip("/") + "/" + name.removesuffix(".rels")).lstrip("/") if part != "_rels/.rels" else ""
        try:
            for e in parse(payload):
                yield source, owner, e.get("Id"), e.get("Type"), e.get("Target"), e.get("TargetMode") == "External", None
        except PackageError as error:
            yield source, owner, None, None, None, None, str(error)

    return _map(parts.where(F.col("part").endswith(".rels")).select("source", "part", "payload"), RELS_SCHEMA, make)


def groups_of(parts: DataFrame) -> DataFrame:
    """GROUPS_SCHEMA: one row a run; paragraphs are put together by ``paragraphs``."""

    def make(source: str, part: str, payload: bytes) -> Iterator[tuple]:
        try:
            for path, kind, n, text, protected in text_groups(part, payload):
                yield source, part, path, kind, n, text, protected, None
        except PackageError as error:
            yield source, part, None, None, None, None, None, str(error)

    return _map(parts.where(F.col("part").endswith(".xml")).select("source", "part", "payload"), GROUPS_SCHEMA, make)


def paragraphs(groups: DataFrame) -> DataFrame:
    """source, part, path, kind, text, protected: runs of a paragraph joined in their order."""
    runs = F.array_sort(F.collect_list(F.struct("ord", "text")))
    return groups.where("error is null").groupBy("source", "part", "path", "kind").agg(F.array_join(F.transform(runs, lambda r: r["text"]), "").alias("text"), F.bool_or("protected").alias("protected"))


def cells_of(documents: DataFrame) -> DataFrame:
    """CELLS_SCHEMA from source, content."""

    def make(source: str, content: bytes) -> Iterator[tuple]:
        try:
            parts = dict(read_parts(content or b""))
            shared = shared_strings(parts)
            for name, payload in parts.items():
                if re.fullmatch(r"xl/worksheets/[^/]+\.xml", name):
                    for row in sheet_cells(payload, shared):
                        yield source, name, *row, None
        except PackageError as error:
            yield source, *(None,) * 7, str(error)

    return _map(documents.select("source", "content"), CELLS_SCHEMA, make)


def packages(parts: DataFrame) -> DataFrame:
    """source, content: parts put back together, a package a task."""

    def build(pdf):
        import pandas as pd

        pdf = pdf.sort_values("ord")
        return pd.DataFrame({"source": [pdf["source"].iloc[0]], "content": [write_package(list(zip(pdf["part"], map(bytes, pdf["payload"]), strict=True)))]})

    return parts.select("source", "ord", "part", "payload").groupBy("source").applyInPandas(build, "source string, content binary")


def canonical(payload: bytes) -> str:
    return ET.canonicalize(payload.decode("utf-8"), strip_text=False)
