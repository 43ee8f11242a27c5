"""Custom XML stores of Word packages, known by their item id, not by their file's name: reading, comparing, attaching."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.office import Package, nodes_of
from palimpsest.sources.opc import RELATIONSHIPS, PackageError, W, _map, problem_of

DOCUMENT = "word/document.xml"
#: Names of the format (fixed values).
DATASTORE = "http://schemas.openxmlformats.org/officeDocument/2006/customXml"
OFFICE_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
DATA_REL, PROPERTIES_REL = f"{OFFICE_REL}/customXml", f"{OFFICE_REL}/customXmlProps"
BINDING_SPACES = (W, "http://schemas.microsoft.com/office/word/2012/wordml")
STORES_SCHEMA = "source string, id string, data string, properties string, data_type string, properties_type string, error string"


class Store(NamedTuple):
    data: bytes
    properties: bytes
    data_type: str
    properties_type: str

    def canonical(self) -> tuple[str, str, str, str]:
        """Equal for stores that differ in the spelling of their XML only."""
        return same_form(self.data), same_form(self.properties), self.data_type, self.properties_type


def same_form(payload: bytes) -> str:
    nodes_of(payload)  # refuses document types
    return ET.canonicalize(payload.decode("utf-8-sig"))


def store_id(value: str | None) -> str:
    plain = re.sub(r"[{}\-]", "", (value or "").lower().removeprefix("urn:uuid:"))
    if not re.fullmatch("[0-9a-f]{32}", plain):
        raise PackageError("a store without an id")
    return plain


def content_type(package: Package, part: str) -> str:
    nodes = nodes_of(package.parts["[Content_Types].xml"])
    for n in nodes:
        if n.name == "Override" and n.attrs.get("PartName", "").lstrip("/") == part:
            return n.attrs["ContentType"]
    for n in nodes:
        if n.name == "Default" and n.attrs.get("Extension", "").lower() == part.rpartition(".")[2].lower():
            return n.attrs["ContentType"]
    raise PackageError(f"no content type: {part}")


def links_to(package: Package, parts: set[str]) -> Counter:
    """(owner, type, target) of the relationships that lead to ``parts``, as often as they do."""
    owners = [""] + [p for p in package.parts if not p.endswith(".rels")]
    return Counter((o, n.attrs.get("Type"), t) for o in owners for n, t in package.links(o) if t in parts)


def stores_of(package: Package) -> dict[str, Store]:
    """Stores by id. Whatever lies in the folder must belong to one, with one part of properties, once."""
    own = {p for p in package.parts if p.startswith("customXml/")}
    found: dict[str, Store] = {}
    covered: set[str] = set()
    expected: Counter = Counter()
    for n, part in package.links(DOCUMENT) if own else []:
        if n.attrs.get("Type") != DATA_REL:
            continue
        below = package.links(part) if part in own else []
        if len(below) != 1 or below[0][0].attrs.get("Type") != PROPERTIES_REL or below[0][1] not in own or covered & {part, below[0][1]}:
            raise PackageError("a store without one part of properties of its own")
        properties = below[0][1]
        root = nodes_of(package.parts[properties])[0]
        if (root.ns, root.name) != (DATASTORE, "datastoreItem"):
            raise PackageError("a store without standard properties")
        key = store_id(root.attrs.get(f"{DATASTORE}}}itemID"))
        if key in found:
            raise PackageError("two stores of one id")
        found[key] = Store(package.parts[part], package.parts[properties], content_type(package, part), content_type(package, properties))
        covered |= {part, properties, package.rels_name(part)}
        expected.update([(DOCUMENT, DATA_REL, part), (part, PROPERTIES_REL, properties)])
    if covered != own or links_to(package, own) != expected:
        raise PackageError("parts or links of custom XML that belong to no store")
    return found


def bindings_of(package: Package, ids: set[str]) -> Counter:
    """Content controls bound to these stores: (element, attributes with the id in one spelling), as often as they occur."""
    found: Counter = Counter()
    for part, payload in package.parts.items():
        if ids and part.startswith("word/") and part.endswith(".xml"):
            for n in nodes_of(payload):
                if n.name == "dataBinding" and n.ns in BINDING_SPACES:
                    key = next((k for k in n.attrs if k.rpartition("}")[2] == "storeItemID"), None)
                    if key and store_id(n.attrs[key]) in ids:
                        found[n.ns, tuple(sorted((n.attrs | {key: store_id(n.attrs[key])}).items()))] += 1
    return found


def differing(expected: dict[str, Store], actual: dict[str, Store]) -> list[str]:
    """Ids that only one side has or that differ in more than the spelling of their XML."""
    return sorted(k for k in expected.keys() | actual.keys() if k not in expected or k not in actual or expected[k].canonical() != actual[k].canonical())


def merged(packages: list[Package]) -> dict[str, Store]:
    """The stores of all, in their order; one id with two contents is an error."""
    out: dict[str, Store] = {}
    for package in packages:
        for key, store in stores_of(package).items():
            if key in out and out[key].canonical() != store.canonical():
                raise PackageError("one store id with different data")
            out.setdefault(key, store)
    return out


def attach(package: Package, missing: list[Store]) -> None:
    """Adds stores under the first free numbers, with their relationships and content types."""
    main, types = package.rels_name(DOCUMENT), "[Content_Types].xml"
    if main not in package.parts:
        package.parts[main] = f'<Relationships xmlns="{RELATIONSHIPS}"></Relationships>'.encode()
    ids = {n.attrs.get("Id") for n, _ in package.links(DOCUMENT)}
    number = 0
    for store in missing:
        number = next(i for i in range(number + 1, len(package.parts) + number + 2) if f"rIdCustomXml{i}" not in ids and not {f"customXml/item{i}.xml", f"customXml/itemProps{i}.xml", f"customXml/_rels/item{i}.xml.rels"} & package.parts.keys())
        part, properties = f"customXml/item{number}.xml", f"customXml/itemProps{number}.xml"
        package.parts |= {
            part: store.data,
            properties: store.properties,
            package.rels_name(part): f'<Relationships xmlns="{RELATIONSHIPS}"><Relationship Id="rId1" Type="{PROPERTIES_REL}" Target="itemProps{number}.xml"/></Relationships>'.encode(),
        }
        append(package, main, f'<Relationship xmlns="{RELATIONSHIPS}" Id="rIdCustomXml{number}" Type="{DATA_REL}" Target="../{part}"/>')
        space = nodes_of(package.parts[types])[0].ns
        for name, kind in ((part, store.data_type), (properties, store.properties_type)):
            append(package, types, f'<Override xmlns="{space}" PartName="/{name}" ContentType="{kind}"/>')


def append(package: Package, part: str, element: str) -> None:
    """Puts an element at the end of a part's root."""
    payload = package.parts[part]
    root = nodes_of(payload)[0]
    if root.close == root.end:  # an empty element without an end tag
        tag = payload[root.begin : root.inner]
        name = re.match(rb"<([^\s/>]+)", tag)[1]
        package.edit(part, [(root.begin, root.inner, tag[:-2] + b">" + element.encode() + b"</" + name + b">")])
    else:
        package.edit(part, [(root.close, root.close, element.encode())])


def preserve_after_merge(package: Package, sources: list[Package]) -> list[str]:
    """Attaches to a merged package the stores that its sources had and it lost; their ids. What it changed is an error."""
    expected, actual = merged(sources), stores_of(package)
    if any(k not in expected or expected[k].canonical() != s.canonical() for k, s in actual.items()):
        raise PackageError("merging changed a store")
    wanted: Counter = sum((bindings_of(s, set(expected)) for s in sources), Counter())
    if bindings_of(package, set(expected)) != wanted:
        raise PackageError("merging changed bound content controls")
    lost = [k for k in expected if k not in actual]
    attach(package, [expected[k] for k in lost])
    if differing(expected, stores_of(package)):
        raise PackageError("stores are not preserved")
    return lost


def read_stores(documents: DataFrame) -> DataFrame:
    """STORES_SCHEMA from source, content: a row for each store, in one spelling of its XML; errors are rows."""

    def make(source: str, content: bytes | None) -> Iterator[tuple]:
        try:
            for key, store in stores_of(Package(content or b"")).items():
                yield source, key, *store.canonical(), None
        except Exception as error:  # parsers meet files of any kind
            yield source, *(None,) * 5, problem_of(error)

    return _map(documents.select("source", "content"), STORES_SCHEMA, make)


def store_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """source, id of stores that differ or that one side lacks; both of STORES_SCHEMA."""
    form = F.sha2(F.to_json(F.struct("data", "properties", "data_type", "properties_type")), 256)
    old, new = (d.where("error is null").select("source", "id", form.alias(name)) for d, name in ((before, "was"), (after, "now")))
    return old.join(new, ["source", "id"], "full_outer").where(~F.col("was").eqNullSafe(F.col("now"))).select("source", "id")
