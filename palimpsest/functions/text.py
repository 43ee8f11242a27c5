"""Column functions of the scanner: lines, contexts, ids, locations, names and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What ends a line, with CR LF as one.
BREAKS = "\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029"
LINE = f"[^{BREAKS}]*(?:\\r\\n|[{BREAKS}])|[^{BREAKS}]+\\z"
BLANKS = "[\\s\\p{Z}\\x1c-\\x1f\\x85]+"
LONG, BEFORE, AFTER, CONTEXT = 500, 110, 350, 500


def split_lines(text: Column) -> Column:
    """Lines with their ends; an empty text has none."""
    return F.regexp_extract_all(text, F.lit(LINE), F.lit(0))


def squeezed(text: Column) -> Column:
    """White space as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, BLANKS, " "))


def excerpt(text: Column, first: Column) -> Column:
    """The text, or where it is long a window around place ``first`` (from 1)."""
    start = F.greatest(F.lit(1), first - BEFORE)
    return F.when(F.length(text) > LONG, F.substring(text, start, first + AFTER - start)).otherwise(text)


def context(text: Column, first: Column) -> Column:
    return F.substring(squeezed(excerpt(text, first)), 1, CONTEXT)


def json_text(text: Column) -> Column:
    return F.regexp_replace(F.to_json(F.array(text)), r"^\[|\]$", "")


def finding_id(part: Column, path: Column, category: Column, text: Column) -> Column:
    """24 hex digits of the digest of the JSON list of these four."""
    whole = F.concat(F.lit("["), json_text(part), F.lit(", "), json_text(path), F.lit(", "), json_text(category), F.lit(", "), json_text(text), F.lit("]"))
    return F.substring(F.sha2(F.encode(whole, "utf-8"), 256), 1, 24)


def location(part: Column) -> Column:
    """Where a part stands in a document, in words (fixed values); the first rule that fits."""
    base = F.substring_index(part, "/", -1)
    named = lambda label: F.concat(F.lit(label + " · "), base)
    return (
        F.when(part.rlike(r"^ppt/slides/slide\d+\.xml$"), F.concat(F.lit("投影片 "), F.regexp_extract(part, r"(\d+)\.xml$", 1)))
        .when(part.contains("slideMasters/"), named("母片"))
        .when(part.contains("slideLayouts/"), named("版面配置"))
        .when(part.startswith("word/footer"), named("頁尾"))
        .when(part.startswith("word/header"), named("頁首"))
        .when(part == "word/document.xml", F.lit("Word 正文／文字方塊"))
        .when(F.lower(part).contains("notes"), named("備忘稿／註腳"))
        .when(F.lower(part).contains("comment"), named("註解"))
        .when(part.startswith("docProps/"), named("文件屬性"))
        .when(part.contains("styles") | part.contains("numbering"), F.lit("樣式／編號設定"))
        .otherwise(part)
    )


def protected_part(part: Column) -> Column:
    """Parts that are never edited: signatures, label information, custom XML, relationships, content types."""
    return part.startswith("_xmlsignatures/") | F.lower(part).contains("labelinfo") | part.startswith("customXml/") | part.endswith(".rels") | (part == "[Content_Types].xml")


def family(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))
    return (
        F.when(suffix.isin(".pptx", ".ppt", ".pps"), "PowerPoint")
        .when(suffix.isin(".docx", ".doc", ".rtf"), "Word")
        .when(suffix.isin(".xlsx", ".xls"), "Excel")
    )


def rels_path(part: Column) -> Column:
    """The relationships part of a part; of '' the package's."""
    return F.concat(F.regexp_extract(part, r"^(.*/)?", 0), F.lit("_rels/"), F.substring_index(part, "/", -1), F.lit(".rels"))


def rels_owner(part: Column) -> Column:
    """The part that a relationships part belongs to; '' for the package."""
    return F.regexp_replace(F.regexp_replace(part, r"(^|/)_rels/([^/]*)\.rels$", "$1$2"), r"^/", "")


def resolve(owner: Column, target: Column) -> Column:
    """A relationship's target as a part name: decoded, without fragment, dots taken out; null where it leaves the package."""
    plain = F.url_decode(F.regexp_replace(F.substring_index(target, "#", 1), r"\+", "%2B"))
    folder = F.regexp_extract(owner, r"^(.*/)?", 0)
    joined = F.when(plain.startswith("/"), F.substring(plain, 2, 1 << 20)).otherwise(F.concat(folder, plain))
    steps = F.aggregate(
        F.split(joined, "/"),
        F.array().cast("array<string>"),
        lambda done, s: F.when((s == "") | (s == "."), done)
        .when((s == "..") & (F.size(done) > 0) & (F.coalesce(F.get(done, F.size(done) - 1), F.lit("")) != ".."), F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
        .otherwise(F.concat(done, F.array(s))),
    )
    return F.when(F.coalesce(F.get(steps, F.lit(0)), F.lit("")) != "..", F.array_join(steps, "/"))


def a1_reference(row: Column, column: Column) -> Column:
    """Row and column (both from 0) as a cell's name; null beyond 1048576 rows and 16384 columns."""
    letter = lambda c: F.chr(c + 65)
    c = column
    name = (
        F.when(c < 26, letter(c))
        .when(c < 702, F.concat(letter(F.floor(c / 26) - 1), letter(c % 26)))
        .otherwise(F.concat(letter(F.floor((c - 702) / 676)), letter(F.floor((c - 702) / 26) % 26), letter((c - 702) % 26)))
    )
    return F.when(row.between(0, 1_048_575) & c.between(0, 16_383), F.concat(name, (row + 1).cast("string")))


def store_id(value: Column) -> Column:
    """A UUID in any common spelling as 32 hex digits, or null."""
    plain = F.lower(F.regexp_replace(F.regexp_replace(F.lower(value), "^urn:uuid:", ""), r"[{}\-]", ""))
    return F.when(plain.rlike("^[0-9a-f]{32}$"), plain)


def natural_key(name: Column) -> Column:
    """Sorts digit runs by value and the rest by lower-case letters: runs are padded to 20 digits."""
    runs = F.regexp_extract_all(F.lower(name), F.lit(r"\d+|\D+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike(r"^\d"), F.lpad(r, 20, "0")).otherwise(r)), "")


def neutral_name(kind: str, value: Column, digits: int) -> Column:
    return F.concat(F.lit(f"Clean{kind}_"), F.substring(F.sha2(F.encode(value, "utf-8"), 256), 1, digits))


#: Word elements that record a tracked change (fixed values).
REVISION_NAMES = (
    "ins", "del", "delText", "delInstrText", "moveFrom", "moveTo", "moveFromRangeStart", "moveFromRangeEnd", "moveToRangeStart", "moveToRangeEnd", "conflictIns", "conflictDel",
    "customXmlInsRangeStart", "customXmlInsRangeEnd", "customXmlDelRangeStart", "customXmlDelRangeEnd", "customXmlMoveFromRangeStart", "customXmlMoveFromRangeEnd",
    "customXmlMoveToRangeStart", "customXmlMoveToRangeEnd", "customXmlConflictInsRangeStart", "customXmlConflictInsRangeEnd", "customXmlConflictDelRangeStart",
    "customXmlConflictDelRangeEnd", "pPrChange", "rPrChange", "sectPrChange", "tblPrChange", "tblPrExChange", "tblGridChange", "trPrChange", "tcPrChange",
    "numberingChange", "cellIns", "cellDel", "cellMerge",
)


def is_revision(local_name: Column) -> Column:
    return local_name.isin(*REVISION_NAMES)
