"""Batches of Office files: prepare each, check what merging must keep, verify a merged file against its sources.

Merging itself needs desktop Office; here are the plan before it and the checks after it. A task is a row; its files are
edited one a task, and everything that compares files is a DataFrame operation on what was read from them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as tx
from palimpsest.operators import cleaning, inspect, merge, stores
from palimpsest.operators import slots as sl
from palimpsest.operators.office import Package, edit_packages, nodes_of
from palimpsest.sources.opc import A, PackageError, S, W, _map, problem_of

LAYOUT_SCHEMA = "source string, sheet_ord int, sheet string, state string, ord int, ref string, kind string, value string, error string"
NAMES_SCHEMA = "source string, kind string, name string, error string"
BODY_SCHEMA = "source string, body string, comments string, revisions int, tracking boolean, error string"
NOTES_SCHEMA = "source string, ord int, hidden boolean, notes string, comments string, error string"
#: Categories of a deck's titles that list themes (fixed values).
THEME_TITLES = ("themes", "theme", "佈景主題", "布景主題", "主题", "主題", "テーマ")


def rows_of(documents: DataFrame, schema: str, read) -> DataFrame:
    """Rows that ``read`` makes of each package; a package that cannot be read is one row with its error."""
    width = schema.count(",")

    def make(source: str, content: bytes | None) -> Iterator[tuple]:
        try:
            for row in read(Package(content or b"")):
                yield source, *row, None
        except Exception as error:  # parsers meet files of any kind
            yield source, *(None,) * (width - 1), problem_of(error)

    return _map(documents.select("source", "content"), schema, make)


# reading --------------------------------------------------------------------------------------------------------------


def sheets_of(package: Package) -> list[tuple[str, str, str]]:
    """(name, state, part) of a workbook's sheets in their order, by way of its relationships."""
    book = "xl/workbook.xml"
    links = {n.attrs.get("Id"): (n.attrs.get("Type", ""), t) for n, t in package.links(book)}
    out = []
    for n in nodes_of(package.parts[book]):
        if n.ns == S and n.name == "sheet":
            kind, part = links.get(next((v for k, v in n.attrs.items() if k.endswith("}id")), None), ("", None))
            if not kind.endswith("/worksheet") or part not in package.parts:
                raise PackageError("a sheet that is no worksheet")
            out.append((n.attrs.get("name", ""), n.attrs.get("state", "visible"), part))
    return out


def layout_of(package: Package) -> Iterator[tuple]:
    items = [n for n in nodes_of(package.parts["xl/sharedStrings.xml"]) if n.name == "si"] if "xl/sharedStrings.xml" in package.parts else []
    shared = ["".join(t.text for t in sl.texts_below(x)) for x in items]
    for i, (name, state, part) in enumerate(sheets_of(package)):
        yield i, name, state, -1, None, "sheet", None
        for j, c in enumerate(n for n in nodes_of(package.parts[part]) if n.ns == S and n.name == "c"):
            v, f = (next((x for x in c.children if x.name == k), None) for k in ("v", "f"))
            kind, value = c.attrs.get("t", "n"), None if v is None else v.text
            if f is not None:
                kind, value = "formula", str("#REF!" in f.text)
            elif kind == "s" and value is not None:
                if not value.strip().isdigit() or int(value) >= len(shared):
                    raise PackageError("no such shared string")
                kind, value = "text", shared[int(value)]
            elif kind == "inlineStr":
                kind, value = "text", "".join(t.text for t in sl.texts_below(c))
            if value is not None:
                yield i, name, state, j, c.attrs.get("r"), kind, value


def names_of(package: Package) -> Iterator[tuple]:
    for n in nodes_of(package.parts["xl/workbook.xml"]):
        if n.name == "definedName" and "localSheetId" not in n.attrs:
            yield "name", n.attrs.get("name", "").casefold()
    for part, payload in package.parts.items():
        if part.startswith("xl/tables/") and part.endswith(".xml"):
            yield "table", nodes_of(payload)[0].attrs.get("displayName", "").casefold()
        if part.startswith("xl/") and part.endswith(".xml") and re.search(rb"\b(?:INDIRECT|HYPERLINK)\s*\(", payload, re.I):
            yield "text reference", part


def body_of(package: Package) -> Iterator[tuple]:
    nodes = nodes_of(package.parts["word/document.xml"])
    body = next(n for n in nodes if (n.ns, n.name) == (W, "body"))
    texts = " ".join("".join(t.text for t in sl.texts_below(p) if t.ns == W) for p in sl.texts_below(body, "p") if p.ns == W)
    parts = [b for p, b in package.parts.items() if re.fullmatch(r"word/comments\d*\.xml", p)]
    comments = sorted("".join(t.text for t in sl.texts_below(c)) for b in parts for c in nodes_of(b) if (c.ns, c.name) == (W, "comment"))
    word = [n for p, b in package.parts.items() if p.startswith("word/") and p.endswith(".xml") for n in nodes_of(b)]
    marks = sum(n.name in tx.REVISION_NAMES and (n.ns == W or n.ns.startswith("http://schemas.microsoft.com/office/word/")) for n in word)
    settings = package.parts.get("word/settings.xml")
    yield " ".join(texts.split()), "\x1f".join(comments), marks, bool(settings) and inspect.flag(nodes_of(settings), "trackRevisions", "val")


def slides_of(package: Package) -> list[str]:
    """Slides in the order of the presentation's list, which its relationships resolve."""
    deck = "ppt/presentation.xml"
    links = {n.attrs.get("Id"): t for n, t in package.links(deck) if n.attrs.get("Type", "").endswith("/slide")}
    listed = [next((v for k, v in n.attrs.items() if k.endswith("}id")), None) for n in nodes_of(package.parts[deck]) if n.name == "sldId"]
    if any(links.get(i) not in package.parts for i in listed):
        raise PackageError("a slide that the list names is missing")
    return [links[i] for i in listed]


def notes_of(package: Package) -> Iterator[tuple]:
    for i, slide in enumerate(slides_of(package)):
        notes, comments = [], []
        for n, t in package.links(slide):
            kind = n.attrs.get("Type", "").rpartition("/")[2].lower()
            if t and kind == "notesslide":
                for shape in (x for x in nodes_of(package.parts[t]) if x.name == "sp"):
                    if any(x.attrs.get("type") == "body" for x in sl.texts_below(shape, "ph")):
                        notes += [x.text for x in sl.texts_below(shape) if x.ns == A and x.text]
            elif t and kind == "comments":
                comments += [x.text for x in nodes_of(package.parts[t]) if x.name in ("text", "t") and x.text]
        hidden = nodes_of(package.parts[slide])[0].attrs.get("show", "1").lower() in ("0", "false")
        yield i, hidden, "\x1f".join(notes), "\x1f".join(comments)


def workbook_layout(documents: DataFrame) -> DataFrame:
    """LAYOUT_SCHEMA: a row for each sheet (ord -1) and each cell with a value."""
    return rows_of(documents, LAYOUT_SCHEMA, layout_of)


def workbook_names(documents: DataFrame) -> DataFrame:
    """NAMES_SCHEMA: names of the whole book, tables, and parts with formulas that name sheets as text."""
    return rows_of(documents, NAMES_SCHEMA, names_of)


def word_bodies(documents: DataFrame) -> DataFrame:
    """BODY_SCHEMA: body text, sorted comments, revision marks, tracking."""
    return rows_of(documents, BODY_SCHEMA, body_of)


def slide_notes(documents: DataFrame) -> DataFrame:
    """NOTES_SCHEMA: notes and comments of each slide, in order."""
    return rows_of(documents, NOTES_SCHEMA, notes_of)


# preparing ------------------------------------------------------------------------------------------------------------


def prepare(documents: DataFrame, notes: bool = False, comments: bool = False, threaded: bool = False, cell_notes: bool = False, prune: bool = False) -> DataFrame:
    """Each file with what its family's options remove, as ``office.RESULT_SCHEMA``; what must stay is compared, and what
    was to go is looked for again."""

    def work(package: Package, source: str) -> None:
        package.refuse_unfit()
        kind, _ = package.main()
        if any("vbaproject" in p.lower() for p in package.parts):
            raise PackageError("macros")
        before = cleaning.preserved(package)
        kept = stores.stores_of(package) if kind == "Word" else None
        if kind == "Word" and comments:
            package.remove_word_comments()
            if next(body_of(package))[1]:
                raise PackageError("comments are left")
        elif kind == "PowerPoint":
            package.remove_slide_annotations(notes, comments)
            left = list(notes_of(package))
            if notes and any(r[2] for r in left) or comments and any(r[3] for r in left):
                raise PackageError("notes or comments are left")
            if notes and "docProps/app.xml" in package.parts:
                package.edit("docProps/app.xml", [(n.inner, n.close, b"0") for n in nodes_of(package.parts["docProps/app.xml"]) if n.name == "Notes" and n.text != "0"])
            if prune:
                prune_checked(package)
        elif kind == "Excel" and (threaded or cell_notes):
            hidden = [s for _, s, _ in sheets_of(package)]
            package.remove_sheet_annotations(threaded, cell_notes)
            if [s for _, s, _ in sheets_of(package)] != hidden:
                raise PackageError("sheets would change")
        if cleaning.preserved(package)[1:] != before[1:] or kept is not None and stores.differing(kept, stores.stores_of(package)):
            raise PackageError("labels or custom XML would change")

    return edit_packages(documents, work)


def prune_checked(package: Package) -> None:
    """Prunes the template, brings the list of titles in line, and checks that only lists changed elsewhere."""
    before = dict(package.parts)
    package.prune_template()
    gone = {p for p in before if p not in package.parts}
    sync_titles(package, [nodes_of(before[p])[0].attrs.get("name", "") for p in sorted(gone) if re.fullmatch(r"ppt/theme/[^/]+\.xml", p)])
    masters = {p for p in package.parts if re.fullmatch(r"ppt/slideMasters/[^/]+\.xml", p)}
    lists = {"ppt/presentation.xml", "ppt/_rels/presentation.xml.rels", "docProps/app.xml", "[Content_Types].xml", *masters, *map(package.rels_name, masters)}
    if changed := [p for p, b in package.parts.items() if b != before[p] and p not in lists]:
        raise PackageError(f"pruning would change {changed[0]}")
    shape = lambda b: [(n.ns, n.name, n.attrs, n.text.strip()) for n in nodes_of(b) if not any(a.name == "sldLayoutIdLst" for a in n.up())]
    if any(shape(package.parts[m]) != shape(before[m]) for m in masters):
        raise PackageError("a master that is in use would change")
    for owner, entry, kind in [("ppt/presentation.xml", "sldMasterId", "slideMaster"), *((m, "sldLayoutId", "slideLayout") for m in masters)]:
        listed = {v for n in nodes_of(package.parts[owner]) if n.name == entry for k, v in n.attrs.items() if k.endswith("}id")}
        if listed != {n.attrs.get("Id") for n, t in package.links(owner) if n.attrs.get("Type", "").endswith("/" + kind)}:
            raise PackageError(f"the list of {owner} and its relationships differ")


def sync_titles(package: Package, vanished: list[str]) -> None:
    """Takes themes that are gone out of the document's titles: a flat vector, cut into categories by their counts."""
    part = "docProps/app.xml"
    if not vanished or part not in package.parts:
        return
    nodes = nodes_of(package.parts[part])
    vectors = {n.name: next((v for v in n.children if v.name == "vector"), None) for n in nodes if n.name in ("HeadingPairs", "TitlesOfParts")}
    if vectors.get("HeadingPairs") is None or vectors.get("TitlesOfParts") is None:
        return
    pairs, titles = vectors["HeadingPairs"].children, vectors["TitlesOfParts"].children
    counts = [next((x for x in sl.texts_below(p, "i4")), None) for p in pairs[1::2]]
    if len(pairs) % 2 or None in counts or sum(int(c.text) for c in counts) != len(titles):
        raise PackageError("titles that cannot be told apart")
    at, edits, removed, left = 0, [], 0, list(vanished)
    for label, count in zip(pairs[::2], counts, strict=True):
        own, at = titles[at : at + int(count.text)], at + int(count.text)
        if "".join(x.text for x in (label, *label.children)).strip().casefold() in THEME_TITLES:
            out = [t for t in own if t.text in left and (left.remove(t.text) or True)]
            edits += [(t.begin, t.end, b"") for t in out]
            if out:
                edits.append((count.inner, count.close, str(len(own) - len(out)).encode()))
            removed += len(out)
    if removed:
        sizes = [cleaning.value_spans(package.parts[part], v)["size"] for v in [vectors["TitlesOfParts"]] if "size" in v.attrs]
        edits += [(a, b, str(len(titles) - removed).encode()) for a, b in sizes]
        package.edit(part, edits)


# planning and verifying merges ---------------------------------------------------------------------------------------


def workbook_plan(files: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(plan, problems) for merging the workbooks of files (merge, book, source).

    plan: merge, book, ord, name, planned. problems: merge, source, problem: names or tables that two books share, and
    books that must rename a sheet but hold formulas that name sheets as text."""
    layout = workbook_layout(documents)
    sheets = layout.where("kind = 'sheet'").join(files, "source").select("merge", F.col("book").cast("long"), F.col("sheet_ord").cast("long").alias("ord"), F.col("sheet").alias("name"))
    plan = merge.plan_sheet_names(sheets)
    known = workbook_names(documents).join(files, "source")
    shared = known.where("kind in ('name', 'table')").groupBy("merge", "kind", "name").agg(F.array_sort(F.collect_set("source")).alias("sources")).where(F.size("sources") > 1)
    clash = shared.select("merge", F.explode("sources").alias("source"), F.concat(F.lit("shared "), "kind", F.lit(": "), "name").alias("problem"))
    renamed = plan.where("name <> planned").join(files, ["merge", "book"]).select("merge", "source").distinct()
    text = known.where("kind = 'text reference'").select("merge", "source").distinct().join(renamed, ["merge", "source"]).withColumn("problem", F.lit("formulas name sheets as text"))
    errors = layout.where("error is not null").join(files, "source").select("merge", "source", F.col("error").alias("problem"))
    return plan, clash.unionByName(text).unionByName(errors).distinct()


def workbook_differences(files: DataFrame, plan: DataFrame, documents: DataFrame, outputs: DataFrame) -> DataFrame:
    """Cells, sheets and names in which merged books (outputs: source = merge, content) are not the planned sequence of
    their sources' sheets: merge, side (expected or actual), what."""
    source = workbook_layout(documents).where("error is null").join(files, "source").withColumn("ord_", F.col("sheet_ord").cast("long"))
    named = source.join(plan.select("merge", "book", F.col("ord").alias("ord_"), "planned"), ["merge", "book", "ord_"])
    numbered = plan.withColumn("at", F.row_number().over(Window.partitionBy("merge").orderBy("book", "ord")) - 1).select("merge", "book", F.col("ord").alias("ord_"), "at")
    columns = ("sheet", "state", "ord", "ref", "kind", "value")
    want = named.join(numbered, ["merge", "book", "ord_"]).select("merge", "at", F.col("planned").alias("sheet"), *columns[1:])
    have = workbook_layout(outputs).where("error is null").select(F.col("source").alias("merge"), F.col("sheet_ord").alias("at"), *columns)
    cells = differences(want, have)
    names = workbook_names(documents).where("kind = 'name'").join(files, "source").select("merge", "name").distinct()
    found = workbook_names(outputs).where("kind = 'name'").select(F.col("source").alias("merge"), "name").distinct()
    return cells.unionByName(differences(names, found))


def differences(want: DataFrame, have: DataFrame) -> DataFrame:
    """merge, side, what: rows that only one side has, as often as it has them more."""
    text = lambda d, side: d.select("merge", F.lit(side).alias("side"), F.to_json(F.struct(*[c for c in want.columns if c != "merge"])).alias("what"))
    return text(want.exceptAll(have), "expected").unionByName(text(have.select(*want.columns).exceptAll(want), "actual"))


def word_differences(files: DataFrame, documents: DataFrame, outputs: DataFrame) -> DataFrame:
    """merge, what, expected, actual: in which merged documents are not their sources' bodies, comments and revisions."""
    own = word_bodies(documents).where("error is null").join(files, "source")
    ordered = F.array_sort(F.collect_list(F.struct("book", "body", "comments")))
    texts = F.filter(F.transform(ordered, lambda x: x["body"]), lambda x: x != "")
    comments = F.array_sort(F.filter(F.flatten(F.transform(ordered, lambda x: F.split(x["comments"], "\x1f"))), lambda x: x != ""))
    want = own.groupBy("merge").agg(F.array_join(texts, " ").alias("body"), F.array_join(comments, "\x1f").alias("comments"), F.sum("revisions").cast("string").alias("revisions"), F.bool_or("tracking").cast("string").alias("tracking"))
    have = word_bodies(outputs).select(F.col("source").alias("merge"), "body", "comments", F.col("revisions").cast("string").alias("revisions"), F.col("tracking").cast("string").alias("tracking"))
    what = ("body", "comments", "revisions", "tracking")
    long = lambda d: d.select("merge", F.explode(F.create_map(*[x for c in what for x in (F.lit(c), F.coalesce(c, F.lit("")))])).alias("what", "value"))
    both = long(want).withColumnRenamed("value", "expected").join(long(have).withColumnRenamed("value", "actual"), ["merge", "what"], "left")
    return both.where(~F.col("expected").eqNullSafe(F.col("actual")))


def slide_differences(files: DataFrame, documents: DataFrame, outputs: DataFrame, skip_hidden: bool = False) -> DataFrame:
    """merge, side, what: slides whose notes or comments are not, in order, those of the sources."""
    own = slide_notes(documents).where("error is null").join(files, "source")
    own = own.where("not hidden") if skip_hidden else own
    at = F.row_number().over(Window.partitionBy("merge").orderBy("book", "ord")) - 1
    want = own.select("merge", at.alias("at"), "notes", "comments")
    have = slide_notes(outputs).where("error is null").select(F.col("source").alias("merge"), F.col("ord").alias("at"), "notes", "comments")
    return differences(want, have)


def totals(files: DataFrame, stats: DataFrame, outputs: DataFrame, what: Sequence[str]) -> DataFrame:
    """merge, what, expected, actual: counts (of ``inspect.STATS_SCHEMA``) that are not the sources' sums."""
    sums = stats.join(files, "source").groupBy("merge").agg(*[F.sum(c).alias(c) for c in what])
    long = lambda d: d.select("merge", F.explode(F.create_map(*[x for c in what for x in (F.lit(c), F.col(c).cast("long"))])).alias("what", "n"))
    both = long(sums).withColumnRenamed("n", "expected").join(long(outputs.withColumnRenamed("source", "merge")).withColumnRenamed("n", "actual"), ["merge", "what"], "left")
    return both.where(~F.col("expected").eqNullSafe(F.col("actual")))


def moved(files: DataFrame, selected: DataFrame, before: int) -> DataFrame:
    """files (ord, ...) renumbered after the ``selected`` (ord) were put, in their order, before place ``before``."""
    marked = files.join(selected.select("ord").distinct().withColumn("chosen", F.lit(True)), "ord", "left")
    chosen = F.coalesce("chosen", F.lit(False))
    # a merge's files are a list that a user orders: one window over them
    key = F.struct(F.when(chosen, 1).when(F.col("ord") < before, 0).otherwise(2), "ord")
    return marked.withColumn("ord", F.row_number().over(Window.orderBy(key)).cast("long")).drop("chosen")


def batch_report(results: DataFrame, skipped: DataFrame) -> DataFrame:
    """task, status, detail of a batch: what was done, failed or passed over, in one table for a report sink."""
    done = results.select(F.col("source").alias("task"), F.when(F.col("error").isNull(), "done").otherwise("failed").alias("status"), F.col("error").alias("detail"))
    return done.unionByName(skipped.select(F.col("path").alias("task"), F.lit("skipped").alias("status"), F.lit("no option applies").alias("detail")))
