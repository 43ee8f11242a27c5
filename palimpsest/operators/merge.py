"""Batch and merge planning: routing, anchors, labels, sheet names, ordered unions, name and store conflicts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as tx
from palimpsest.session import fresh, written

MAX_SHEET_NAME = 31


def batch_plan(files: DataFrame, merge: dict[str, bool], actions: dict[str, bool]) -> DataFrame:
    """files (ord, path, has_keywords) to (ord, path, kind, role, task): role is merge, single, member or skipped.

    A family is merged where its option is on and it has two files; its task stands where its first file does.
    """
    kind = F.coalesce(tx.family(F.col("path")), F.lit(""))
    flag = lambda options: F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in options.items()], F.lit(False))
    by_kind = Window.partitionBy("kind")
    rows = files.withColumn("kind", kind).withColumns({"of_kind": F.count("*").over(by_kind), "nth": F.row_number().over(by_kind.orderBy("ord")), "first_ord": F.min("ord").over(by_kind)})
    merged = flag(merge) & (F.col("of_kind") >= 2) & (F.col("kind") != "")
    role = (
        F.when(merged & (F.col("nth") == 1), "merge").when(merged, "member")
        .when((F.col("kind") != "") & (flag(actions) | F.col("has_keywords")), "single").otherwise("skipped")
    )
    return rows.withColumn("role", role).select("ord", "path", "kind", "role", F.when(F.col("role") == "skipped", None).when(merged, F.col("first_ord")).otherwise(F.col("ord")).alias("task"))


def base_and_conflict(decks: DataFrame, group: list[str], order: str, label: str) -> DataFrame:
    """group..., base_ord, base_label, conflicts: the first labelled deck is the base; decks with other labels conflict."""
    first = decks.where(F.col(label).isNotNull()).groupBy(*group).agg(F.min(F.struct(F.col(order), F.col(label))).alias("b"))
    joined = decks.join(first, group)
    return joined.groupBy(*group).agg(
        F.first("b").getField(order).alias("base_ord"), F.first("b").getField(label).alias("base_label"), F.count_if(F.col(label).isNotNull() & (F.col(label) != F.col("b").getField(label))).alias("conflicts")
    )


def sheet_names(books: Iterable[Iterable[str]]) -> list[list[str]]:
    """New sheet names in merge order: no two alike but for case; a clash gets ' (2)', ' (3)'..., which also avoids all
    names of its own book. Sequential by nature and small: one fold over the names of a merge."""
    taken: set[str] = set()
    out = []
    for book in books:
        own = list(book)
        reserved = taken | {n.casefold() for n in own}
        planned = []
        for name in own:
            fresh, n = name, 2
            if fresh.casefold() in taken:
                fresh = f"{name[: MAX_SHEET_NAME - len(f' ({n})')]} ({n})"
                while fresh.casefold() in reserved or fresh.casefold() in taken:
                    n += 1
                    fresh = f"{name[: MAX_SHEET_NAME - len(f' ({n})')]} ({n})"
            taken.add(fresh.casefold())
            planned.append(fresh)
        out.append(planned)
    return out


def plan_sheet_names(sheets: DataFrame) -> DataFrame:
    """sheets (merge, book, ord, name) to the same with ``planned``: one fold for each merge, spread over tasks."""

    def fold(pdf):
        pdf = pdf.sort_values(["book", "ord"], kind="stable")
        books = [g["name"].tolist() for _, g in pdf.groupby("book", sort=True)]
        return pdf.assign(planned=[n for b in sheet_names(books) for n in b])

    return sheets.groupBy("merge").applyInPandas(fold, "merge string, book long, ord long, name string, planned string")


def numbered(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """``rows`` with their place (from 1) in a global order, in column ``name``: sorted ranges are numbered each for itself
    and begin where the ones before them end, so that no task sees all rows."""
    part, first = fresh(rows, "range_", "first_")
    ranged = written(rows.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy(part).agg(F.count("*").alias("n_"))
    # one row a range
    before = F.sum("n_").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    begins = sizes.select(F.col(part).alias("of_"), F.coalesce(before, F.lit(0)).alias(first))
    own = ranged.withColumn(name, F.row_number().over(Window.partitionBy(part).orderBy(*order)))
    return own.join(begins, F.col(part) == F.col("of_")).withColumn(name, (F.col(name) + F.col(first)).cast("long")).drop(part, first, "of_")


def ordered_union(*frames: DataFrame) -> DataFrame:
    """Rows of all with source_ord before their own ord."""
    out = None
    for i, f in enumerate(frames):
        own = f.withColumn("source_ord", F.lit(i).cast("long"))
        out = own if out is None else out.unionByName(own)
    return out


def store_conflicts(stores: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """key, kept (the first's value), conflict (whether another differs)."""
    first = stores.groupBy(key).agg(F.min_by(value, order).alias("kept"), F.count_distinct(value).alias("kinds"))
    return first.select(key, "kept", (F.col("kinds") > 1).alias("conflict"))


def label_signature(fields: Column) -> Column:
    """Sorted attributes of an active label; null for a historical one (disabled and removed)."""
    truth = lambda v: F.when(F.lower(v).isin("1", "true"), 1).when(F.lower(v).isin("0", "false"), 0)
    enabled, removed = truth(fields["enabled"]), truth(F.coalesce(fields["removed"], F.lit("0")))
    return F.when((enabled == 0) & (removed == 1), None).otherwise(F.to_json(F.array_sort(F.map_entries(fields))))
