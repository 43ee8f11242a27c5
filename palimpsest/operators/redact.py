"""Redaction: keyword and block modes on lines, split runs and names; selections and their checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import keywords as kw
from palimpsest.functions import text as tx


def cleaned_line(line: Column, pattern: str, block: bool) -> Column:
    """keyword: without the matches. block: empty but for a leading byte-order mark and a closing CR LF or LF."""
    if not block:
        return F.regexp_replace(line, pattern, "")
    mark = F.when(line.startswith("﻿"), "﻿").otherwise("")
    return F.concat(mark, F.regexp_extract(line, r"(\r?\n)?\z", 1))


def clean_text(text: Column, words: Sequence[str], block: bool = False) -> Column:
    """The whole text with its matching lines cleaned, without exploding it. Keywords hold no line ends, so in keyword
    mode the lines need not be cut."""
    pattern = kw.spark_pattern(list(words))
    if not block:
        return F.regexp_replace(text, pattern, "")
    return F.array_join(F.transform(tx.split_lines(text), lambda x: F.when(x.rlike(pattern), cleaned_line(x, pattern, True)).otherwise(x)), "")


def invalid_selection(selection: DataFrame, found: DataFrame, on: Sequence[str]) -> DataFrame:
    """Selected ids that do not exist or are scan-only; must be empty before anything is cleaned."""
    return selection.join(found.where("cleanable").select(*on).distinct(), list(on), "left_anti")


def selected(found: DataFrame, selection: DataFrame, on: Sequence[str]) -> DataFrame:
    return found.join(selection.select(*on).distinct(), list(on), "left_semi")


def stale(scanned: DataFrame, now: DataFrame, key: str, digest: str) -> DataFrame:
    """Sources whose digest is no longer that of the scan, or that are gone."""
    current = now.select(F.col(key).alias("key_"), F.col(digest).alias("now_"))
    return scanned.join(current, F.col(key) == F.col("key_"), "left").where(~F.col(digest).eqNullSafe(F.col("now_"))).select(key)


def clip_runs(runs: DataFrame, words: Sequence[str], group: Sequence[str], order: str, text: str, block: bool = False) -> DataFrame:
    """``runs`` with ``cleaned``: matches over a group's joined text are cut out of each run, so a keyword split over
    several is found. One window a group; the joined text exists once a run only while the run is cleaned."""
    pattern = kw.spark_pattern(list(words))
    w = Window.partitionBy(*group).orderBy(order)
    whole = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    value = F.coalesce(F.col(text), F.lit(""))
    placed = runs.withColumns(
        {"start_": F.coalesce(F.sum(F.length(value)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "all_": F.array_join(F.collect_list(value).over(whole), "")}
    )
    # a sentinel per kept character would be wasteful: the pieces between matches give the intervals to keep
    pieces = F.split(F.col("all_"), pattern, -1)
    hits = F.regexp_extract_all("all_", F.lit(pattern), F.lit(0))
    ends = F.aggregate(
        F.arrays_zip(pieces.alias("p"), hits.alias("h")),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<a:int,b:int>>").alias("keep")),
        lambda s, x: F.struct(
            (s["at"] + F.coalesce(F.length(x["p"]), F.lit(0)) + F.coalesce(F.length(x["h"]), F.lit(0))).alias("at"),
            F.concat(s["keep"], F.array(F.struct(s["at"].alias("a"), (s["at"] + F.coalesce(F.length(x["p"]), F.lit(0))).alias("b")))).alias("keep"),
        ),
    )
    begin, end = F.col("start_").cast("int"), (F.col("start_") + F.length(value)).cast("int")
    kept = F.array_join(
        F.transform(F.col("keep_"), lambda k: F.call_function("substring", value, F.greatest(k["a"], begin) - begin + 1, F.greatest(F.least(k["b"], end) - F.greatest(k["a"], begin), F.lit(0)))), ""
    )
    if block:
        kept = F.when(F.col("all_").rlike(pattern), "").otherwise(value)
        return placed.withColumn("cleaned", kept).drop("start_", "all_")
    return placed.withColumn("keep_", ends["keep"]).withColumn("cleaned", kept).drop("start_", "all_", "keep_")


def propagate(values: DataFrame, remap: DataFrame, value: str) -> DataFrame:
    """``values`` with ``renamed``: the new name where the value, or the value behind a #, is an old name.

    remap: old, new. A plain join, so that Spark broadcasts it while it is small and shuffles it when it is not."""
    plain = F.regexp_replace(F.col(value), "^#", "")
    joined = values.withColumn("plain_", plain).join(remap.select(F.col("old").alias("old_"), F.col("new").alias("new_")), F.col("plain_") == F.col("old_"), "left")
    mark = F.when(F.col(value).startswith("#"), "#").otherwise("")
    return joined.withColumn("renamed", F.coalesce(F.concat(mark, F.col("new_")), F.col(value))).drop("plain_", "old_", "new_")
