"""Scanning: texts to lines, lines to findings, findings to reports; vetoes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import keywords as kw
from palimpsest.functions import text as tx

LINE_CATEGORY = "文字行"
SCAN_ONLY_FORMATS = ("json", "xml")


def explode_lines(docs: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """keys..., n (from 1), line."""
    return docs.select(*keys, F.posexplode(tx.split_lines(F.col(text))).alias("pos", "line")).select(*keys, (F.col("pos") + 1).cast("long").alias("n"), "line")


def matching_lines(docs: DataFrame, words: Sequence[str], keys: Sequence[str], text: str = "text") -> DataFrame:
    """Lines with a keyword. Documents without any are dropped before their lines are made: a keyword holds no line end."""
    pattern = kw.spark_pattern(list(words))
    return explode_lines(docs.where(F.col(text).rlike(pattern)), keys, text).where(F.col("line").rlike(pattern))


def findings(slots: DataFrame, words: Sequence[str], keys: Sequence[str], part: Column, path: Column, category: Column, text: str, cleanable: Column) -> DataFrame:
    """keys..., id, part, path, location, category, context, matches, cleanable of the slots whose text has a keyword."""
    pattern = kw.spark_pattern(list(words))
    found = slots.where(F.col(text).rlike(pattern)).withColumn("matches", F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    # an earlier copy of the first match would have matched itself, so its place is the match's
    placed = found.withColumn("first_", F.call_function("locate", F.col("matches")[0], F.col(text)))
    return placed.select(
        *keys,
        tx.finding_id(part, path, category, F.col(text)).alias("id"),
        part.alias("part"), path.alias("path"), tx.location(part).alias("location"), category.alias("category"),
        tx.context(F.col(text), F.col("first_")).alias("context"), "matches", cleanable.alias("cleanable"), F.col(text).alias("text"),
    )


def line_findings(docs: DataFrame, words: Sequence[str], keys: Sequence[str], text: str = "text", cleanable: Column | None = None) -> DataFrame:
    """Findings of text lines, with n and the line as ``text``."""
    lines = matching_lines(docs, words, keys, text)
    return findings(lines, words, [*keys, "n"], F.lit("text"), F.col("n").cast("string"), F.lit(LINE_CATEGORY), "line", F.lit(True) if cleanable is None else cleanable)


def report(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row a document: findings, match_count."""
    return found.groupBy(*keys).agg(F.count("*").alias("findings"), F.sum(F.size("matches")).cast("long").alias("match_count"))


def veto(found: DataFrame, vetoed: DataFrame, key: str) -> DataFrame:
    """Findings of vetoed documents are scan-only."""
    marked = vetoed.select(key).distinct().withColumn("veto_", F.lit(True))
    return found.join(marked, key, "left").withColumn("cleanable", F.col("cleanable") & F.col("veto_").isNull()).drop("veto_")
