"""Checks on packages and results: each returns what violates it, so an empty result is a pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def missing_targets(edges: DataFrame, target: str, parts: DataFrame, part: str) -> DataFrame:
    """Edges whose target is no part."""
    return edges.join(parts.select(F.col(part).alias("part_")).distinct(), F.col(target) == F.col("part_"), "left_anti")


def duplicate_ids(rows: DataFrame, owner: Sequence[str], key: str) -> DataFrame:
    """Owners that use an id more than once: owner..., n, distinct_n."""
    return rows.groupBy(*owner).agg(F.count("*").alias("n"), F.count_distinct(key).alias("distinct_n")).where("n <> distinct_n")


def not_exactly_one(left: DataFrame, keys: Sequence[str], right: DataFrame, on: Column) -> DataFrame:
    """keys... of ``left`` with any other number of partners than one, and that number."""
    joined = left.join(right.withColumn("there_", F.lit(1)), on, "left")
    return joined.groupBy(*keys).agg(F.count("there_").alias("partners")).where("partners <> 1")


def package_guards(entries: DataFrame, source: str, name: str, size: str, most_entries: int = 25_000, most_bytes: int = 629_145_600) -> DataFrame:
    """A row for each source: entries, bytes, distinct names, bad names, ok."""
    bad = F.col(name).contains("\\") | F.col(name).startswith("/") | F.array_contains(F.split(name, "/"), "..")
    sums = entries.groupBy(source).agg(
        F.count("*").alias("entries"), F.sum(size).cast("long").alias("bytes"), F.count_distinct(name).alias("names"), F.count_if(bad).alias("bad_names")
    )
    return sums.withColumn("ok", (F.col("entries") <= most_entries) & (F.col("bytes") <= most_bytes) & (F.col("entries") == F.col("names")) & (F.col("bad_names") == 0))


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``a`` beyond those of ``b``, with side 'left', and the other way round with side 'right'."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def changed(before: DataFrame, after: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """keys... whose value differs or that one side lacks."""
    left = before.select(*[F.col(k).alias(f"l_{k}") for k in key], F.col(value).alias("l_value"), F.lit(True).alias("l_there"))
    right = after.select(*[F.col(k).alias(f"r_{k}") for k in key], F.col(value).alias("r_value"), F.lit(True).alias("r_there"))
    on = F.lit(True)
    for k in key:
        on = on & (F.col(f"l_{k}") == F.col(f"r_{k}"))
    joined = left.join(right, on, "full_outer")
    same = F.col("l_there").isNotNull() & F.col("r_there").isNotNull() & F.col("l_value").eqNullSafe(F.col("r_value"))
    return joined.where(~same).select(*[F.coalesce(f"l_{k}", f"r_{k}").alias(k) for k in key])
