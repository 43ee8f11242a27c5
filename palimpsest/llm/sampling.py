"""Training splits and bounded training samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.session import written


def held_out(id_col: str = "doc_id") -> Column:
    """Rows kept out of all training: crc32 of the id as text leaves 1 modulo 3. False for null ids."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def bounded_sample(rows: DataFrame, stratum: str, n: int, seed: int) -> DataFrame:
    """Of each stratum of ``rows`` (id, stratum; narrow) the ``n`` with the smallest hash of the id, written.

    Strata are few (labels, languages). A hash threshold leaves about 3 n rows of each before any are ranked.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(stratum).count().collect() if r[0] is not None}
    u = F.shiftrightunsigned(F.xxhash64("id", F.lit(seed)), 11).cast("double") / float(1 << 53)
    part = F.lit(0.0)
    for value, count in counts.items():
        part = F.when(F.col(stratum) == F.lit(value), min(1.0, 3.0 * n / count)).otherwise(part)
    near = rows.where(F.col("id").isNotNull()).withColumn("u", u).where(F.col("u") < part)
    order = Window.partitionBy(stratum).orderBy("u", "id")
    return written(near.distinct().withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= n).select("id", stratum), "sample")


def sampled_texts(docs: DataFrame, sample: DataFrame, stratum: str, id_col: str, text_col: str, longest: int) -> list[tuple]:
    """(id, stratum, text) of the sample's rows, those of over ``longest`` characters left out, in a fixed order."""
    some = docs.select(F.col(id_col).alias("id_"), F.col(text_col).alias("text")).where((F.length("text") > 0) & (F.length("text") <= longest))
    found = some.join(sample, F.col("id_") == F.col("id")).select("id", stratum, "text").collect()
    return sorted({(r[0], r[1], r[2]) for r in found})
