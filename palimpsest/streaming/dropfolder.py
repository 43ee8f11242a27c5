"""Streaming scan of a folder: the batch plan on a stream of files, so that both give the same findings. An addition of
this engine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import scan


def stream_text(spark: SparkSession, folder: str, suffix: str = "txt") -> DataFrame:
    """source, text of UTF-8 files that come into ``folder``."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", f"*.{suffix}").load(folder)
    return files.select(F.col("path").alias("source"), F.col("content").cast("string").alias("text"))


def stream_findings(spark: SparkSession, folder: str, words: Sequence[str]) -> DataFrame:
    """Stateless, so files of any age are scanned once each."""
    return scan.line_findings(stream_text(spark, folder), words, ["source"])
