"""Source documents: files as rows, format dispatch, text decoding, legacy preflight. Bad files become error rows."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BYTES = 600 << 20
TEXT_SUFFIXES = (".txt", ".md", ".log", ".csv", ".tsv", ".json", ".xml")
LEGACY_SUFFIXES = (".ppt", ".pps", ".doc", ".xls", ".rtf")
SUFFIXES = (".pptx", ".docx", ".xlsx", ".pdf", ".eml", *TEXT_SUFFIXES, *LEGACY_SUFFIXES)
SCAN_ONLY = (".json", ".xml")
SCHEMA = "source string, suffix string, length long, content binary, digest string, can_clean boolean"


def suffix_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def read_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(documents of SCHEMA, errors of source, stage, message). Unfit files never reach a parser."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    seen = files.select(F.col("path").alias("source"), suffix_of(F.col("path")).alias("suffix"), "length", "content")
    hidden = F.substring_index("source", "/", -1).startswith("~$")
    problem = F.when(hidden, "temporary file").when(~F.col("suffix").isin(*SUFFIXES), "unsupported format").when(F.col("length") > MAX_BYTES, "over 600 MB").when(F.col("suffix").isin(*LEGACY_SUFFIXES), "unsupported_legacy")
    marked = seen.withColumn("message", problem)
    documents = marked.where("message is null").drop("message").withColumns({"digest": F.sha2("content", 256), "can_clean": ~F.col("suffix").isin(*SCAN_ONLY)})
    return documents, marked.where("message is not null").select("source", F.lit("read").alias("stage"), "message")


def decode_bytes(raw: bytes) -> tuple[str | None, str | None]:
    """Text and encoding: by the byte-order mark, else UTF-8, else cp950; (None, None) if none fits.

    The mark of UTF-8 is dropped, that of UTF-16 stays in the text."""
    if raw.startswith(b"\xef\xbb\xbf"):
        tries = ("utf-8-sig",)
    elif raw.startswith((b"\xff\xfe", b"\xfe\xff")):
        tries = ("utf-16-le" if raw[0] == 0xFF else "utf-16-be",)
    else:
        tries = ("utf-8", "cp950")
    for encoding in tries:
        try:
            return raw.decode(encoding), encoding
        except UnicodeError:
            pass
    return None, None


def decode_text(df: DataFrame, content: str, text: str = "text", encoding: str = "encoding") -> DataFrame:
    """``df`` with text and encoding; null where neither fits. UTF-8 without a mark stays in the JVM."""
    raw = F.col(content)
    marked = F.substring(raw, 1, 3) == F.lit(b"\xef\xbb\xbf")
    wide = F.substring(raw, 1, 2).isin(F.lit(b"\xff\xfe"), F.lit(b"\xfe\xff"))
    plain = F.is_valid_utf8(raw.cast("string")) & ~marked & ~wide

    @F.pandas_udf("struct<text:string,encoding:string>")
    def slow(column):
        import pandas as pd

        made = [(None, None) if x is None else decode_bytes(bytes(x)) for x in column]
        return pd.DataFrame(made, columns=["text", "encoding"])

    out = df.withColumn("slow_", F.when(~plain, slow(F.when(~plain, raw))))
    return out.withColumns({text: F.when(plain, raw.cast("string")).otherwise(F.col("slow_.text")), encoding: F.when(plain, "utf-8").otherwise(F.col("slow_.encoding"))}).drop("slow_")


def legacy_problem(raw: bytes, suffix: str) -> str | None:
    """Why a legacy file must not be opened, or null: embedded objects in RTF, macros or encryption in OLE, XLS passwords."""
    if suffix == ".rtf":
        if not raw.startswith(b"{\\rtf"):
            return "no RTF file"
        return "embedded object" if b"\\object" in raw.lower() else None
    if not raw.startswith(b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"):
        return "no OLE file"
    names = raw.replace(b"\0", b"").lower()
    for word in (b"_vba_project", b"encryptedpackage", b"encryptioninfo", b"_signatures", b"msip_label_"):
        if word in names:
            return "macros, encryption, signatures or labels"
    if suffix == ".xls" and any(kind == 0x2F for kind, _ in biff_records(raw)):
        return "password"
    return None


def biff_records(raw: bytes) -> Iterator[tuple[int, bytes]]:
    """(type, body) of BIFF records from the first BOF on."""
    at = raw.find(b"\x09\x08\x10\x00\x00\x06")
    while 0 <= at <= len(raw) - 4:
        kind, n = struct.unpack_from("<HH", raw, at)
        yield kind, raw[at + 4 : at + 4 + n]
        at += 4 + n
        if kind == 0x0A:
            return


def preflight(df: DataFrame, content: str = "content", suffix: str = "suffix") -> DataFrame:
    """``df`` with problem."""
    rest = df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raws, kinds = (b.column(b.schema.get_field_index(c)).to_pylist() for c in (content, suffix))
            yield pa.record_batch([*b.columns, pa.array([legacy_problem(r or b"", k) for r, k in zip(raws, kinds, strict=True)], pa.string())], names=[*b.schema.names, "problem"])

    return df.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.fields) + ", problem string")
