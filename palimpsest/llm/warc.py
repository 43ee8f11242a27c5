"""WARC archives: writing captures with revisits, reading records, assembling transactions.

Writing: each page becomes three records, a request, a response (or a revisit) and metadata, the request and the
metadata naming the response in WARC-Concurrent-To. Records are gzip members; a row of the written table holds one
archive of about ARCHIVE_BYTES (or one larger record), so archives are kept by Spark's own writers in the shared folder.

Assembly: records read back are indexed in a narrow table; requests and metadata are joined to responses through their
concurrent-to identifiers (either side may name the other), giving one nested row per capture. After writing, payloads are
not shuffled: digests and lengths are taken where a record is read. Before, pages meet the repeated payloads' digests: a
broadcast while these are few, else one shuffle by digest, whose skew adaptive execution splits.

Revisits: of records with equal payloads of MIN_REVISIT bytes or more the one with the smallest page id is the
response, the others revisit it, without a payload of their own; reading resolves them by their payload digest.

Defined results: a null html is an empty payload; null or empty urls are empty target URIs; a null page id has no
number in its metadata and comes back null, and is a revisit where a numbered page has its payload; repeated rows are
captures of their own; an empty table gives no capture; pages of any length are one record. A damaged record is a record of
type 'error' that says why; reading goes on at the next intact one. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.session import table, written

MIN_REVISIT = 100
ARCHIVE_BYTES = 4 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD_SCHEMA = (
    "archive string, offset long, type string, record_id string, concurrent_to array<string>, target_uri string, date string, "
    "payload_digest string, payload_bytes long, fields array<struct<name:string,value:string>>, payload binary"
)


def record(kind: str, record_id: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One gzip member."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {DATE}", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n") + packer.flush()


def _id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.blake2b(repr(parts).encode('utf-8', 'surrogatepass'), digest_size=16).digest(), version=4)}>"


def one_line(url: str | None) -> str:
    return " ".join((url or "").split())


def capture(key: tuple, page_id: int | None, url: str | None, payload: bytes, digest: str, first_url: str | None) -> list[bytes]:
    """The records of a page; first_url: null for a response, else the URL of the response that it revisits."""
    uri = one_line(url)
    main = _id(*key, "response")
    status = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    shared = [("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if first_url is None:
        response = record("response", main, shared, status + payload)
    else:
        response = record("revisit", main, [*shared, ("WARC-Profile", PROFILE), ("WARC-Refers-To-Target-URI", one_line(first_url))], status)
    beside = [("WARC-Target-URI", uri), ("WARC-Concurrent-To", main)]
    request = record("request", _id(*key, "request"), [*beside, ("Content-Type", "application/http; msgtype=request")], f"GET {uri} HTTP/1.1\r\nUser-Agent: palimpsest\r\n\r\n".encode("utf-8", "surrogatepass"))
    known = "" if page_id is None else f"page-id: {page_id}\r\n"
    metadata = record("metadata", _id(*key, "metadata"), [*beside, ("Content-Type", "application/warc-fields")], f"{known}charset: utf-8\r\n".encode())
    return [request, response, metadata]


def with_first(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """page_id, url, html, digest, first_url (null: to be written as a response)."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), html.alias("html"))
    own = own.withColumn("digest", F.sha2(F.encode("html", "utf-8"), 256))
    large = own.where(F.octet_length("html") >= MIN_REVISIT).select("digest", "page_id", "url")
    firsts = large.groupBy("digest").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    firsts = written(firsts.select(F.col("digest").alias("d"), F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url")), "firsts")
    joined = own.join(firsts, F.col("digest") == F.col("d"), "left")
    return joined.select("page_id", "url", "html", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_url")).alias("first_url"))


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """archive, content: the archives, written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, row = TaskContext.get().partitionId(), 0, 0
        parts: list[bytes] = []
        size = 0

        def archive() -> pa.RecordBatch:
            name = f"part-{part:06d}-{n:06d}.warc.gz"
            info = record("warcinfo", _id(part, n, "info"), [("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"software: palimpsest\r\nformat: WARC File Format 1.1\r\n")
            return pa.record_batch([pa.array([name]), pa.array([info + b"".join(parts)], pa.binary())], names=["archive", "content"])

        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                b = whole.slice(i, 256)
                for page_id, url, html, digest, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    made = capture((part, row), page_id, url, html.encode("utf-8", "surrogatepass"), digest, first)
                    row += 1
                    parts += made
                    size += sum(map(len, made))
                    if size >= ARCHIVE_BYTES:
                        yield archive()
                        n, parts, size = n + 1, [], 0
        if parts:
            yield archive()

    return written(with_first(pages, id_col, url_col, html_col).mapInArrow(run, "archive string, content binary"), "archives")


STEP = 1 << 16


def unpacked(view: memoryview, at: int) -> tuple[bytes, int]:
    """A gzip member's contents and its end, read in bounded steps; ValueError if it is damaged."""
    unpacker, out = zlib.decompressobj(31), []
    try:
        while not unpacker.eof:
            if at >= len(view):
                raise ValueError("cut off")
            out.append(unpacker.decompress(view[at : at + STEP]))
            at += STEP
    except zlib.error as error:
        raise ValueError("damaged compression") from error
    return b"".join(out), min(at, len(view)) - len(unpacker.unused_data)


def one_record(content: bytes, view: memoryview, at: int) -> tuple[int, dict[str, list[str]], bytes]:
    """(end, headers by lower-case name, block) of the record at a place of a gzip or plain archive; ValueError if there
    is none."""
    packed = content[at : at + 2] == b"\x1f\x8b"
    raw, end = unpacked(view, at) if packed else (content, 0)
    start = 0 if packed else at
    head = raw.find(b"\r\n\r\n", start)
    if head < 0 or raw[start : start + 5] != b"WARC/":
        raise ValueError("no record")
    headers: dict[str, list[str]] = {}
    for line in raw[start:head].decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        headers.setdefault(name.strip().lower(), []).append(value.strip())
    length = headers.get("content-length", [""])[0]
    if not length.isascii() or not length.isdigit():
        raise ValueError("no length")
    block = raw[head + 4 : head + 4 + int(length)]
    if len(block) < int(length):
        raise ValueError("cut off")
    return end or head + 4 + int(length) + 4, headers, block


def read_archive(content: bytes) -> Iterator[tuple[int, dict[str, list[str]], bytes, str | None]]:
    """(offset, headers, block, error) of each record; of damaged places only the offset and what is wrong."""
    at, view = 0, memoryview(content)
    while at < len(content):
        try:
            end, headers, block = one_record(content, view, at)
            yield at, headers, block, None
            at = end
        except ValueError as error:
            yield at, {}, b"", str(error)
            # the next place that a record could begin at
            found = [x for x in (content.find(b"\x1f\x8b\x08", at + 1), content.find(b"WARC/1.", at + 1)) if x >= 0]
            while found and not intact(content, view, min(found)):
                x = min(found)
                found = [y for y in (content.find(b"\x1f\x8b\x08", x + 1), content.find(b"WARC/1.", x + 1)) if y >= 0]
            at = min(found, default=len(content))


def intact(content: bytes, view: memoryview, at: int) -> bool:
    try:
        one_record(content, view, at)
    except ValueError:
        return False
    return True


def read_records(content: bytes) -> Iterator[tuple[int, dict[str, list[str]], bytes]]:
    """(offset, headers by lower-case name, block) of each intact record of a gzip or plain archive."""
    return ((at, headers, block) for at, headers, block, error in read_archive(content) if error is None)


def parse_archives(archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """RECORD_SCHEMA of all records but warcinfo; payloads only if asked for. Damaged places are rows of type 'error'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())])), pa.binary()]
        names = ["archive", "offset", "type", "record_id", "concurrent_to", "target_uri", "date", "payload_digest", "payload_bytes", "fields", "payload"]
        for whole in batches:
            for name, content in zip(whole.column(0), whole.column(1), strict=True):
                rows = []
                for at, head, block, error in read_archive(content.as_py()):
                    kind = head.get("warc-type", [""])[0] if error is None else "error"
                    if kind == "warcinfo":
                        continue
                    payload = digest = None
                    fields: list[dict[str, str]] = []
                    if error is not None:
                        fields = [{"name": "error", "value": error}]
                    elif kind == "metadata":
                        fields = [{"name": k.strip(), "value": v.strip()} for k, _, v in (x.partition(":") for x in block.decode("utf-8", "replace").split("\r\n") if x)]
                    elif kind == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        digest = hashlib.sha256(payload).hexdigest()
                    elif kind == "revisit":
                        digest = head.get("warc-payload-digest", [""])[0].removeprefix("sha256:")
                    first = lambda k: head.get(k, [None])[0]  # noqa: B023, E731
                    rows.append((name.as_py(), at, kind, first("warc-record-id"), head.get("warc-concurrent-to", []), first("warc-target-uri"), first("warc-date"), digest, None if payload is None else len(payload), fields, payload if with_payload else None))
                for i in range(0, len(rows), 512):
                    yield pa.record_batch([pa.array([r[k] for r in rows[i : i + 512]], t) for k, t in enumerate(kinds)], names=names)

    return archives.select("archive", "content").mapInArrow(run, RECORD_SCHEMA)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: capture_id, response (struct, of type response or revisit), requests, metadata (arrays)."""
    whole = F.struct(*records.columns)
    responses = records.where("type in ('response', 'revisit')")
    others = records.where("type in ('request', 'metadata')")
    forward = others.select(F.explode("concurrent_to").alias("capture_id"), "type", whole.alias("r"))
    named = responses.select(F.col("record_id").alias("capture_id"), F.explode("concurrent_to").alias("other_id"))
    backward = named.join(others.select("type", F.col("record_id").alias("other_id"), whole.alias("r")), "other_id").select("capture_id", "type", "r")
    beside = forward.unionByName(backward)
    main = responses.select(F.col("record_id").alias("capture_id"), whole.alias("response"))

    def of(kind: str) -> DataFrame:
        found = beside.where(F.col("type") == kind).groupBy("capture_id")
        return found.agg(F.array_sort(F.collect_set("r"), lambda a, b: F.when(a.record_id < b.record_id, -1).when(a.record_id > b.record_id, 1).otherwise(0)).alias(kind))

    none = F.array().cast(f"array<{main.schema['response'].dataType.simpleString()}>")
    joined = main.join(of("request"), "capture_id", "left").join(of("metadata"), "capture_id", "left")
    return joined.select("capture_id", "response", F.coalesce("request", none).alias("requests"), F.coalesce("metadata", none).alias("metadata"))


def resolved(captures: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of captures; revisits by their payload digest."""
    numbers = F.expr("filter(flatten(transform(metadata, m -> m.fields)), f -> f.name = 'page-id')")
    flat = captures.select(
        F.get(numbers, F.lit(0))["value"].cast("long").alias("page_id"),
        F.col("response.type").alias("record_type"), F.col("response.payload_digest").alias("payload_digest"), F.col("response.payload_bytes").alias("own_bytes"),
    )
    flat = written(flat, "captures")
    originals = flat.where(F.col("record_type") == "response").where(F.col("own_bytes") >= MIN_REVISIT).groupBy(F.col("payload_digest").alias("d")).agg(F.min("page_id").alias("first_id"), F.max("own_bytes").alias("bytes"))
    joined = flat.join(originals, F.col("payload_digest") == F.col("d"), "left")
    is_revisit = F.col("record_type") == "revisit"
    return joined.select("page_id", F.when(is_revisit, F.col("bytes")).otherwise(F.col("own_bytes")).alias("payload_bytes"), "payload_digest", "record_type", F.when(is_revisit, F.col("first_id")).alias("refers_to"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write_archives(table(spark, sf_dir, "pages"))
    index = written(parse_archives(archives).drop("payload"), "index")
    return resolved(assemble(index))


QUERIES = {"op2_warc": op2_warc}
SQL = {
    "op2_warc": f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT digest, min(page_id) AS first_id FROM p WHERE n >= {MIN_REVISIT} GROUP BY digest)
SELECT p.page_id AS page_id, CAST(n AS BIGINT) AS payload_bytes, p.digest AS payload_digest,
  CASE WHEN first_id IS NOT NULL AND first_id <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first_id <> p.page_id THEN first_id END AS refers_to
FROM p LEFT JOIN f ON p.digest = f.digest
"""
}
