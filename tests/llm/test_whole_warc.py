"""Damaged archives: what is intact is read, what is not is a row that says so."""

from palimpsest.llm import warc


def member(i, n=50):
    return warc.record("response", f"<urn:uuid:{i}>", [("WARC-Target-URI", "u")], b"HTTP/1.1 200 OK\r\n\r\n" + bytes([65 + i]) * n)


def test_reading_goes_on_behind_a_damaged_member():
    bad = bytearray(member(1))
    bad[len(bad) // 2 :] = bytes(len(bad) - len(bad) // 2)
    content = member(0) + bytes(bad) + member(2, 300_000) + member(3)
    found = list(warc.read_archive(content))
    assert [e is None for *_, e in found] == [True, False, True, True] and found[1][0] == len(member(0))
    assert [b[-1:] for _, _, b in warc.read_records(content)] == [b"A", b"C", b"D"]


def test_plain_archives_go_on_too():
    one = lambda b, n: b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: " + n + b"\r\n\r\n" + b + b"\r\n\r\n"
    content = one(b"aaaa", b"4") + one(b"bbbb", b"x") + one(b"cccc", b"4")
    assert [b for _, _, b in warc.read_records(content)] == [b"aaaa", b"cccc"]


def test_errors_are_rows(spark):
    df = spark.createDataFrame([("a", bytearray(member(0) + b"\x1f\x8b\x08junk" + member(1)))], "archive string, content binary")
    rows = warc.parse_archives(df).orderBy("offset").collect()
    assert [r.type for r in rows] == ["response", "error", "response"] and rows[1].fields[0].value
    assert warc.assemble(warc.parse_archives(df)).count() == 2


def test_a_very_long_page(spark):
    page = "<p>" + "word " * 1_000_000
    pages = spark.createDataFrame([(1, "u", page), (2, "u", page)], "page_id long, url string, html string")
    got = sorted((r.page_id, r.record_type, r.payload_bytes) for r in warc.resolved(warc.assemble(warc.parse_archives(warc.write_archives(pages)))).collect())
    assert got == [(1, "response", len(page)), (2, "revisit", len(page))]
