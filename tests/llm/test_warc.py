import base64
import gzip
import hashlib
import io

from larkspur.llm import warc
from larkspur.llm.workspace import scratch_path


def b32(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


ROWS = [(1, "u1", "<p>a</p>"), (2, "u2", "<p>a</p>"), (3, "u\r\n3", None), (4, None, ""), (5, "u5", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"), (6, "u6", "é\n" * 50_000), (7, "u7", "<p>a</p>"), (7, "u7", "<p>a</p>"), (None, "u8", "alone")]


def test_every_page_gets_its_record(spark):
    pages = spark.createDataFrame([(*r, "x") for r in ROWS], "page_id long, url string, html string, record_type string")
    got = sorted((r.asDict() for r in warc.deduplicated_pages(pages).collect()), key=lambda r: (r["page_id"] is None, r["page_id"]))
    want = []
    for i, _, html in sorted(ROWS, key=lambda r: (r[0] is None, r[0])):
        same = [r[0] for r in ROWS if (r[2] or "") == (html or "")]
        top = max(x for x in same if x is not None) if len(same) > 1 else i
        kind = "response" if i == top else "revisit"
        want.append({"page_id": i, "record_type": kind, "payload_digest": b32(html), "payload_bytes": len((html or "").encode()), "refers_to": None if i == top else top})
    assert got == want


def test_archives_read_back_exactly(spark):
    path, fresh = scratch_path(spark, "t-warc"), scratch_path(spark, "t-fresh")
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    warc.write_archive(pages, path)
    back = {(r["page_id"], bytes(r["payload"]).decode()) for r in warc.read_archive(spark, path).collect()}
    assert back == {(i, html or "") for i, _, html in ROWS}
    warc.resolve_revisits(spark, path, fresh)
    kept = [bytes(r["payload"]).decode() for r in warc.read_archive(spark, fresh).where("record_type = 'response' and page_id < 7").collect()]
    assert sorted(kept) == sorted(["", ROWS[4][2], ROWS[5][2]])  # of equal payloads, one keeps its bytes
    for r in spark.read.format("binaryFile").load(path).select("content").collect():
        assert gzip.decompress(r["content"]).startswith(b"WARC/1.1\r\n")


def test_short_payloads_stay_responses(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    got = {r["page_id"]: r["record_type"] for r in warc.deduplicated_pages(pages, min_bytes=3).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_rows_with_the_original_id_stay_responses(spark):
    rows = [(7, "u", "same"), (7, "u", "same"), (3, "u", "same"), (None, "u", "same"), (None, "u", "no id"), (None, "v", "no id")]
    got = warc.deduplicated_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    found = sorted((r["payload_bytes"], r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in got)
    assert found == [(4, 0, "revisit", 7), (4, 3, "revisit", 7), (4, 7, "response", None), (4, 7, "response", None), (5, 0, "response", None), (5, 0, "response", None)]


def test_empty_table(spark):
    assert warc.deduplicated_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_separators_inside_and_at_the_edges_of_payloads(spark):
    rows = [(i, "u", t) for i, t in enumerate(["\r\n", "\r\n\r\n", "a\r\n", "\r\n\r\nb\r\n\r\n\r\n", "\r", "\n\r\n\r", "", "x" * 3_000_000 + "\r\n\r\n" * 1000])]
    path = scratch_path(spark, "t-warc")
    warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), path, records_per_file=3)
    back = warc.read_archive(spark, path).collect()
    assert {r["page_id"]: bytes(r["payload"]).decode() for r in back} == {i: t for i, _, t in rows}
    assert sorted(r["number"] for r in back) == [0, 0, 0, 1, 1, 1, 2, 2] and len({(r["file"], r["number"]) for r in back}) == 8


def test_parser_goes_by_length_alone():
    body = b"WARC/1.1\r\n\r\n"
    record = b"WARC/1.1\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(body), body)
    assert [c for _, c in warc.parse_records(io.BytesIO(record * 3))] == [body] * 3
