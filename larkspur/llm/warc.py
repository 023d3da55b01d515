"""WARC archives: writing, reading back, and resolving revisits.

``write_archive`` writes one ``response`` record per page.  ``resolve_revisits``
reads an archive's headers, shuffles them by payload digest, joins every group
of equal payloads to its original, and writes a deduplicated archive in which
each further copy is a ``revisit`` record with fresh headers and no payload.
Payloads play no part in the decisions, which go back to their records by file
and number in the file.

Archives are folders of gzip files written by Spark's text writer, whose line
separator is the empty block that ends a WARC record.  They are read as a stream
by the same separator, so that a task holds a batch of pieces and one record, but
never a file.  No record can lose its framing, since a separator inside a payload
is put back and readers go by ``Content-Length`` alone.  A lost executor's files
are written again by the commit protocol, and readers see committed files only.

Defined results for odd input: a null payload is empty; equal payloads of at
least ``min_bytes`` bytes form a group, whose largest page id stays the
response; a page id on two rows makes two records, and each that has the largest
id of its group stays a response with its payload, so exactly repeated rows aren't
deduplicated; a null page id is written as an empty id, read back as null and never
the original of a group that has another id, while in a group of null ids alone all
stay responses; a null url becomes an empty target; an empty table makes an empty archive.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.workspace import join_by_hot, scratch_path, written

CRLF = "\r\n"
#: Fixed value: the alphabet of RFC 4648 base32, and the digits that conv() writes.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DIGITS32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"

RECORD_SCHEMA = "file string, number long, page_id long, record_type string, url string, payload_digest string, payload_bytes long, refers_to long, payload binary"
ARROW_SCHEMA = pa.schema([
    ("file", pa.string()), ("number", pa.int64()), ("page_id", pa.int64()), ("record_type", pa.string()), ("url", pa.string()),
    ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary()),
])
SEPARATOR = b"\r\n\r\n"


def sha1_base32(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1 of a string's or binary's bytes."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.upper(F.concat(*parts)), DIGITS32, BASE32)


def _urn(page_id: Column, kind: str) -> Column:
    return F.concat(F.lit(f"<urn:page:{kind}:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def _clean(value: Column) -> Column:
    """A header value can't hold line ends."""
    return F.regexp_replace(F.coalesce(value, F.lit("")), "[\r\n]+", " ")


def _record(kind: str, page_id: Column, url: Column, digest: Column, length: Column, refers: Column | None, payload: Column | None, date: str) -> Column:
    lines = [
        F.lit("WARC/1.1"),
        F.lit(f"WARC-Type: {kind}"),
        F.concat(F.lit("WARC-Record-ID: "), _urn(page_id, kind)),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), _clean(url)),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), digest),
    ]
    if refers is not None:
        lines.append(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        lines.append(F.concat(F.lit("WARC-Refers-To: "), _urn(refers, "response")))
        lines.append(F.concat(F.lit("X-Payload-Length: "), length.cast("string")))
    else:
        lines.append(F.lit("Content-Type: text/html; charset=utf-8"))
    lines.append(F.concat(F.lit("Content-Length: "), length.cast("string") if payload is not None else F.lit("0")))
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF * 2), payload if payload is not None else F.lit(""))


def _write(records: DataFrame, path: str, records_per_file: int) -> None:
    (
        records.write.option("lineSep", CRLF * 2)
        .option("compression", "gzip")
        .option("maxRecordsPerFile", records_per_file)
        .text(path)
    )


def write_archive(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url: str = "url",
    payload: str = "html",
    date: str = "2024-01-01T00:00:00Z",
    records_per_file: int = 2000,
) -> None:
    """One response record per row of ``pages``."""
    body = F.coalesce(F.col(f"`{payload}`"), F.lit(""))
    length, digest = F.octet_length(body).cast("long"), sha1_base32(body)
    record = _record("response", F.col(f"`{id_col}`"), F.col(f"`{url}`"), digest, length, None, body, date)
    _write(pages.select(record.alias("value")), path, records_per_file)


def parse_records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and content of each record of one uncompressed archive."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins at {line[:60]!r}")
        headers: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8").partition(":")
            headers[name.strip().lower()] = value.strip()
        content = stream.read(int(headers["content-length"]))
        yield headers, content


def _page_id(urn: str) -> int | None:
    text = urn.rstrip(">").rpartition(":")[2]
    return int(text) if text else None


class Pieces(io.RawIOBase):
    """A file as a stream, from the pieces between its separators."""

    def __init__(self, pieces: Iterator[bytes]) -> None:
        self.pieces, self.rest = pieces, b""

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        if not self.rest:
            piece = next(self.pieces, None)
            if piece is None:
                return 0
            self.rest = piece + SEPARATOR
        n = min(len(into), len(self.rest))
        into[:n] = self.rest[:n]
        self.rest = self.rest[n:]
        return n


def _reader(with_payload: bool, batch_bytes: int):
    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ARROW_SCHEMA.types, strict=True)], schema=ARROW_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        pieces = ((name, piece) for batch in batches for name, piece in zip(batch.column("file").to_pylist(), batch.column("value").to_pylist(), strict=True))
        for name, own in groupby(pieces, key=itemgetter(0)):  # a file is read whole and in order by one task
            stream = io.BufferedReader(Pieces(piece for _, piece in own), 1 << 16)
            for number, (h, body) in enumerate(parse_records(stream)):
                size = int(h.get("x-payload-length", h["content-length"]))
                refers = _page_id(h["warc-refers-to"]) if "warc-refers-to" in h else None
                kept = body if with_payload else None
                rows.append((name, number, _page_id(h["warc-record-id"]), h["warc-type"], h["warc-target-uri"], h["warc-payload-digest"].removeprefix("sha1:"), size, refers, kept))
                held += 200 + (len(body) if with_payload else 0)
                if held >= batch_bytes:
                    yield batch_of(rows)
                    rows, held = [], 0
        if rows:
            yield batch_of(rows)

    return run


def read_archive(spark: SparkSession, path: str, with_payload: bool = True, batch_bytes: int = 4 << 20) -> DataFrame:
    """The records of the archive at ``path``, with their file and number in it; ``payload`` is null if not asked for."""
    pieces = spark.read.option("pathGlobFilter", "*.gz").text(path, lineSep=CRLF * 2)
    named = pieces.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value"))
    return named.mapInArrow(_reader(with_payload, batch_bytes), RECORD_SCHEMA)


def originals(headers: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``payload_digest, payload_bytes, original_id, n`` of payloads found ``n`` times, more than once."""
    grouped = headers.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest", "payload_bytes")
    counted = grouped.agg(F.max("page_id").alias("original_id"), F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") > 1)


def revisits(headers: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``file, number, original_id`` of each record that revisits another."""
    met = join_by_hot(headers, written(originals(headers, min_bytes), "warc-originals"), ["payload_digest", "payload_bytes"])
    other = F.col("original_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original_id"))
    return met.where(other).select("file", "number", "original_id")


def resolve_revisits(spark: SparkSession, source: str, target: str, min_bytes: int = 0, date: str = "2024-01-02T00:00:00Z", records_per_file: int = 2000) -> None:
    """Write the archive ``source`` again at ``target`` without repeated payloads.

    Headers alone meet by digest, without payloads; the payloads in a large share of
    the repeating records are broadcast by digest, so that their headers never meet in one
    task.  The decisions go back to the records by file and number, keys that no two records share.
    """
    headers = written(read_archive(spark, source, with_payload=False).select("file", "number", "page_id", "payload_digest", "payload_bytes"), "warc-headers")
    found = written(revisits(headers, min_bytes), "warc-revisits")
    joined = read_archive(spark, source).join(found, ["file", "number"], "left")
    body = F.decode(F.col("payload"), "UTF-8")
    args = F.col("page_id"), F.col("url"), F.col("payload_digest"), F.col("payload_bytes")
    record = F.when(F.col("original_id").isNotNull(), _record("revisit", *args, F.col("original_id"), None, date)).otherwise(_record("response", *args, None, body, date))
    _write(joined.select(record.alias("value")), target, records_per_file)


def deduplicated_pages(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write ``pages``, resolve revisits, and return the headers read back."""
    spark = pages.sparkSession
    raw, fresh = scratch_path(spark, "warc-raw"), scratch_path(spark, "warc-fresh")
    write_archive(pages, raw)
    resolve_revisits(spark, raw, fresh, min_bytes)
    return read_archive(spark, fresh, with_payload=False).drop("file", "number", "payload", "url")
