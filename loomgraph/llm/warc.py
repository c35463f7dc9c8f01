"""A content-addressed WARC archive.

`write_archive` turns pages into WARC records and stores two tables: ``payloads`` holds the bytes of each different
payload once, under its SHA-256; ``headers`` holds each record's exact header block (WARC and HTTP headers up to the empty
line) with the SHA-256 of its payload.  `read_archive` verifies every payload against its digest and puts the records
together again with a join; `export_warc` writes them as gzipped WARC files and `read_warc` parses such files.

Of the records with equal payloads of at least ``min_bytes`` bytes the one with the smallest page_id is a ``response``
and the others are ``revisit`` records that refer to it; smaller payloads are always responses.

Only digests and headers are grouped and joined by key, payloads are merged on the map side before they move, and a join
on a digest that a third of all pages share has no aggregate above it, so that Spark may split it.

Defined cases: null html is an empty payload, a null url gives a record without a target, control characters in urls
are percent-encoded in the header, repeated rows are records each (the first is the response), a null page_id sorts
first, extra columns are dropped, an empty table gives an empty archive.
"""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CRLF = "\r\n"
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HEX32, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """The bare upper-case base32 SHA-1 of ``payload``: five hex digits are four base32 digits."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), _HEX32, _BASE32)


def _line(name: str, value: str | Column) -> Column:
    return F.concat(F.lit(f"{name}: "), F.lit(value) if isinstance(value, str) else value, F.lit(CRLF))


def _header(page_id: Column, url: Column, kind: Column, refers: Column, sha1: Column, size: Column) -> Column:
    """The bytes of a record up to its payload."""
    http = F.concat(F.lit("HTTP/1.1 200 OK" + CRLF), _line("Content-Type", "text/html; charset=utf-8"), _line("Content-Length", size.cast("string")), F.lit(CRLF))
    target = F.regexp_replace(F.regexp_replace(F.regexp_replace(url, "\r", "%0D"), "\n", "%0A"), r"[\x00-\x1f]", "%20")
    block = F.octet_length(http) + F.when(kind == "response", size).otherwise(F.lit(0))
    none = F.lit("")
    return F.concat(
        F.lit("WARC/1.1" + CRLF),
        _line("WARC-Type", kind),
        F.coalesce(_line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), page_id.cast("string"), F.lit(">"))), none),
        _line("WARC-Date", DATE),
        F.coalesce(_line("WARC-Target-URI", target), none),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), sha1)),
        F.when(kind == "revisit", F.concat(F.coalesce(_line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), refers.cast("string"), F.lit(">"))), none), _line("WARC-Profile", PROFILE))).otherwise(none),
        _line("Content-Type", "application/http; msgtype=response"),
        _line("Content-Length", block.cast("string")),
        F.lit(CRLF),
        http,
    ).cast("binary")


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Write the archive of ``pages`` (page_id, url, html) below ``path``."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    keyed = rows.withColumn("sha256", F.unhex(F.sha2("payload", 256)))
    keyed.select("sha256", "payload").dropDuplicates(["sha256"]).write.parquet(f"{path}/payloads")

    sizes = keyed.select("sha256", base32_sha1(F.col("payload")).alias("sha1"), F.octet_length("payload").cast("long").alias("size"), "page_id", "url")
    records = sizes.groupBy("sha256", "sha1", "size", "page_id", "url").agg(F.count("*").alias("copies"))
    first = records.groupBy("sha256").agg(F.min(F.struct("page_id", "url")).alias("first"))
    copies = records.join(first, "sha256").withColumn("copy", F.explode(F.expr("sequence(1, copies)")))
    leads = F.struct("page_id", "url").eqNullSafe(F.col("first")) & (F.col("copy") == 1)
    kind = F.when(leads | (F.col("size") < min_bytes), "response").otherwise("revisit")
    headers = copies.withColumn("kind", kind).select("sha256", _header(F.col("page_id"), F.col("url"), F.col("kind"), F.col("first.page_id"), F.col("sha1"), F.col("size")).alias("header"))
    headers.write.parquet(f"{path}/headers")


def verified(spark: SparkSession, path: str) -> DataFrame:
    """sha256, payload of the archive; a payload that doesn't have its digest ends the job."""
    store = spark.read.parquet(f"{path}/payloads")
    checked = F.when(F.unhex(F.sha2("payload", 256)) == F.col("sha256"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.hex("sha256"))).cast("binary"))
    return store.select("sha256", checked.alias("payload"))


def parsed(headers: DataFrame) -> DataFrame:
    """The fields of exact header blocks: page_id, url, record_type, refers_to, and what else there is."""
    text = F.col("header").cast("string")

    def field(name: str) -> Column:
        found = F.regexp_extract(text, rf"(?md)^{name}: ([^\r]*)\r$", 1)
        return F.when(found != "", found)

    return headers.withColumns(
        {
            "record_type": field("WARC-Type"),
            "page_id": F.regexp_extract(field("WARC-Record-ID"), r"(-?\d+)", 1).try_cast("long"),
            "refers_to": F.regexp_extract(field("WARC-Refers-To"), r"(-?\d+)", 1).try_cast("long"),
            "url": field("WARC-Target-URI"),
            "declared_digest": F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", ""),
        }
    )


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The archive's records: page_id, url, record_type, refers_to, declared_digest, header, sha256, payload (the full
    one for revisits too).  Columns that are not asked for are not read; of a payload's functions only their results move."""
    return parsed(spark.read.parquet(f"{path}/headers")).join(verified(spark, path), "sha256")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """The records with payload_bytes and payload_digest, computed from the stored bytes where they lie.  A record whose
    header declares another digest or another length ends the job."""
    facts = verified(spark, path).select("sha256", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"))
    found = parsed(spark.read.parquet(f"{path}/headers")).join(facts, "sha256")
    # the header's own words: the digest, the payload's length, and that of the record's block
    http = F.substring_index(F.col("header").cast("string"), CRLF * 2, -2)
    lengths = F.regexp_extract_all(F.col("header").cast("string"), F.lit(r"(?md)^Content-Length: (\d+)\r$"), F.lit(1))
    block = F.octet_length(http) + F.when(F.col("record_type") == "response", F.col("payload_bytes")).otherwise(F.lit(0))
    true = (F.col("declared_digest") == F.col("payload_digest")) & (F.get(lengths, F.lit(0)).cast("long") == block) & (F.get(lengths, F.lit(1)).cast("long") == F.col("payload_bytes"))
    told = F.when(F.coalesce(true, F.lit(False)), F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("a header that doesn't fit its payload "), F.hex("sha256"))))
    return found.withColumn("payload_digest", told).drop("header")


def export_warc(spark: SparkSession, path: str, to: str, records_per_file: int = 2000) -> None:
    """Write the archive's records as gzipped WARC files.  A revisit ends after its headers."""
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    lines = read_archive(spark, path).select(F.concat("header", body).cast("string").alias("value"))
    lines.write.option("lineSep", CRLF + CRLF).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(to)


def _records(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = 0
    while at < len(data):
        head_end = data.index(b"\r\n\r\n", at) + 4
        size = int(re.search(rb"(?im)^Content-Length: *(\d+)", data[at:head_end])[1])
        block = data[head_end : head_end + size]
        http_end = block.index(b"\r\n\r\n") + 4
        yield data[at : head_end + http_end], block[http_end:]
        at = head_end + size
        if data[at : at + 4] != b"\r\n\r\n":
            raise ValueError("a record doesn't end where its Content-Length says")
        at += 4


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """header and payload (the stored bytes) of each record of the WARC files in ``path``, parsed by Content-Length."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                raw = data.as_py()
                found = list(_records(gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw))
                for at in range(0, len(found), 256):
                    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found[at : at + 256]], pa.binary()) for k in range(2)], names=["header", "payload"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(parse, "header binary, payload binary")
