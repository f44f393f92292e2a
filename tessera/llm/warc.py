"""Content-addressed WARC archives.

An archive is two tables: record headers, exact, and payload bytes, once for each strong digest. Records are put
together again by joining the two on the digest, and each payload is held against its digest when read. Style:
DataFrame functions; Python only where standard .warc files are parsed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import written

CRLF = "\r\n"
#: Payloads under this many bytes are never revisits.
LEAST = 100
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def _one_line(c: Column) -> Column:
    """A header's value cannot hold line ends: they are percent-encoded."""
    return F.replace(F.replace(c, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def headers(pages: DataFrame, least: int = LEAST, date: str = DATE) -> DataFrame:
    """(page_id, digest, header): a record's exact header bytes for each row of pages.

    Of rows with equal payloads of least bytes or more that with the smallest page_id is the response (rows that
    repeat that id too), the others revisit it; rows with smaller payloads, and those of a payload that has no page_id
    at all, are responses. Null html is an empty payload; an empty table gives an empty archive.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    heads = pages.select("page_id", "url", F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("n"))
    first = written(heads.where(F.col("n") >= least).groupBy("digest").agg(F.min("page_id").alias("first")), "first")
    heads = heads.join(first, "digest", "left")
    again = F.col("first").isNotNull() & ~F.coalesce(F.col("page_id") == F.col("first"), F.lit(False))
    ident = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(again, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), ident(F.col("page_id"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), _one_line(F.col("url"))),  # left out where null
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.when(again, F.lit(f"WARC-Profile: {REVISIT}")),
        F.when(again, F.concat(F.lit("WARC-Refers-To: "), ident(F.col("first")))),
        F.lit("Content-Type: text/html"),
        F.concat(F.lit("Content-Length: "), F.when(again, F.lit(0)).otherwise(F.col("n")).cast("string")),
    ]
    text = F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF))
    return heads.select("page_id", "digest", F.encode(text, "UTF-8").alias("header"))


def payloads(pages: DataFrame) -> DataFrame:
    """(digest, payload): each distinct payload once. Copies go before the shuffle, within each task."""
    p = pages.select(F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    return p.select(F.sha2("payload", 256).alias("digest"), "payload").dropDuplicates(["digest"])


def write_archive(pages: DataFrame, path: str, least: int = LEAST) -> None:
    """Writes the archive of pages (page_id, url, html; further columns are left out) under path."""
    headers(pages, least).write.parquet(f"{path}/headers")
    payloads(pages).write.parquet(f"{path}/payloads")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """(header, payload, block, digest, verified): the records of an archive.

    payload is the full payload, for revisits that of the record they refer to; block is what stands in the record.
    verified: the payload has the digest that the header names.
    """
    h, p = spark.read.parquet(f"{path}/headers"), spark.read.parquet(f"{path}/payloads")
    text = F.decode("header", "UTF-8")
    df = h.drop("page_id").join(p, "digest", "left")
    named = F.regexp_extract(text, "\r\nWARC-Payload-Digest: sha256:([0-9a-f]+)\r\n", 1)
    revisit = text.contains("\r\nWARC-Type: revisit\r\n")
    return df.select("header", "payload", F.when(revisit, F.lit(b"")).otherwise(F.col("payload")).alias("block"), named.alias("digest"), (F.sha2("payload", 256) == named).alias("verified"))


def fields(records: DataFrame, id_type: str = "bigint") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) read from records' own bytes; raises where a payload is missing or not verified."""
    text = F.decode("header", "UTF-8")
    get = lambda pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    ok = F.coalesce(F.col("verified"), F.lit(False))
    digest = F.when(ok, F.col("digest")).otherwise(F.raise_error(F.lit("a payload does not have the digest its record names")).cast("string"))
    return records.select(
        get("\r\nWARC-Record-ID: <urn:page:([^>]*)>\r\n").cast(id_type).alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        digest.alias("payload_digest"),
        get("\r\nWARC-Type: (\\w+)\r\n").alias("record_type"),
        get("\r\nWARC-Refers-To: <urn:page:([^>]*)>\r\n").cast(id_type).alias("refers_to"),
    )


def export_warc(spark: SparkSession, path: str, out: str) -> None:
    """The archive's records as standard .warc text files, one for each task; for payloads that are UTF-8."""
    r = read_archive(spark, path)
    r.select(F.concat(F.decode("header", "UTF-8"), F.decode("block", "UTF-8")).alias("value")).write.option("lineSep", CRLF + CRLF).text(out)


def parse_warc(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(header, block) of each record of an uncompressed WARC file; header includes the empty line."""
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            raise ValueError("a record's header does not end")
        header = data[at : end + 4]
        size = next((int(x.split(b":", 1)[1]) for x in header.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
        if size is None or end + 4 + size > len(data):
            raise ValueError("a record has no length, or less than it")
        yield header, data[end + 4 : end + 4 + size]
        at = end + 4 + size


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(header, block) of the records of standard .warc files."""

    def run(batches):
        for b in batches:
            for data in b.column(0).to_pylist():
                rows = list(parse_warc(data))
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], pa.binary()) for i in (0, 1)], ["header", "block"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "header binary, block binary")
