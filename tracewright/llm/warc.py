"""WARC writing with revisit records for repeated payloads, and reading the archives back."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, scratch_path, table

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, digest_ok boolean, record_id string, refers_to_id string, payload binary"
#: Bytes of an archive before compression, and of payloads in a batch that is read.
ARCHIVE, PART = 64 << 20, 16 << 20
CRLF = "\r\n"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: 8 groups of 5 hex digits give 4 letters each."""
    digits, letters = F.sha1(payload), []
    for g in range(8):
        n = F.conv(F.substring(digits, 5 * g + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(ALPHABET), F.shiftright(n, 15 - 5 * k).bitwiseAND(31) + 1, F.lit(1)) for k in range(4)]
    return F.concat(*letters)


def resolve(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, refers_to and refers_uri (null for responses).

    Headers alone are grouped by digest for the smallest page_id; digests that occur once never leave that step. The
    table of repeated digests is joined back: Spark broadcasts it if its files are small, else the join splits a hot
    digest's rows. Null html: empty payload. Null page_ids never serve as the original while another row has an id; rows
    that repeat the original's page_id are responses too. Empty table: empty result.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": base32_sha1(F.col("payload"))})
    first = rows.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("o"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = first.select("payload_digest", F.col("o.page_id").alias("first"), F.col("o.url").alias("first_url"))
    originals = materialize(first, "warc-originals")
    refers = F.when((F.col("first") != F.col("page_id")) | (F.col("page_id").isNull() & F.col("first").isNotNull()), F.col("first"))
    return rows.join(originals, "payload_digest", "left").withColumn("refers_to", F.when(F.col("payload_bytes") >= min_bytes, refers)).withColumn("refers_uri", F.when(F.col("refers_to").isNotNull(), F.col("first_url"))).drop("first", "first_url")


def records(resolved: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """One column, value: WARC header and block of each record, without the blank lines that end it."""
    nl, revisit = F.lit(CRLF), F.col("refers_to").isNotNull()
    line = lambda k, v: F.concat(F.lit(f"{k}: "), v, nl)
    name = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF + CRLF))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload").cast("string")))
    clean = lambda u: F.regexp_replace(u, r"[\r\n]+", " ")
    url = clean(F.coalesce(F.col("url"), F.lit("")))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"), line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.coalesce(name(F.col("page_id")), F.lit("<urn:page:>"))), line("WARC-Date", F.lit(date)),
        F.when(F.col("url").isNull(), F.lit("")).otherwise(line("WARC-Target-URI", url)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", name(F.col("refers_to"))), F.when(F.col("refers_uri").isNull(), F.lit("")).otherwise(line("WARC-Refers-To-Target-URI", clean(F.col("refers_uri")))), line("WARC-Refers-To-Date", F.lit(date)), line("WARC-Profile", F.lit(PROFILE)), line("WARC-Payload-Length", F.col("payload_bytes").cast("string")))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF + CRLF),
    )
    return resolved.select(F.concat(head, block).alias("value"))


def write_archives(resolved: DataFrame, path: str, records_per_file: int = 4096) -> None:
    """Gzipped WARC files: the text sink's line end is the pair of CRLFs that ends a WARC record."""
    records(resolved).write.option("lineSep", CRLF + CRLF).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def records_for(pages: DataFrame, archive_bytes: int = ARCHIVE) -> int:
    """Records of an archive of about archive_bytes before compression, from the mean size of pages."""
    n = pages.agg(F.avg(F.coalesce(F.octet_length("html"), F.lit(0))).alias("n")).first()["n"] or 0
    return max(1, int(archive_bytes / (n + 512)))


def parse(stream: BinaryIO) -> Iterator[dict]:
    """The records of one archive by their Content-Length: header fields in lower case and the block."""
    while line := stream.readline():
        if not line.startswith(b"WARC/1."):
            continue
        head = {}
        while field := stream.readline().rstrip(b"\r\n"):
            k, _, v = field.decode("utf-8", "replace").partition(":")
            head[k.strip().lower()] = v.strip()
        size = head.get("content-length", "")
        yield head | {"block": stream.read(int(size) if size.isdigit() else 0)}


def _page(name: str | None) -> int | None:
    digits = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits.isascii() and digits.isdigit() else None


def _row(r: dict) -> tuple:
    said, kind = r.get("warc-payload-digest", "").removeprefix("sha1:"), r.get("warc-type", "")
    payload = r["block"].partition(b"\r\n\r\n")[2]
    own = base64.b32encode(hashlib.sha1(payload).digest()).decode() if kind == "response" else ""
    length = r.get("warc-payload-length", "")
    size = len(payload) if kind == "response" else int(length) if length.isdigit() else None
    ids = r.get("warc-record-id"), r.get("warc-refers-to")
    return _page(ids[0]), r.get("warc-target-uri"), size, said or own or None, kind, _page(ids[1]), kind != "response" or not said or own == said, *ids, payload if kind == "response" else None


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of whole archives, read as streams; a batch holds PART bytes of payload at most, or one record."""

    def batch(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in READ.split(", ")])
        return out.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "Int64", "digest_ok": "bool"})

    for b in batches:
        for content in b["content"]:
            rows, size = [], 0
            for r in parse(gzip.GzipFile(fileobj=io.BytesIO(content))):
                if rows and size + len(r["block"]) > PART:
                    yield batch(rows)
                    rows, size = [], 0
                rows.append(_row(r))
                size += len(r["block"])
            if rows:
                yield batch(rows)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the gzipped archives under path, one gzip member or many.

    page_id, url, payload_bytes, payload_digest, record_type, refers_to, digest_ok (of a response: its payload agrees with
    its header), record_id, refers_to_id, payload (of a response). Fields that a foreign archive lacks are null, its
    record ids give no page_id, and a response without a digest gets its own.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInPandas(_read, READ)


def restore(archived: DataFrame) -> DataFrame:
    """Rows of read_archives with the payload that a revisit stands for, and original, the record_id of its response.

    Headers alone meet by digest for the smallest record_id of a response; payloads move only to the revisits that take
    them. A revisit whose response isn't there keeps a null payload and original. Responses stay as they are. Null
    digests meet nothing.
    """
    narrow = archived.where("record_type = 'response'").groupBy("payload_digest").agg(F.min("record_id").alias("original"))
    revisits = archived.where("record_type = 'revisit'").drop("payload").join(materialize(narrow, "warc-responses"), "payload_digest", "left")
    wanted = materialize(revisits.select(F.col("original").alias("record_id")).where("original is not null").distinct(), "warc-wanted")
    payloads = archived.where("record_type = 'response'").join(wanted, "record_id", "left_semi").groupBy(F.col("record_id").alias("original"), "payload_digest").agg(F.first("payload").alias("payload"))
    rest = archived.where("record_type <> 'revisit'").withColumn("original", F.when(F.col("record_type") == "response", F.col("record_id")))
    return rest.unionByName(revisits.join(payloads, ["original", "payload_digest"], "left"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    write_archives(resolve(pages), path, records_for(pages))
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS s FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
      array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(s, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INTEGER) + 1, 1) FOR i IN range(32)], '') AS payload_digest FROM p),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS f FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> f THEN f END AS refers_to FROM m
"""
