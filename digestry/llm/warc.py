"""Content-addressed WARC archive.

An archive is two tables in one folder.  ``headers`` holds, for every record, the exact bytes before
its payload (WARC fields, blank line, HTTP head) and the SHA-256 of the payload; ``payloads`` holds
the bytes of each distinct payload once, by that digest.  Records are put together again by a join:
header, payload, and the two line ends that close a record.  Digests are verified twice: on storing,
all rows of a SHA-256 must agree in SHA-1 and length; on reading, the stored bytes must give the
SHA-256 they are kept by.  A mismatch fails the job.

Which of several pages with one payload holds it is decided on narrow rows: the smallest id is the
``response``, the others are ``revisit`` records that name it; payloads under ``min_bytes`` are all
responses (and still stored once).

Hot payloads: copies collapse before the shuffle (one row per digest and task), and a digest with more
than ``SALT_ROWS`` records is joined in as many salted parts, so no task gathers its records.

Defined results: a null payload is empty; a null url gives a record without target; a null id gives a
record without page id, which comes last among equal payloads; of repeated (id, payload) rows one is the
response; control characters in a url are percent-encoded in the header; other columns of the pages, whatever
their names, are left out; an empty table gives an empty archive.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from digestry import session
from digestry.llm.common import join_split, read, registry, written

QUERIES, ORACLE, register = registry()

# WARC 1.1 (ISO 28500) and the base32 alphabet of RFC 4648.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

CRLF = "\r\n"
SALT_ROWS = 100_000  # records of one payload that one salted part of the join takes
HEADERS = "seq long, header binary, digest string, salts int"
PAYLOADS = "digest string, payload binary, salts int"


@dataclass(frozen=True)
class Archive:
    """Folder of a written archive."""

    spark: SparkSession
    root: str

    @property
    def headers(self) -> DataFrame:
        return self.spark.read.schema(HEADERS).parquet(f"{self.root}/headers")

    @property
    def payloads(self) -> DataFrame:
        return self.spark.read.schema(PAYLOADS).parquet(f"{self.root}/payloads")


def base32(digest_hex: Column) -> Column:
    """Base32 of a SHA-1 given in hex: five hex digits are four letters."""
    letters = []
    for at in range(0, 40, 5):
        bits = F.conv(F.substring(digest_hex, at + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), F.shiftright(bits, shift).bitwiseAND(31) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*letters)


def _bytes(payload: str) -> Column:
    return F.coalesce(F.col(payload).cast("binary"), F.lit(b""))


def _field(name: str, value: Column) -> Column:
    """A header line, or nothing for a null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF)), F.lit(""))


def _urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    cut = [F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _uri(url: Column) -> Column:
    """The url with its control characters and spaces percent-encoded, so that it stays on one line."""
    coded = F.transform(F.split(url, ""), lambda c: F.when(c.rlike(r"[\x00-\x20\x7f]"), F.concat(F.lit("%"), F.lpad(F.hex(c), 2, "0"))).otherwise(c))
    return F.when(url.rlike(r"[\x00-\x20\x7f]"), F.array_join(coded, "")).otherwise(url)


def _header(date: str) -> Column:
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("size").cast("string"), F.lit(CRLF + CRLF))
    again = F.col("first.seq") != F.col("seq")
    block = F.length(http) + F.when(again, F.lit(0)).otherwise(F.col("size"))
    named = F.when(again, F.col("first"))
    fields = [
        F.lit(VERSION + CRLF),
        _field("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        _field("WARC-Record-ID", _urn(F.col("seq"), F.col("id"), F.col("digest"))),
        _field("WARC-Date", F.lit(date)),
        _field("WARC-Target-URI", _uri(F.col("url"))),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha1")))),
        _field("WARC-Profile", F.when(again, F.lit(REVISIT_PROFILE))),
        _field("WARC-Refers-To", F.when(again, _urn(named["seq"], named["id"], F.col("digest")))),
        _field("Refers-To-Page-ID", named["id"]),
        _field("Page-ID", F.col("id")),
        _field("Content-Type", F.lit("application/http; msgtype=response")),
        _field("Content-Length", block),
        F.lit(CRLF),
        http,
    ]
    return F.encode(F.concat(*fields), "UTF-8")


def _digests(rows: DataFrame, payload: str) -> list[Column]:
    body = _bytes(payload)
    return [F.sha2(body, 256).alias("digest"), F.sha1(body).alias("sha1"), F.octet_length(body).cast("long").alias("size")]


def _once(sha1: Column, size: Column, key: Column) -> Column:
    """The group's number of rows; fails where rows with one SHA-256 differ in SHA-1 or length."""
    same = (F.min(sha1) == F.max(sha1)) & (F.min(size) == F.max(size))
    return F.when(same, F.count(F.lit(1))).otherwise(F.raise_error(F.concat(F.lit("different payloads share the digest "), key)).cast("long"))


def _salts(n: Column) -> Column:
    return F.ceil(n / F.lit(SALT_ROWS)).cast("int")


def _folder(spark: SparkSession) -> str:
    return f"{session.checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"


def _store_payloads(rows: DataFrame, payload: str, root: str) -> None:
    """Each distinct payload once.  Copies collapse within their task before anything is shuffled."""
    body = rows.select(F.sha2(_bytes(payload), 256).alias("digest"), _bytes(payload).alias("payload"))
    one = body.groupBy("digest").agg(F.first("payload").alias("payload"), F.count(F.lit(1)).alias("n"))
    one.select("digest", "payload", _salts(F.col("n")).alias("salts")).write.option("compression", "zstd").parquet(f"{root}/payloads")


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                  min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", root: str | None = None) -> Archive:
    """Write one record per page; equal payloads of at least ``min_bytes`` bytes become revisits of the smallest id's."""
    spark = pages.sparkSession
    root = root or _folder(spark)
    keys = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), *_digests(pages, payload_col))
    keys = written(keys.withColumn("seq", F.monotonically_increasing_id()))
    order = F.struct(F.col("id").isNull().alias("unnamed"), "id", "seq")
    firsts = written(keys.groupBy("digest").agg(F.min(order).alias("least"), _once(F.col("sha1"), F.col("size"), F.col("digest")).alias("n")).withColumn("records", F.col("n")))
    rows = join_split(keys, firsts, "digest", keys.count())
    own = F.struct(F.lit(False).alias("unnamed"), "id", "seq")
    rows = rows.withColumn("first", F.when(F.col("size") >= min_bytes, F.col("least")).otherwise(own))
    rows.select("seq", _header(date).alias("header"), "digest", _salts(F.col("records")).alias("salts")).write.parquet(f"{root}/headers")
    _store_payloads(pages, payload_col, root)
    return Archive(spark, root)


def archive_records(records: DataFrame, header_col: str = "header", payload_col: str = "payload", root: str | None = None) -> Archive:
    """Store given records (bytes before the payload, payload) in the same two tables."""
    spark = records.sparkSession
    root = root or _folder(spark)
    keys = written(records.select(_bytes(header_col).alias("header"), *_digests(records, payload_col)).withColumn("seq", F.monotonically_increasing_id()))
    counts = written(keys.groupBy("digest").agg(_once(F.col("sha1"), F.col("size"), F.col("digest")).alias("n")).withColumn("records", F.col("n")))
    rows = join_split(keys, counts, "digest", keys.count())
    rows.select("seq", "header", "digest", _salts(F.col("records")).alias("salts")).write.parquet(f"{root}/headers")
    _store_payloads(records, payload_col, root)
    return Archive(spark, root)


def read_records(archive: Archive) -> DataFrame:
    """seq, header, payload, size, sha1 (base32) of every record: its header joined to the stored bytes.

    ``payload`` is the full payload, of revisits too; its digest is computed from the bytes that were read."""
    body = F.col("payload")
    found = F.sha2(body, 256)
    checked = F.when(found == F.col("digest"), F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("stored bytes don't have the digest "), F.col("digest"))))
    stored = archive.payloads.select(checked.alias("digest"), "payload", F.octet_length(body).cast("long").alias("size"), base32(F.sha1(body)).alias("sha1"), "salts")
    stored = stored.select("digest", "payload", "size", "sha1", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    heads = archive.headers.select("seq", "header", "digest", F.pmod(F.xxhash64("seq"), F.col("salts")).cast("int").alias("salt"))
    return heads.join(stored, ["digest", "salt"]).select("seq", "header", "payload", "size", "sha1")


def head_field(name: str) -> Column:
    """Value of a WARC header field, '' where there is none."""
    return F.regexp_extract(F.decode("header", "UTF-8"), rf"(?:^|\r\n){name}: ([^\r\n]*)\r\n", 1)


def warc_bytes(archive: Archive) -> DataFrame:
    """seq, record: the exact bytes of each record as they stand in a WARC file.

    A revisit's block ends after its HTTP head, so its payload isn't repeated."""
    rows = read_records(archive)
    again = head_field("WARC-Type") == "revisit"
    end = F.lit((CRLF + CRLF).encode())
    return rows.select("seq", F.concat("header", F.when(again, F.lit(b"")).otherwise(F.col("payload")), end).alias("record"))


def page_rows(archive: Archive, id_name: str = "page_id") -> DataFrame:
    """One row per record, read from its header and its stored payload; the two digests must agree."""
    stated = F.substring(head_field("WARC-Payload-Digest"), len("sha1:") + 1, 32)
    digest = F.when(stated == F.col("sha1"), F.col("sha1")).otherwise(F.raise_error(F.concat(F.lit("header and payload differ in "), stated)))
    return read_records(archive).select(
        F.nullif(head_field("Page-ID"), F.lit("")).cast("long").alias(id_name),
        F.col("size").alias("payload_bytes"),
        digest.alias("payload_digest"),
        head_field("WARC-Type").alias("record_type"),
        F.nullif(head_field("Refers-To-Page-ID"), F.lit("")).cast("long").alias("refers_to"),
    )


_SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h, coalesce(html, '') AS html FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first_id FROM p)
SELECT page_id, payload_bytes,
       array_to_string([substr('{BASE32}', 1 + ((CAST(('0x' || substr(h, 1 + 5 * (i // 4), 5)) AS BIGINT) >> (15 - 5 * (i % 4))) & 31), 1) for i in range(32)], '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM f
"""


@register("op11_warc_archive", _SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_rows(archive_pages(read(spark, sf_dir, "pages")))
