import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from digestry.llm import warc

SCHEMA = "page_id long, url string, html string, seq int, header string, digest string, payload string, n long, id string"


def frame(spark, rows, n=3):
    return spark.createDataFrame([(*r, 5, "h", "d", "p", 7, "i") for r in rows], SCHEMA).repartition(n)


def brute(rows, min_bytes=0):
    bodies = [(r[0], (r[2] or "").encode()) for r in rows]
    least, out, taken = {}, [], set()
    for i, b in bodies:
        key = (i is None, i or 0)
        least[b] = min(least.get(b, key), key)
    for i, b in bodies:
        first = len(b) < min_bytes or (least[b] == (i is None, i or 0) and b not in taken)
        if first and len(b) >= min_bytes:
            taken.add(b)
        sha = base64.b32encode(hashlib.sha1(b).digest()).decode()
        out.append((i, len(b), sha, "response" if first else "revisit", None if first or least[b][0] else least[b][1]))
    return sorted(out, key=repr)


def check(spark, rows, min_bytes=0):
    archive = warc.archive_pages(frame(spark, rows), min_bytes=min_bytes)
    got = warc.page_rows(archive)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, min_bytes)
    assert archive.payloads.count() == len({r[2] or "" for r in rows})
    return archive


ROWS = [(1, "http://a/", "x" * 500), (2, "http://b/", "x" * 500), (7, None, "x" * 500), (5, "http://c/é\r\nWARC-Type: x", "grüße\r\n\r\nWARC/1.1"),
        (4, "http://d/", None), (3, "http://e/", ""), (None, "http://f/", "alone"), (None, "http://g/", "x" * 500), (9, "http://h/", "alone"), (9, "http://h/", "alone"),
        (11, "", "WARC-Type: revisit\r\n"), (12, "http://long/", "long " * 200_000)]


def parse(record: bytes):
    """(fields, HTTP head, payload) of one WARC record, by the format's own rules."""
    head, rest = record.split(b"\r\n\r\n", 1)
    lines = head.decode().split("\r\n")
    assert lines[0] == "WARC/1.1"
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block, end = rest[: int(fields["Content-Length"])], rest[int(fields["Content-Length"]) :]
    assert end == b"\r\n\r\n"
    http, body = block.split(b"\r\n\r\n", 1)
    return fields, http, body


def test_rows_and_records(spark):
    archive = check(spark, ROWS)
    records = [parse(bytes(r.record)) for r in warc.warc_bytes(archive).collect()]
    assert len(records) == len({f["WARC-Record-ID"] for f, _, _ in records}) == len(ROWS)
    by_id = {f["WARC-Record-ID"]: (f, body) for f, _, body in records}
    texts = {str(r[0]): (r[2] or "").encode() for r in ROWS if r[0] is not None}
    for fields, http, body in records:
        if fields["WARC-Type"] == "revisit":
            assert body == b""
            first, body = by_id[fields["WARC-Refers-To"]]
            assert first["WARC-Type"] == "response" and first["WARC-Payload-Digest"] == fields["WARC-Payload-Digest"]
        assert fields["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert f"Content-Length: {len(body)}" in http.decode()
        if "Page-ID" in fields:
            assert texts[fields["Page-ID"]] == body
    assert any(f.get("WARC-Target-URI") == "http://c/é%0D%0AWARC-Type:%20x" for f, _, _ in records)


def test_smaller_payloads_are_all_responses(spark):
    check(spark, ROWS, min_bytes=6)


def test_hot_payload(spark, monkeypatch):
    monkeypatch.setattr(warc, "SALT_ROWS", 7)
    rows = [(i, f"http://{i}/", "hot") for i in range(300)] + [(1000 + i, "u", f"p{i}") for i in range(200)]
    archive = check(spark, rows)
    assert archive.headers.agg(F.max("salts")).first()[0] == 43


def test_empty_table(spark):
    check(spark, [])


def test_given_records_come_back_exactly(spark):
    rows = [(bytes([i, 0, 255 - i]), (b"\x00\xffsame" if i % 3 else bytes(range(i)))) for i in range(60)] + [(None, None), (b"", b"")]
    archive = warc.archive_records(spark.createDataFrame(rows, "header binary, payload binary"))
    got = sorted((bytes(r.header), bytes(r.payload)) for r in warc.read_records(archive).collect())
    assert got == sorted((h or b"", p or b"") for h, p in rows)
    assert archive.payloads.count() == len({p or b"" for _, p in rows})


def test_changed_bytes_are_noticed(spark):
    archive = check(spark, ROWS)
    changed = archive.payloads.withColumn("payload", F.when(F.octet_length("payload") == 500, F.lit(b"y" * 500)).otherwise(F.col("payload")))
    other = warc.Archive(spark, warc._folder(spark))
    changed.write.parquet(f"{other.root}/payloads")
    archive.headers.write.parquet(f"{other.root}/headers")
    with pytest.raises(Exception, match="stored bytes don't have the digest"):
        warc.page_rows(other).collect()


def test_base32(spark):
    values = ["", "a", "é" * 99]
    got = spark.createDataFrame([(v,) for v in values], "v string").select(warc.base32(F.sha1(F.col("v").cast("binary")))).collect()
    assert [r[0] for r in got] == [base64.b32encode(hashlib.sha1(v.encode()).digest()).decode() for v in values]
