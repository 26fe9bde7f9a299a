import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from copyloom.llm.warc import DamagedArchive, page_member, read_records, record_member, round_trip, write_archives
from copyloom.session import handover_path

COLUMNS = "page_id long, url string, html string"


def brute(rows):
    out, first = [], {}
    for page_id, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 100 and page_id is not None:
            first[data] = min(first.get(data, page_id), page_id)
    for page_id, _, html in rows:
        data = (html or "").encode()
        refers = first.get(data)
        refers = None if refers == page_id else refers
        out.append((page_id, len(data), hashlib.sha256(data).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


def result(df):
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def test_whole_table(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    rows = [(r.page_id, r.url, r.html) for r in pages.collect()]
    assert result(round_trip(pages, 20_000)) == brute(rows)


def test_nulls_ties_repeated_rows_and_long_pages(spark):
    long = "é\r\n\r\nWARC/1.1\r\n" * 40_000
    rows = [(5, "http://a/ü x\r\nX: y", long), (3, None, long), (None, "u", long), (3, None, long), (9, "", None), (8, "", "")]
    rows += [(7, "u", "x" * 99), (6, "u", "x" * 99), (2, "u", "y" * 100), (1, "u", "y" * 100), (None, None, "z" * 200), (None, None, "z" * 200)]
    pages = spark.createDataFrame(rows, COLUMNS).withColumn("digest", F.lit("clash")).withColumn("refers_to", F.lit("clash"))
    assert result(round_trip(pages)) == brute(rows)


def test_empty_table(spark):
    assert round_trip(spark.createDataFrame([], COLUMNS)).count() == 0


def test_archives_are_gzip_members_of_bounded_size(spark, small):
    folder = handover_path(spark, "warc")
    manifest = write_archives(spark.read.parquet(f"{small}/pages.parquet").coalesce(1), folder, 10_000).collect()
    assert len(manifest) > 3 and sum(m.records for m in manifest) == 50
    for m in manifest:
        data = open(f"{folder.removeprefix('file://')}/{m.archive}", "rb").read()
        assert len(data) == m.bytes < 10_000 + 60_000
        assert gzip.decompress(data).count(b"WARC-Type: ") == m.records + 1


def damaged(data):
    with pytest.raises(DamagedArchive):
        list(read_records(io.BytesIO(data)))


def test_reader_refuses_damage():
    payload = b"abc" * 100_000
    good = page_member(1, "http://a/", payload, hashlib.sha256(payload).hexdigest(), None)
    assert [r.payload for r in read_records(io.BytesIO(good * 3))] == [payload] * 3
    damaged(good[:-9])
    damaged(good + b"plain text")
    damaged(good[:200] + bytes([good[200] ^ 255]) + good[201:])
    damaged(page_member(1, "u", payload, "0" * 64, None))
    damaged(gzip.compress(b"WARC/1.1\r\nContent-Length: 5\r\n\r\nabc\r\n\r\n"))
    damaged(gzip.compress(b"WARC/1.1\r\nno length: 5\r\n\r\nabc\r\n\r\n"))
    damaged(record_member({"WARC-Type": "response", "WARC-Payload-Digest": "sha256:0"}, b"HTTP\r\n\r\nx"))
