import hashlib

import pytest
from pyspark.sql import functions as F

from refweave.llm import warc
from refweave.session import scratch

SCHEMA = "page_id bigint, url string, html string, extra int"
EVIL = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n" * 3
PAGES = [
    (5, "http://a", "é" * 60, 1),
    (3, "http://b\r\nX: y", "é" * 60, 1),
    (9, None, "é" * 60, 1),
    (1, "u", None, None),
    (2, "u", "", None),
    (4, "u", "short", 1),
    (6, "u", "short", 1),
    (7, "u", "ab\r\ncdé\n" * 5000, 1),
    (8, "u", "ab\r\ncdé\n" * 5000, 1),
    (8, "u", "ab\r\ncdé\n" * 5000, 1),
    (10, "u", EVIL, 1),
    (11, "u", "WARC/1.1\r\n" * 30, 1),
    (12, "u", "\r\n\r\n" * 40, 1),
    (12, "u", "\r\n\r\n" * 40, 1),
    (None, "u", "é" * 60, 1),
    (None, "u", "z" * 200, 1),
]


def expected(pages):
    first = {}
    for page, _, html, _ in pages:
        payload = (html or "").encode()
        if len(payload) >= 100 and page is not None:
            first[payload] = min(page, first.get(payload, page))
    out = []
    for page, _, html, _ in pages:
        payload = (html or "").encode()
        to = first.get(payload)
        revisit = to is not None and to != page
        out.append((page, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if revisit else "response", to if revisit else None, True))
    return sorted(out, key=str)


@pytest.mark.parametrize("chunk", [warc.CHUNK, 7, 1000])
def test_round_trip(spark, chunk):
    folder = scratch(spark, "warc")
    warc.write(spark.createDataFrame(PAGES, SCHEMA).coalesce(2), folder, "page_id", "url", "html", chunk)
    assert sorted(map(tuple, warc.read(spark, folder).collect()), key=str) == expected(PAGES)


def test_blocks_follow_the_format(spark):
    pages = spark.createDataFrame(PAGES, SCHEMA)
    for r in warc.records(pages, "page_id", "url", "html", 100).collect():
        head, _, block = r.record.partition("\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.split("\r\n")[1:])
        assert int(fields["Content-Length"]) == len(block[:-2].encode())
        assert "WARC/1.1\r\n" not in block


def test_damage_shows(spark):
    folder = scratch(spark, "warc")
    warc.write(spark.createDataFrame(PAGES, SCHEMA).coalesce(1), folder, "page_id", "url", "html", 1000)
    segments = warc.read_segments(spark, folder)
    broken = segments.where("not (record = '<urn:page:7>' and segment = 2)").withColumn(
        "data", F.when(F.col("record") != "<urn:page:4>", F.col("data")).otherwise(F.lit("shorT"))
    )
    got = {r.record: r for r in warc.payloads(broken).collect()}
    assert not got["<urn:page:7>"].whole and got["<urn:page:5>" if "<urn:page:5>" in got else "<urn:page:3>"].whole
    assert got["<urn:page:4>"].payload_digest == hashlib.sha256(b"shorT").hexdigest()


def test_empty_table(spark):
    folder = scratch(spark, "warc")
    warc.write(spark.createDataFrame([], SCHEMA), folder, "page_id", "url", "html")
    assert warc.read(spark, folder).count() == 0
