"""WARC archives as chunked records: written and read with Spark's text files.

A payload is cut into segments of at most ``CHUNK`` characters; each segment is a WARC
record of its own (the first of its type, the others ``continuation``, with
segment numbers and the digest of their block).  So a row of the chunk table is a
record identifier, a segment number and a bounded piece, in the files and in memory.
Payloads of one segment are digested in place; those of more are streamed in order
through an incremental digest, which holds one piece at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from refweave.llm.common import bounded_batches
from refweave.operators.joins import join_unique

CHUNK = 1 << 20
SHARED_FROM = 100  # bytes: smaller payloads are never revisits
# Fixed values of the format.
_VERSION = "WARC/1.1\r\n"
_END = "\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_DATE = "2000-01-01T00:00:00Z"  # reruns write the same bytes


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def _record_id(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(">"))


def _pieces(payload: Column, chunk: int) -> Column:
    """The payload in pieces of at most ``chunk`` characters; none holds the line that begins a record."""
    safe = F.when(
        F.contains(payload, F.lit(_VERSION)), F.split(payload, r"(?<=WA)(?=RC/1\.1\r\n)")
    ).otherwise(F.array(payload))
    return F.flatten(
        F.transform(
            safe,
            lambda part: F.when(F.length(part) <= chunk, F.array(part)).otherwise(
                F.regexp_extract_all(part, F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0))
            ),
        )
    )


def records(pages: DataFrame, page: str, url: str, html: str, chunk: int = CHUNK) -> DataFrame:
    """``(record)``: one string per WARC record, without the last line end.

    Of rows with equal payloads of at least ``SHARED_FROM`` bytes, the one with the
    smallest page is a response and the others are revisits of it.  A null payload is
    empty.  A null page is never the smallest, unless there is no other, and then each
    is a response.  Repeated rows of the smallest page are all responses.
    """
    payload = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(
        F.col(page).alias("page"),
        F.regexp_replace(F.coalesce(F.col(url), F.lit("")), r"[\x00-\x20\x7F]", "%20").alias("url"),
        payload.alias("payload"),
        F.sha2(payload, 256).alias("digest"),
        F.octet_length(payload).cast("bigint").alias("n"),
    )
    shared = (
        rows.where(F.col("n") >= SHARED_FROM).groupBy("digest").agg(F.min("page").alias("first"), F.count("*").alias("c"))
        .where("c > 1").select("digest", "first")
    )
    # Small payloads take no part, though their digests would not be found anyway.
    rows = join_unique(rows, shared, ["digest"], "left").withColumn(
        "revisits", F.col("first").isNotNull() & ~F.col("page").eqNullSafe(F.col("first"))
    )
    pieces = F.when(F.col("revisits"), F.array(F.lit(""))).otherwise(_pieces(F.col("payload"), chunk))
    # The row number keeps apart the segments of rows that share a page.
    rows = rows.withColumns({"row": F.monotonically_increasing_id(), "pieces": pieces})
    rows = rows.withColumn("segments", F.size("pieces"))
    rows = rows.select("page", "url", "digest", "n", "first", "revisits", "row", "segments", F.posexplode("pieces").alias("k", "piece"))
    head, last = F.col("k") == 0, F.col("k") == F.col("segments") - 1
    parted, none = F.col("segments") > 1, F.lit("")
    block = F.when(F.col("revisits") | ~head, F.col("piece")).otherwise(F.concat(F.lit(_HTTP), F.col("piece")))
    rows = rows.withColumn("block", block)
    number = (F.col("k") + 1).cast("string")
    return rows.select(
        F.concat(
            F.lit(_VERSION),
            _line("WARC-Type", F.when(F.col("revisits"), "revisit").when(head, "response").otherwise("continuation")),
            _line("WARC-Record-ID", F.when(head, _record_id(F.col("page"))).otherwise(
                F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page").cast("string"), F.lit("none")), F.lit(":"), number, F.lit(">"))
            )),
            _line("WARC-Date", F.lit(_DATE)),
            _line("WARC-Target-URI", F.col("url")),
            F.when(head, _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest")))).otherwise(none),
            _line("WARC-Block-Digest", F.concat(F.lit("sha256:"), F.sha2("block", 256))),
            F.when(F.col("revisits"), F.concat(
                _line("WARC-Profile", F.lit(_PROFILE)), _line("WARC-Refers-To", _record_id(F.col("first")))
            )).otherwise(none),
            F.when(parted, _line("WARC-Segment-Number", number)).otherwise(none),
            F.when(parted & ~head, _line("WARC-Segment-Origin-ID", _record_id(F.col("page")))).otherwise(none),
            F.when(parted & last, _line("WARC-Segment-Total-Length", (F.col("n") + len(_HTTP)).cast("string"))).otherwise(none),
            F.when(parted, _line("X-Row", F.col("row").cast("string"))).otherwise(none),
            F.when(head & ~F.col("revisits"), F.lit("Content-Type: application/http;msgtype=response\r\n")).otherwise(none),
            _line("Content-Length", F.octet_length("block").cast("string")),
            F.lit("\r\n"),
            F.col("block"),
            F.lit("\r\n"),
        ).alias("record")
    )


def write(pages: DataFrame, folder: str, page: str, url: str, html: str, chunk: int = CHUNK) -> None:
    """Write the archives: one gzip file per task, to any file system Spark reaches."""
    records(pages, page, url, html, chunk).write.text(folder, compression="gzip", lineSep="\r\n")


def read_segments(spark: SparkSession, folder: str) -> DataFrame:
    """The chunk table of archives: one row per WARC record.

    ``(type, record, refers_to, row, segment, parted, declared, data, intact)``; ``record`` is that
    of the first segment, ``data`` the part of the payload, ``intact`` whether length and digest of
    the block are as its header says.  Archives must not hold a record's first line inside a block.
    """
    lines = spark.read.text(folder, lineSep=_END + _VERSION)
    head = F.substring_index("value", _END, 1)

    def field(name: str) -> Column:
        found = F.regexp_extract("head", rf"(?m)^{name}: ([^\r\n]*)", 1)
        return F.when(found != "", found)

    rows = lines.select(head.alias("head"), F.expr("substring(value, length(substring_index(value, '\\r\\n\\r\\n', 1)) + 5)").alias("tail"))
    rows = rows.withColumns({"length": field("Content-Length").cast("bigint"), "n": F.octet_length("tail")})
    # The last record of a file still has its line ends.
    block = F.when(F.col("n") == F.col("length") + 4, F.expr("left(tail, length(tail) - 4)")).otherwise(F.col("tail"))
    rows = rows.withColumns({"block": block, "kind": field("WARC-Type")})
    http = (F.col("kind") == "response") & F.startswith("block", F.lit("HTTP/"))
    body = F.expr("substring(block, length(substring_index(block, '\\r\\n\\r\\n', 1)) + 5)")
    segment = field("WARC-Segment-Number").cast("int")
    return rows.select(
        F.col("kind").alias("type"),
        F.coalesce(field("WARC-Segment-Origin-ID"), field("WARC-Record-ID")).alias("record"),
        field("WARC-Refers-To").alias("refers_to"),
        field("X-Row").cast("bigint").alias("row"),
        F.coalesce(segment, F.lit(1)).alias("segment"),
        segment.isNotNull().alias("parted"),
        F.expr("substring_index(regexp_extract(head, 'WARC-Payload-Digest: ([^\\r\\n]*)', 1), ':', -1)").alias("declared"),
        F.when(http, body).otherwise(F.col("block")).alias("data"),
        (
            (F.octet_length("block") == F.col("length"))
            & (F.concat(F.lit("sha256:"), F.sha2("block", 256)) == field("WARC-Block-Digest"))
        ).alias("intact"),
    )


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest runs of rows of one record, piece by piece; the rows come in order."""
    kind = pa.schema([("record", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("whole", pa.bool_())])
    at, digest, n, expected, whole = None, None, 0, 1, True
    for batch in batches:
        out = []
        columns = [batch.column(c) for c in ("record", "row", "segment", "data", "intact")]
        for record, row, segment, data, intact in zip(*columns, strict=True):
            key = (record.as_py(), row.as_py())
            if key != at:
                if at is not None:
                    out.append((at[0], n, digest.hexdigest(), whole))
                at, digest, n, expected, whole = key, hashlib.sha256(), 0, 1, True
            piece = data.as_buffer()
            digest.update(piece)
            n += piece.size
            whole &= bool(intact.as_py()) and segment.as_py() == expected
            expected += 1
        yield pa.RecordBatch.from_pylist([dict(zip(kind.names, x, strict=True)) for x in out], schema=kind)
    if at is not None:
        yield pa.RecordBatch.from_pylist(
            [dict(zip(kind.names, (at[0], n, digest.hexdigest(), whole), strict=True))], schema=kind
        )


def payloads(segments: DataFrame) -> DataFrame:
    """``(record, payload_bytes, payload_digest, whole)`` of every response in a chunk table.

    ``whole`` is false if a piece is missing, out of order or not intact.
    """
    bounded_batches(segments.sparkSession)
    data = segments.where("type in ('response', 'continuation')")
    single = data.where("not parted").select(
        "record",
        F.octet_length("data").cast("bigint").alias("payload_bytes"),
        F.sha2("data", 256).alias("payload_digest"),
        F.col("intact").alias("whole"),
    )
    order = ["record", "row", "segment"]
    parts = (
        data.where("parted").select(*order, F.col("data").cast("binary").alias("data"), "intact")
        .repartition("record", "row").sortWithinPartitions(*order)
    )
    schema = "record string, payload_bytes bigint, payload_digest string, whole boolean"
    return single.unionByName(parts.mapInArrow(_stream, schema))


def read(spark: SparkSession, folder: str, page_type: str = "bigint") -> DataFrame:
    """One row per page of archives written by :func:`write`.

    ``(page_id, payload_bytes, payload_digest, record_type, refers_to, whole)``; a revisit has the
    figures of the response that it refers to.
    """
    segments = read_segments(spark, folder)
    found = payloads(segments)

    def page(column: str) -> Column:
        return F.expr(f"try_cast(regexp_extract({column}, '^<urn:page:(.*)>$', 1) as {page_type})")

    by_record = found.groupBy("record").agg(
        F.min("payload_bytes").alias("payload_bytes"), F.min("payload_digest").alias("payload_digest"), F.min("whole").alias("whole")
    ).withColumnRenamed("record", "refers_to")
    revisits = join_unique(
        segments.where("type = 'revisit'").select("record", "refers_to"), by_record, ["refers_to"], "left"
    )
    figures = ["payload_bytes", "payload_digest"]
    return found.select(
        page("record").alias("page_id"), *figures, F.lit("response").alias("record_type"),
        F.lit(None).cast(page_type).alias("refers_to"), "whole",
    ).unionByName(revisits.select(
        page("record").alias("page_id"), *figures, F.lit("revisit").alias("record_type"),
        page("refers_to").alias("refers_to"), "whole",
    ))
