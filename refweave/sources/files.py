"""Source text from directories and from archives."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

_HELD = 8 << 20  # characters a task decodes before it passes them on


def scan_text(spark: SparkSession, path: str) -> DataFrame:
    """``(filename, content)``, one row per file."""
    return spark.read.text(path, wholetext=True).select(
        F.regexp_replace(F.col("_metadata.file_path"), "^file:", "").alias("filename"),
        F.col("value").alias("content"),
    )


def scan_archives(spark: SparkSession, path: str) -> DataFrame:
    """``(archive, content)`` with the bytes of every archive below ``path``."""
    return (
        spark.read.format("binaryFile").load(path)
        .select(F.regexp_replace("path", "^file:", "").alias("archive"), "content")
    )


def wanted_members(filenames: DataFrame) -> DataFrame:
    """Split ``archive.jar:path/in/jar`` names; anything but two parts names no member."""
    parts = F.split("filename", ":")
    return (
        filenames.where(F.size(parts) == 2)
        .select(parts[0].alias("archive"), parts[1].alias("member"))
        .distinct()
    )


def read_members(archives: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(archive, member, content, error)`` of the wanted members.

    Spark pairs each archive with the list of members wanted from it, so an archive is
    opened once, by one task, and only wanted members are decoded, a bounded number of
    characters at a time.  An archive or member that cannot be read gives a row with the
    ``error`` and no content; other archives of the task are read all the same.
    """
    lists = wanted.groupBy("archive").agg(F.collect_set("member").alias("members"))
    columns = ["archive", "member", "content", "error"]

    def contents(archive: str, content: bytes, members: list[str]) -> Iterator[tuple]:
        try:
            opened = zipfile.ZipFile(io.BytesIO(content))
            present = set(opened.namelist())
        except (zipfile.BadZipFile, OSError, ValueError) as e:
            yield archive, None, None, str(e)
            return
        for member in members:
            if member in present:
                try:
                    yield archive, member, opened.read(member).decode(), None
                except (zipfile.BadZipFile, zlib.error, UnicodeDecodeError, OSError, RuntimeError, NotImplementedError) as e:
                    yield archive, member, None, str(e)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, size = [], 0
        for batch in batches:
            for archive in zip(batch["archive"], batch["content"], batch["members"]):
                for row in contents(*archive):
                    rows.append(row)
                    size += len(row[2] or "")
                    if size > _HELD:
                        yield pd.DataFrame(rows, columns=columns)
                        rows, size = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=columns)

    return archives.join(lists, "archive").select("archive", "content", "members").mapInPandas(
        decode, "archive string, member string, content string, error string"
    )


def pack_members(files: DataFrame) -> DataFrame:
    """``(archive, content)`` with one archive per row of ``files(archive, member, content)``."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            packed = []
            for member, content in zip(batch["member"], batch["content"]):
                buffer = io.BytesIO()
                with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
                    archive.writestr(member, content)
                packed.append(buffer.getvalue())
            yield pd.DataFrame({"archive": batch["archive"], "content": packed})

    return files.select("archive", "member", "content").mapInPandas(
        encode, "archive string, content binary"
    )
