"""Positions in source text.  One row per file in, arrays out; cost grows linearly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

_BLOCK = 256  # elements per block of a two-level prefix sum
_PIECE = 256  # characters per stored piece of a file


def running_starts(lengths: Column) -> Column:
    """Exclusive prefix sums of an int array (``[3, 1, 2] -> [0, 3, 4]``).

    Appending to an array copies it, so a plain fold is quadratic; folding within
    blocks and then over block totals keeps long inputs cheap.
    """

    def starts(values: Column, first: Column) -> Column:
        return F.aggregate(
            values,
            F.struct(F.array().cast("array<int>").alias("starts"), first.cast("int").alias("at")),
            lambda acc, n: F.struct(
                F.concat(acc["starts"], F.array(acc["at"])).alias("starts"),
                (acc["at"] + n).cast("int").alias("at"),
            ),
            lambda acc: acc["starts"],
        )

    n_blocks = F.ceil(F.size(lengths) / _BLOCK).cast("int")
    blocks = F.transform(
        F.sequence(F.lit(0), n_blocks - 1), lambda b: F.slice(lengths, b * _BLOCK + 1, F.lit(_BLOCK))
    )
    totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, n: a + n))
    block_starts = starts(totals, F.lit(0))
    long_input = F.flatten(F.transform(F.arrays_zip(blocks.alias("b"), block_starts.alias("s")),
                                       lambda z: starts(z["b"], z["s"])))
    return F.when(F.size(lengths) <= _BLOCK, starts(lengths, F.lit(0))).otherwise(long_input)


def line_starts(content: Column) -> Column:
    """Offset of the first character of every line."""
    return running_starts(F.transform(F.split(content, "\n"), lambda line: F.length(line) + 1))


def pieces(content: Column) -> Column:
    """The text cut into equal pieces, so that a region is read without a scan from the start."""
    return F.regexp_extract_all(content, F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0))


def text_between(content_pieces: Column, a: Column, b: Column) -> Column:
    """Characters ``a`` (inclusive) to ``b`` (exclusive) of a text cut by :func:`pieces`."""
    first = F.floor(a / _PIECE).cast("int")
    last = F.floor((b - 1) / _PIECE).cast("int")
    window = F.array_join(F.slice(content_pieces, first + 1, last - first + 1), "")
    return F.when(b > a, F.substring(window, a - first * _PIECE + 1, b - a)).otherwise("")


def offset(starts: Column, row: Column, col: Column) -> Column:
    """Character offset of a 1-based position; null outside the file."""
    return F.when((row >= 1) & (row <= F.size(starts)), F.element_at(starts, row) + col - 1)


def with_offsets(regions: DataFrame, files: DataFrame, text: bool = False) -> DataFrame:
    """Add offsets ``a`` and ``b`` of ``start_row .. end_col`` and, if asked, the region's text.

    ``files(project, filename, content)`` has one row per file, so the join adds no rows.
    """
    lines = files.select(
        "project",
        "filename",
        line_starts(F.col("content")).alias("_starts"),
        *([pieces(F.col("content")).alias("_pieces")] if text else []),
    )
    joined = regions.join(lines, ["project", "filename"])
    out = joined.withColumns(
        {
            "a": offset(F.col("_starts"), F.col("start_row"), F.col("start_col")),
            "b": offset(F.col("_starts"), F.col("end_row"), F.col("end_col")),
        }
    )
    if text:
        out = out.withColumn("region_text", text_between(F.col("_pieces"), F.col("a"), F.col("b")))
    return out.drop("_starts", "_pieces")
