"""Lint findings: regions to draw, counts, and the status line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import finding_region, label
from . import index as ix

DRAWN_LEVELS = ("error", "warning")


def findings(records: DataFrame) -> DataFrame:
    """All findings, of every level, with their list entry."""
    return ix.records_of(records, "finding").withColumn("label", label())


def finding_regions(records: DataFrame) -> DataFrame:
    """Regions of errors and warnings; other levels are not drawn."""
    return (
        ix.records_of(records, "finding")
        .where(F.col("level").isin(*DRAWN_LEVELS))
        .select("project", "filename", "level", "message", "pos", finding_region().alias("region"))
    )


def status_line(errors: Column, warnings: Column) -> Column:
    """``Errors: 2, Warnings: 1``, without parts that are zero or missing."""
    return F.concat_ws(
        ", ",
        F.when(errors > 0, F.concat(F.lit("Errors: "), errors)),
        F.when(warnings > 0, F.concat(F.lit("Warnings: "), warnings)),
    )


def finding_summary(records: DataFrame) -> DataFrame:
    """Errors and warnings per file; files without any have an empty status."""
    level = F.col("level")
    return (
        records.groupBy("project", "filename")
        .agg(F.count_if(level == "error").alias("errors"), F.count_if(level == "warning").alias("warnings"))
        .withColumn("status", status_line(F.col("errors"), F.col("warnings")))
    )


def findings_by_severity(records: DataFrame) -> DataFrame:
    """Per file, the number of regions of each severity."""
    return (
        finding_regions(records)
        .groupBy("project", "filename")
        .pivot("level", list(DRAWN_LEVELS))
        .agg(F.count("message"))
        .na.fill(0)
    )
