"""What is under a caret: row equality plus interval containment, for all carets at once.

Regions on one row are cut into buckets of a fixed width and joined with carets on
``(project, filename, row, bucket)``, so a caret meets only the regions near it: no pairs per row, no
nested-loop join.  A long region, of which a minified file may have many, takes buckets that are as much wider as
it is longer: five of them at most, however long it is, and carets look into the widths that there are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import alias_region, region
from . import index as ix
from .joins import join_hashed

BUCKET = 32  # columns
SHORT = 8  # buckets of a region that is not long
WIDER = 4  # times, from one width to the next

# What a caret hits first wins.  Fixed values: the order of tries.
PRIORITY = [
    "local_usage",
    "local_binding",
    "var_usage",
    "var_definition",
    "keyword",
    "namespace_usage",
    "namespace_usage_alias",
    "namespace_definition",
    "java_class_usage",
    "symbol",
]
_TYPE_OF_SEMANTIC = {"local": "local_binding"}
_ROW_OF_FORM = ("local", "keyword", "symbol", "java_class_usage")

REGION = ("start_row", "start_col", "end_row", "end_col")


def hit_regions(records: DataFrame, payload: Sequence[str]) -> DataFrame:
    """Regions a caret can hit: ``hit_type``, ``priority``, ``idx_row``, the region, the record.

    A namespace usage is found under its name row and its alias row, both by its name
    and by its alias.
    """
    sem = F.col("semantic")
    usable = ix.records_of(
        records, "local", "local_usage", "var_usage", "var_definition", "keyword",
        "namespace_usage", "namespace_definition", "java_class_usage", "symbol",
    )

    def hits(found: DataFrame, kind: Column, idx_row: Column, where: Column) -> DataFrame:
        priority = F.lit(None).cast("int")
        for n, name in enumerate(PRIORITY):
            priority = F.when(kind == name, n).otherwise(priority)
        return found.select(
            "project",
            "filename",
            F.col("pos").alias("hit_pos"),
            kind.alias("hit_type"),
            priority.alias("priority"),
            idx_row.alias("idx_row"),
            *(where[c].alias(c) for c in REGION),
            F.struct(*payload).alias("payload"),
        )

    kind = sem
    for semantic, name in _TYPE_OF_SEMANTIC.items():
        kind = F.when(sem == semantic, name).otherwise(kind)
    own_row = F.when(sem.isin(*_ROW_OF_FORM), F.col("row")).otherwise(F.col("name_row"))
    # Aliases add to one kind only, so these branches read that kind's files.
    aliased = ix.records_of(records, "namespace_usage").where(F.col("alias") != "")
    elsewhere = aliased.where(F.col("alias_row") != F.col("name_row"))
    by_alias = F.lit("namespace_usage_alias")
    return (
        hits(usable, kind, own_row, region())
        .unionByName(hits(aliased, by_alias, F.col("alias_row"), alias_region()))
        .unionByName(hits(elsewhere, by_alias, F.col("name_row"), alias_region()))
        .unionByName(hits(elsewhere, sem, F.col("alias_row"), region()))
    )


def _buckets(first: Column, last: Column) -> Column:
    return F.sequence(F.floor(first / BUCKET).cast("int"), F.floor(last / BUCKET).cast("int"))


def _width() -> Column:
    """The least width of which few buckets cover a long region."""
    length = F.col("end_col") - F.col("start_col") + 1
    steps = F.ceil(F.log(float(WIDER), length / (WIDER * BUCKET)))
    return (BUCKET * F.pow(F.lit(float(WIDER)), F.greatest(steps, F.lit(1)))).cast("bigint")


def _wide_buckets() -> Column:
    """``(width, bucket)`` of a long region."""
    width = _width()
    buckets = F.sequence(F.floor(F.col("start_col") / width), F.floor(F.col("end_col") / width))
    return F.transform(buckets, lambda b: F.struct(width.alias("width"), b.alias("wide_bucket")))


def _contains() -> Column:
    """Region contains caret or selection, both ends included."""
    starts = (F.col("start_row") < F.col("begin_row")) | (
        (F.col("start_row") == F.col("begin_row")) & (F.col("start_col") <= F.col("begin_col"))
    )
    ends = (F.col("end_row") > F.col("sel_end_row")) | (
        (F.col("end_row") == F.col("sel_end_row")) & (F.col("end_col") >= F.col("sel_end_col"))
    )
    return starts & ends


def containing(
    regions: DataFrame, carets: DataFrame, keys: Sequence[str] = ("project", "filename")
) -> DataFrame:
    """Pairs of caret and region where the region contains the caret, per ``keys`` and row.

    ``regions`` has ``idx_row`` and the region, ``carets`` has ``begin_row``,
    ``begin_col``, ``sel_end_row`` and ``sel_end_col``.  ``bucket`` stays in the result,
    so grouping by ``(keys, begin_row, bucket, …)`` needs no further shuffle.
    """
    on = [*keys, "begin_row", "bucket"]
    ordered = (F.col("end_row") > F.col("start_row")) | (
        (F.col("end_row") == F.col("start_row")) & (F.col("end_col") >= F.col("start_col"))
    )
    reaching = regions.where(
        ordered & (F.col("start_row") <= F.col("idx_row")) & (F.col("end_row") >= F.col("idx_row"))
    ).withColumnRenamed("idx_row", "begin_row")
    one_row = F.col("start_row") == F.col("end_row")
    is_long = F.col("end_col") - F.col("start_col") >= SHORT * BUCKET
    short = reaching.where(one_row & ~is_long).withColumn(
        "bucket", F.explode(_buckets(F.col("start_col"), F.col("end_col")))
    )
    placed = carets.withColumn("bucket", F.floor(F.col("begin_col") / BUCKET).cast("int"))
    # Carets and regions come file by file and row by row; by further keys they do not, and are sorted by a hash.
    joined = join_hashed(placed, short, on) if set(keys) - set(ix.FILE) else placed.join(short, on)
    near = joined.where(_contains())

    # What there is besides short regions, from one pass over all of them.
    kinds = reaching.agg(
        F.collect_set(F.when(one_row & is_long, _width())).alias("widths"), F.count_if(~one_row).alias("n_several")
    )
    there = kinds.select(F.struct("widths", "n_several")).scalar()

    # Most files have no long region, and then there are no widths to look into and no carets to read.
    long = reaching.where(one_row & is_long).select("*", F.explode(_wide_buckets()).alias("w")).select("*", "w.*").drop("w")
    widths = there["widths"]
    any_long = F.size(widths) > 0
    looking = placed.where(any_long).withColumn("width", F.explode(widths)).withColumn("wide_bucket", F.floor(F.col("begin_col") / F.col("width")))
    wide = looking.join(long, [*keys, "begin_row", "width", "wide_bucket"]).where(_contains())
    near = near.unionByName(wide.select(*near.columns))

    # Regions over several rows reach to the end of the row: rare, compared row by row.
    # Without any, no caret is shuffled for them.
    several = reaching.where(~one_row)
    any_far = there["n_several"] > 0
    far = placed.where(any_far).join(several, [*keys, "begin_row"]).where(_contains())
    return near.unionByName(far.select(*near.columns))


def as_carets(cursors: DataFrame) -> DataFrame:
    return cursors.withColumnsRenamed({"end_row": "sel_end_row", "end_col": "sel_end_col"})


def best_hit(regions: DataFrame, cursors: DataFrame) -> DataFrame:
    """The record each caret is on: first kind by priority, then first in index order."""
    pairs = containing(regions, as_carets(cursors))
    rank = F.struct("priority", "hit_pos")
    what = F.struct("hit_type", "hit_pos", *REGION, "payload")
    return (
        pairs.groupBy("project", "filename", "begin_row", "bucket", "begin_col", "cursor_id")
        .agg(F.min_by(what, rank).alias("hit"))
        .select(
            "cursor_id", "project", "filename", "begin_row", "begin_col",
            "hit.hit_type", "hit.hit_pos", *(f"hit.{c}" for c in REGION), "hit.payload",
        )
    )


# Columns of a hit record that later questions need.
ASKED = [
    "semantic", "ext", "file_ord", "pos", "row", "col", "name_row", "name_col", "name", "ns",
    "from_ns", "to_ns", "local_id", "class_name", "method_name", "symbol", "alias",
    "keys_destructuring",
]


def at_position(records: DataFrame, cursors: DataFrame) -> DataFrame:
    """One row per caret that is on something: the kind of hit, its region, the record."""
    hit = best_hit(hit_regions(records, ASKED), cursors)
    return hit.select(
        "cursor_id", "project", "filename", "begin_row", "begin_col", "hit_type",
        *(F.col(c).alias(f"hit_{c}") for c in REGION), "payload.*",
    )


def destructured_locals(records: DataFrame) -> DataFrame:
    """Keywords that bind locals (``:keys``), with the binding made at the same place."""
    keywords = ix.records_of(records, "keyword").where(F.col("keys_destructuring"))
    where = region()
    asking = keywords.select(
        "project",
        "filename",
        F.col("pos").alias("keyword_pos"),
        F.col("name").alias("keyword_name"),
        where["start_row"].alias("begin_row"),
        where["start_col"].alias("begin_col"),
        where["end_row"].alias("sel_end_row"),
        where["end_col"].alias("sel_end_col"),
    )
    bindings = hit_regions(records.where(F.col("semantic") == "local"), ["semantic", "local_id", "row", "col", "pos"])
    return (
        containing(bindings, asking)
        .groupBy("project", "filename", "begin_row", "bucket", "begin_col", "keyword_pos", "keyword_name")
        .agg(F.min_by(F.struct(*REGION, "payload"), "hit_pos").alias("b"))
        .select(
            "project", "filename", "keyword_pos", "keyword_name", "begin_row", "begin_col",
            *(F.col(f"b.{c}").alias(f"local_{c}") for c in REGION),
            F.col("b.payload.local_id").alias("local_id"),
            F.col("b.payload.pos").alias("local_pos"),
        )
    )
