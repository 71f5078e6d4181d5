"""Lists of named things: outlines, catalogues, namespace usages."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import is_registering, label, qualified_name
from . import index as ix
from .dedupe import dedupe
from .joins import join_unique
from .scopes import in_scope

# List order of kinds.  Fixed values.
_KINDS = ["namespace_definition", "var_definition", "keyword"]


def anything(records: DataFrame, kinds: tuple[str, ...] = tuple(_KINDS)) -> DataFrame:
    """Definitions worth listing, with ``kind_ord``: namespaces, vars, registering keywords."""
    sem = F.col("semantic")
    kind_ord = F.lit(None).cast("int")
    for n, kind in enumerate(_KINDS):
        kind_ord = F.when(sem == kind, n).otherwise(kind_ord)
    return (
        ix.records_of(records, *kinds)
        .where((sem != "keyword") | is_registering())
        .withColumn("kind_ord", kind_ord)
    )


def outline(records: DataFrame) -> DataFrame:
    """What each file defines, one row per place."""
    listed = anything(records).select(
        "project", "filename", "row", "col", "semantic", "kind_ord", "file_ord", "pos",
        label(show_namespace=False).alias("label"),
    )
    return dedupe(listed, ["project", "filename"], ["kind_ord", "file_ord", "pos"])


def catalog(records: DataFrame, kinds: tuple[str, ...] = tuple(_KINDS)) -> DataFrame:
    """What each project defines, one row per place, with the name it is listed by."""
    listed = anything(records, kinds).select(
        "project", "filename", "row", "col", "semantic", "kind_ord", "file_ord", "pos",
        qualified_name().alias("qualified_name"),
        label(show_namespace=True).alias("label"),
    )
    return dedupe(listed, ["project"], ["kind_ord", "file_ord", "pos"])


def by_name(listed: DataFrame) -> DataFrame:
    """Sorted by project and name; nameless entries last."""
    return listed.orderBy("project", F.col("qualified_name").asc_nulls_last(), "list_ord")


def by_place(listed: DataFrame) -> DataFrame:
    return listed.orderBy("project", "filename", "row", "col")


def catalogues(records: DataFrame) -> DataFrame:
    """The four project-wide lists: anything, keywords and namespaces of libraries,
    namespaces of the sources."""
    libraries, sources = in_scope(records, "classpath"), in_scope(records, "paths")
    lists = {
        "anything-classpath": catalog(libraries),
        "keyword-classpath": catalog(libraries, ("keyword",)),
        "namespace-classpath": catalog(libraries, ("namespace_definition",)),
        "namespace-paths": catalog(sources, ("namespace_definition",)),
    }
    named = [df.withColumn("list", F.lit(name)) for name, df in lists.items()]
    out = named[0]
    for df in named[1:]:
        out = out.unionByName(df)
    return out


def catalog_view_paths(
    views: DataFrame, paths: DataFrame, kinds: tuple[str, ...] = tuple(_KINDS)
) -> DataFrame:
    """Sources of a project if it has any records, else what its open views hold.

    ``views`` and ``paths`` are records of those scopes.  Whether a project has
    sources is one row per project, so the choice is a semi or anti join.
    """
    indexed = paths.select("project").distinct()
    chosen = paths.withColumn("from_scope", F.lit("paths")).unionByName(
        join_unique(views, indexed, ["project"], "left_anti").withColumn("from_scope", F.lit("view"))
    )
    listed = anything(chosen, kinds).select(
        "project", "from_scope", "filename", "row", "col", "semantic", "kind_ord", "file_ord", "pos",
        qualified_name().alias("qualified_name"),
    )
    return dedupe(listed, ["project", "from_scope"], ["kind_ord", "file_ord", "pos"])
