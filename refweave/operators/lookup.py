"""Definitions and usages of everything, as joins of targets with entries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import definition_extensions, lookup_key, own_extension
from . import index as ix
from .index import FILE, FOUND, PROJECT, TARGET
from .joins import join_hashed, join_unique


def answers(
    asked: DataFrame,
    probes,
    entries: DataFrame,
    unit: Sequence[str] = PROJECT,
    carry: Sequence[str] = ("n_asked",),
) -> DataFrame:
    """Join distinct targets with what is found under their keys.

    Targets are unique per key, so a key that holds a third of all rows is skewed on
    the found side only, which adaptive execution splits.
    """
    found = [c for c in FOUND if c not in unit]
    probed = asked.select(*unit, TARGET, *carry, F.explode(probes).alias("p")).select(
        *unit, TARGET, *carry, "p.branch", "p.key"
    )
    return join_hashed(probed, entries.select(*unit, "key", *found), [*unit, "key"]).drop("key")


def find_usages(asking: DataFrame, records: DataFrame, unit: Sequence[str] = PROJECT) -> DataFrame:
    """All usages of whatever the asking records are."""
    asked = ix.targets(ix.usage_target(asking), unit)
    return answers(asked, ix.usage_probes(), ix.usage_entries(records), unit)


def find_definitions(
    asking: DataFrame, records: DataFrame, unit: Sequence[str] = PROJECT
) -> DataFrame:
    """All definitions of whatever the asking records use."""
    asked = ix.targets(ix.definition_target(asking), unit)
    return answers(asked, ix.definition_probes(), ix.definition_entries(records), unit)


def keyword_occurrences(records: DataFrame, unit: Sequence[str] = PROJECT) -> DataFrame:
    """Every keyword with all places it occurs, defining places included."""
    keywords = ix.records_of(records, "keyword")
    asked = ix.targets(ix.usage_target(keywords), unit)
    return answers(asked, ix.usage_probes(), ix.usage_entries(keywords, registering=True), unit)


def keyword_usages(records: DataFrame, unit: Sequence[str] = PROJECT) -> DataFrame:
    keywords = ix.records_of(records, "keyword")
    return find_usages(keywords, keywords, unit)


def keyword_definitions(records: DataFrame, unit: Sequence[str] = PROJECT) -> DataFrame:
    keywords = ix.records_of(records, "keyword")
    return mark_first(find_definitions(keywords, keywords, unit), unit)


def var_usages(records: DataFrame, unit: Sequence[str] = PROJECT) -> DataFrame:
    """Usages of every var asked for, var usages before symbols."""
    return find_usages(ix.records_of(records, "var_definition", "var_usage"), records, unit)


def symbol_usages(records: DataFrame, unit: Sequence[str] = PROJECT) -> DataFrame:
    """The same symbols, then usages of the var the symbol names."""
    return find_usages(ix.records_of(records, "symbol"), records, unit)


def symbol_definitions(records: DataFrame, unit: Sequence[str] = PROJECT) -> DataFrame:
    """Vars a symbol names; the first one is marked."""
    return mark_first(find_definitions(ix.records_of(records, "symbol"), records, unit), unit)


def java_usages(records: DataFrame, unit: Sequence[str] = PROJECT) -> DataFrame:
    """Usages of a class; asked with a method, only usages with that method."""
    return find_usages(ix.records_of(records, "java_class_usage"), records, unit)


def java_definitions(asking: DataFrame, records: DataFrame, unit: Sequence[str] = PROJECT) -> DataFrame:
    """The definition of each class asked for: the last one under its name, or none."""
    keep = [c for c in FOUND if c not in unit]
    defs = (
        ix.records_of(records, "java_class_definition")
        .groupBy(*unit, "class_name")
        .agg(F.max_by(F.struct(*keep), ix.order()).alias("definition"))
    )
    asked = (
        asking.where(F.col("semantic").isin("java_class_usage", "java_class_definition"))
        .groupBy(*unit, "class_name")
        .agg(F.count("*").alias("n_asked"))
    )
    return asked.join(defs, [*unit, "class_name"], "left")


def namespace_usages(records: DataFrame, unit: Sequence[str] = PROJECT) -> DataFrame:
    asking = ix.records_of(records, "namespace_definition", "namespace_usage")
    return find_usages(asking, records, unit)


def var_definitions(records: DataFrame, unit: Sequence[str] = PROJECT) -> DataFrame:
    """Definitions of every var asked for, by a definition or by a usage."""
    asking = ix.records_of(records, "var_definition", "var_usage").withColumn(
        TARGET, lookup_key("var", F.coalesce("ns", "to_ns"), F.col("name"))
    )
    return answers(
        ix.targets(asking, unit), ix.definition_probes(), ix.definition_entries(records), unit
    )


def namespace_definitions(records: DataFrame, unit: Sequence[str] = PROJECT) -> DataFrame:
    asking = ix.records_of(records, "namespace_definition", "namespace_usage").withColumn(
        TARGET, lookup_key("namespace", F.coalesce("name", "to_ns"), F.lit(None).cast("string"))
    )
    return answers(
        ix.targets(asking, unit), ix.definition_probes(), ix.definition_entries(records), unit
    )


def namespace_vars(records: DataFrame, unit: Sequence[str] = PROJECT) -> DataFrame:
    """Usages of any var of a namespace, for every namespace a file or a require names.

    ``group_ord`` is the place at which the usage's var was first seen.
    """
    asked = (
        ix.records_of(records, "namespace_definition", "namespace_usage")
        .groupBy(*unit, F.coalesce("name", "to_ns").alias("to_ns"))
        .agg(F.count("*").alias("n_asked"))
    )
    used = ix.records_of(records, "var_usage")
    first_seen = used.groupBy(*unit, "to_ns", "name").agg(F.min(ix.order()).alias("group_ord"))
    found = used.select(*unit, "to_ns", "name", *[c for c in FOUND if c not in unit])
    return join_unique(
        join_unique(found, asked, [*unit, "to_ns"]), first_seen, [*unit, "to_ns", "name"]
    )


def local_bindings(records: DataFrame) -> DataFrame:
    """Every usage of a local with its binding, which may be unknown."""
    bindings = ix.last_bindings(records).select(
        *FILE, "local_id", F.struct("row", "col", "end_row", "end_col", "pos").alias("binding")
    )
    usages = ix.records_of(records, "local_usage")
    return usages.select(*FILE, "local_id", "row", "col", "pos").join(
        bindings, [*FILE, "local_id"], "left"
    )


def local_usages(records: DataFrame) -> DataFrame:
    return find_usages(ix.records_of(records, "local", "local_usage"), records, PROJECT)


def mark_first(found: DataFrame, unit: Sequence[str] = PROJECT) -> DataFrame:
    """Flag the first row of each target in index order."""
    order_ = F.struct("branch", *ix.ORD)
    first = found.groupBy(*unit, TARGET).agg(F.min(order_).alias("_first"))
    return (
        join_unique(found, first, [*unit, TARGET])
        .withColumn("is_first", order_ == F.col("_first"))
        .drop("_first")
    )


def first_definition(
    asking: DataFrame,
    definitions: DataFrame,
    keys: Sequence[str],
    unit: Sequence[str] = PROJECT,
    payload: Sequence[str] = ("filename", "row", "col", "file_ord", "pos"),
) -> DataFrame:
    """First definition under ``keys`` in a file whose extension fits the asker's.

    ``asking`` and ``definitions`` carry the ``keys``.  Definitions shrink to one row
    per key and extension and questions to one row per key and extension before they
    meet; the answer then joins each asking row once.
    """
    key = lookup_key("", *(F.col(k) for k in keys))
    firsts = (
        definitions.select(*unit, key.alias("_key"), own_extension(F.col("ext")).alias("_def_ext"),
                           F.struct(*payload).alias("_def"), ix.order().alias("_ord"))
        .groupBy(*unit, "_key", "_def_ext")
        .agg(F.min_by("_def", "_ord").alias("_def"), F.min("_ord").alias("_ord"))
    )
    asked = asking.withColumn("_key", key)
    wanted = (
        asked.select(*unit, "_key", "ext").distinct()
        .withColumn("_def_ext", F.explode(definition_extensions(F.col("ext"))))
        .join(firsts, [*unit, "_key", "_def_ext"])
        .groupBy(*unit, "_key", "ext")
        .agg(F.min_by("_def", "_ord").alias("definition"))
    )
    return join_unique(asked, wanted, [*unit, "_key", "ext"], "left").drop("_key")


def var_definition_first(records: DataFrame, unit: Sequence[str] = PROJECT) -> DataFrame:
    """Each var definition or usage with the definition an editor would open."""
    keyed = ix.records_of(records, "var_definition", "var_usage").withColumn(
        "var_ns", F.coalesce("ns", "to_ns")
    )
    return first_definition(
        keyed, keyed.where(F.col("semantic") == "var_definition"), ["var_ns", "name"], unit
    )


def namespace_definition_first(records: DataFrame, unit: Sequence[str] = PROJECT) -> DataFrame:
    keyed = ix.records_of(records, "namespace_definition", "namespace_usage").withColumn(
        "namespace", F.coalesce("name", "to_ns")
    )
    return first_definition(
        keyed, keyed.where(F.col("semantic") == "namespace_definition"), ["namespace"], unit
    )


def call_edges(records: DataFrame) -> DataFrame:
    """Which var uses which, with the number of places."""
    return (
        ix.records_of(records, "var_usage")
        .groupBy("project", "from_ns", "from_var", "to_ns", "name")
        .agg(F.count("*").alias("n_calls"))
    )


def call_degrees(edges: DataFrame) -> DataFrame:
    """Callers and callees of each var, from the edges in one pass."""
    ends = edges.select(
        "project",
        F.explode(
            F.array(
                F.struct(F.col("from_ns").alias("ns"), F.col("from_var").alias("name"),
                         F.lit(1).alias("out"), F.lit(0).alias("into"), "n_calls"),
                F.struct(F.col("to_ns").alias("ns"), F.col("name").alias("name"),
                         F.lit(0).alias("out"), F.lit(1).alias("into"), "n_calls"),
            )
        ).alias("e"),
    ).select("project", "e.*")
    return ends.groupBy("project", "ns", "name").agg(
        F.sum("out").alias("n_callees"),
        F.sum("into").alias("n_callers"),
        F.sum(F.col("into") * F.col("n_calls")).alias("n_called"),
    )


def recursive_usages(records: DataFrame) -> DataFrame:
    from ..functions.scalars import is_recursive

    return ix.records_of(records, "var_usage").where(is_recursive())
