"""Key views over records: what is asked for, and under which key it is found.

An index is never stored.  A question and the records that answer it get the same
string key, and a lookup is an equi-join.  Questions are grouped by target first,
so a result has one row per (target, found record) however many records or carets
ask for the same target: the size of an answer grows with the data, not with its
square.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import (
    is_registering,
    key_parts,
    lookup_key,
    owner,
    symbol_name,
    symbol_namespace,
    text_or_null,
)
from ..schema import FINDING
from .joins import met

ORD = ("file_ord", "pos")
PROJECT = ("project",)
FILE = ("project", "filename")
TARGET = "target"

# What the finder of a record gets to see of it.
FOUND = ["filename", "semantic", "row", "col", "name_row", "name_col", "file_ord", "pos"]


def order() -> Column:
    return F.struct(*ORD)


def records_of(records: DataFrame, *semantics: str) -> DataFrame:
    """Usable records of some kinds: those at a real position, and findings as they are."""
    out = records.where(F.col("semantic").isin(*semantics))
    placed = (F.col("row") != 0) & (F.col("col") != 0)
    if semantics == (FINDING,):
        return out
    return out.where(placed | (F.col("semantic") == FINDING) if FINDING in semantics else placed)


def is_valid() -> Column:
    return (F.col("semantic") == FINDING) | ((F.col("row") != 0) & (F.col("col") != 0))


def has_row() -> Column:
    return F.col("row").isNotNull()


def valid_records(records: DataFrame) -> DataFrame:
    return records.where(is_valid())


def with_row(records: DataFrame) -> DataFrame:
    """Records whose row is known, of any kind."""
    return records.where(has_row())


# -- targets: what a record asks for ---------------------------------------------


def _no_text() -> Column:
    return F.lit(None).cast("string")


def usage_target(records: DataFrame) -> DataFrame:
    """Add ``target``: the thing whose usages the record asks for, null for none.

    A namespace is only looked up from a file with an extension.
    """
    sem = F.col("semantic")
    target = (
        F.when(sem == "keyword", lookup_key("keyword", F.col("ns"), F.col("name")))
        .when(sem.isin("local", "local_usage"), local_key())
        .when(sem.isin("var_definition", "var_usage"), lookup_key("var", owner(), F.col("name")))
        .when(sem == "symbol", lookup_key("symbol", F.col("symbol"), _no_text()))
        .when(sem == "java_class_usage", lookup_key("java", F.col("class_name"), text_or_null("method_name")))
        .when(
            sem.isin("namespace_definition", "namespace_usage") & (F.col("ext") != ""),
            lookup_key("namespace", F.coalesce("name", "to_ns"), _no_text()),
        )
    )
    return records.withColumn(TARGET, target)


def definition_target(records: DataFrame) -> DataFrame:
    """Add the target whose definitions the record asks for; definitions ask for nothing."""
    sem = F.col("semantic")
    target = (
        F.when(sem == "local_usage", local_key())
        .when(sem == "namespace_usage", lookup_key("namespace", F.coalesce("name", "to_ns"), _no_text()))
        .when(sem == "var_usage", lookup_key("var", F.coalesce("ns", "to_ns"), F.col("name")))
        .when(sem == "keyword", lookup_key("keyword", F.col("ns"), F.col("name")))
        .when(sem == "symbol", lookup_key("symbol", F.col("symbol"), _no_text()))
    )
    return records.withColumn(TARGET, target)


def local_key() -> Column:
    """Ids of locals are unique within a file only."""
    return lookup_key("local", F.col("filename"), F.col("local_id").cast("string"))


def targets(asking: DataFrame, unit: Sequence[str] = PROJECT) -> DataFrame:
    """Distinct targets with the number of askers.  Combined before the shuffle."""
    return (
        asking.where(F.col(TARGET).isNotNull())
        .groupBy(*unit, TARGET)
        .agg(F.count("*").alias("n_asked"))
    )


# -- probes: the keys of a target --------------------------------------------------


def _probe(branch: int, key: Column) -> Column:
    return F.struct(F.lit(branch).alias("branch"), key.alias("key"))


def usage_probes() -> Column:
    """Keys to look up, in list order: the target itself; vars and symbols find each other too."""
    kind, t1, t2 = key_parts(F.col(TARGET))
    text = F.when(t1.isNull(), t2).otherwise(F.concat(t1, F.lit("/"), t2))
    own = _probe(0, F.col(TARGET))
    return (
        F.when(kind == "var", F.array(own, _probe(1, lookup_key("symbol", text, _no_text()))))
        .when(
            kind == "symbol",
            F.array(own, _probe(1, lookup_key("var", symbol_namespace(t1), symbol_name(t1)))),
        )
        .otherwise(F.array(own))
    )


def definition_probes() -> Column:
    """The one key to look up: the target, or the var that a symbol names."""
    kind, t1, _ = key_parts(F.col(TARGET))
    key = F.when(
        kind == "symbol", lookup_key("var", symbol_namespace(t1), symbol_name(t1))
    ).otherwise(F.col(TARGET))
    return F.array(_probe(0, key))


# -- entries: the keys a record is found under -------------------------------------


def usage_entries(records: DataFrame, registering: bool = False) -> DataFrame:
    """Usages with the ``key`` they are found under (``registering`` keeps defining keywords)."""
    sem = F.col("semantic")
    used = records_of(
        records, "keyword", "local_usage", "var_usage", "symbol", "java_class_usage", "namespace_usage"
    )
    if not registering:
        used = used.where((sem != "keyword") | ~is_registering())
    key = (
        F.when(sem == "keyword", lookup_key("keyword", F.col("ns"), F.col("name")))
        .when(sem == "local_usage", local_key())
        .when(sem == "var_usage", lookup_key("var", F.col("to_ns"), F.col("name")))
        .when(sem == "symbol", lookup_key("symbol", F.col("symbol"), _no_text()))
        .when(sem == "java_class_usage", lookup_key("java", F.col("class_name"), _no_text()))
        .when(sem == "namespace_usage", lookup_key("namespace", F.col("to_ns"), _no_text()))
    )
    # A Java usage with a method is found a second time; reads that kind's files only.
    method = text_or_null("method_name")
    by_method = records_of(records, "java_class_usage").where(method.isNotNull())
    return used.withColumn("key", key).unionByName(
        by_method.withColumn("key", lookup_key("java", F.col("class_name"), method))
    )


def last_bindings(records: DataFrame) -> DataFrame:
    """One binding per local id: a later one replaces an earlier one.

    The last position is found by a hash aggregate over numbers, and the join back
    brings the rest of the record.
    """
    locals_ = records_of(records, "local")
    last = locals_.groupBy("project", "filename", "local_id").agg(F.max("pos").alias("pos"))
    return locals_.join(met(last, FILE), ["project", "filename", "local_id", "pos"])


def definition_entries_of(defined: DataFrame) -> DataFrame:
    """Add the ``key`` a definition is found under."""
    sem = F.col("semantic")
    key = (
        F.when(sem == "keyword", lookup_key("keyword", F.col("ns"), F.col("name")))
        .when(sem == "local", local_key())
        .when(sem == "var_definition", lookup_key("var", F.col("ns"), F.col("name")))
        .when(sem == "namespace_definition", lookup_key("namespace", F.col("name"), _no_text()))
    )
    return records_of(
        defined, "namespace_definition", "var_definition", "keyword", "local"
    ).withColumn("key", key)


def definition_entries(records: DataFrame) -> DataFrame:
    """Definitions: vars, namespaces, registering keywords, and the binding of each local."""
    defined = records_of(records, "namespace_definition", "var_definition", "keyword").where(
        (F.col("semantic") != "keyword") | is_registering()
    )
    bindings = last_bindings(records).select(*defined.columns)
    return definition_entries_of(defined.unionByName(bindings))


def namespace_rows(records: DataFrame) -> DataFrame:
    """Row entries of namespace usages: one for the name and one for the alias, same row or not."""
    usages = records_of(records, "namespace_usage")
    by_alias = usages.where(F.col("alias") != "")
    return usages.withColumn("idx_row", F.col("name_row")).unionByName(
        by_alias.withColumn("idx_row", F.col("alias_row"))
    )
