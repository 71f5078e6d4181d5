"""The first scope that knows anything answers: fallback over view, sources and libraries.

Results come as two tables, so that no caret is paired with every row of its answer:
``asks`` says per file and target which scope answers and how much it knows,
``answers`` lists each answer once.  Join the two for the carets one wants to see.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import (
    clean_doc,
    definition_extensions,
    lookup_key,
    own_extension,
    symbol_name,
    symbol_namespace,
)
from ..schema import SCOPE_SEMANTICS
from . import index as ix
from .dedupe import dedupe_answers
from .index import FILE, FOUND, TARGET
from .joins import join_hashed, join_unique, met


def _known(entries: DataFrame, unit: Sequence[str], name: str) -> DataFrame:
    return entries.groupBy(*unit, "key").agg(F.count("*").alias(name))


def rank_scopes(
    asked: DataFrame, probes, entries_by_scope: list[tuple[str, DataFrame, Sequence[str]]]
) -> DataFrame:
    """Per file and target, how many records each scope holds and which scope wins.

    Scopes shrink to one count per key before the join, so every join is n:1.
    """
    probed = asked.select(*FILE, TARGET, "n_asked", F.explode(probes).alias("p")).select(
        *FILE, TARGET, "n_asked", "p.key"
    )
    for scope, entries, unit in entries_by_scope:
        probed = join_unique(probed, _known(entries, unit, f"n_{scope}"), [*unit, "key"], "left")
    summed = probed.groupBy(*FILE, TARGET).agg(
        F.max("n_asked").alias("n_asked"),
        *(F.coalesce(F.sum(f"n_{s}"), F.lit(0)).alias(f"n_{s}") for s, _, _ in entries_by_scope),
    )
    winner = F.lit(None).cast("string")
    for scope, _, _ in reversed(entries_by_scope):
        winner = F.when(F.col(f"n_{scope}") > 0, scope).otherwise(winner)
    return summed.withColumn("answer_scope", winner)


def list_answers(
    ranked: DataFrame, probes, entries_by_scope: list[tuple[str, DataFrame, Sequence[str]]]
) -> DataFrame:
    """Rows of every winning answer, once per unit of the scope, deduplicated by place.

    ``asking_file`` is set where the answer belongs to one view only.
    """
    found = [c for c in FOUND if c != "filename"]
    parts = []
    for scope, entries, unit in entries_by_scope:
        won = (
            ranked.where(F.col("answer_scope") == scope)
            .groupBy(*unit, TARGET)
            .agg(F.sum("n_asked").alias("n_asked"))
            .select(*unit, TARGET, "n_asked", F.explode(probes).alias("p"))
            .select(*unit, TARGET, "n_asked", "p.branch", "p.key")
        )
        in_view = "filename" in unit
        rows = join_hashed(won, entries.select("project", "filename", "key", *found), [*unit, "key"]).select(
            F.lit(scope).alias("answer_scope"),
            "project",
            (F.col("filename") if in_view else F.lit(None).cast("string")).alias("asking_file"),
            TARGET, "n_asked", "branch", "filename", *found,
        )
        parts.append(rows)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return dedupe_answers(out, ["answer_scope", "project", "asking_file", TARGET])


SHOWN = "shown"  # whether a record is of what its file shows


def overlay(records: DataFrame, open_views: DataFrame) -> DataFrame:
    """Add ``shown``: an open view stands before the saved file, and a file that is not open shows what is saved.

    ``records`` may hold a file in scope ``view`` and in a scope of saved files; ``open_views(project, filename)``
    names what is open, so that a view without records hides the saved file too.
    The flag is decided once per record; lookups then need no join to tell the two apart.
    """
    named = open_views.select(*FILE).distinct().withColumn("_open", F.lit(True))
    found = join_unique(records, named, list(FILE), "left")
    shown = F.when(F.col("scope") == "view", F.col("_open").isNotNull()).otherwise(F.col("_open").isNull())
    return found.withColumn(SHOWN, shown).drop("_open")


def shown(records: DataFrame) -> DataFrame:
    """Records of what files show.  Without an :func:`overlay`, every file is open as it was saved."""
    return records.where(SHOWN) if SHOWN in records.columns else records


def in_scope(records: DataFrame, scope: str) -> DataFrame:
    """Records a scope answers from: what files show, or what was saved."""
    seen = shown(records) if scope == "view" else records.where(F.col("scope") == scope)
    return seen.where(F.col("semantic").isin(*SCOPE_SEMANTICS[scope]))


def _scoped(records: DataFrame, entries, order: Sequence[str]):
    return [
        (s, entries(in_scope(records, s)), FILE if s == "view" else ix.PROJECT) for s in order
    ]


def _definition_scopes(records: DataFrame):
    return _scoped(records, ix.definition_entries, ["view", "paths", "classpath"])


def rank_definitions(asking: DataFrame, records: DataFrame) -> DataFrame:
    """Go to definition: the view, then the project's sources, then its libraries."""
    asked = ix.targets(ix.definition_target(asking), FILE)
    return rank_scopes(asked, ix.definition_probes(), _definition_scopes(records))


def list_definitions(ranked: DataFrame, records: DataFrame) -> DataFrame:
    return list_answers(ranked, ix.definition_probes(), _definition_scopes(records))


def _usage_scopes(records: DataFrame, view_only: bool):
    return _scoped(records, ix.usage_entries, ["view"] if view_only else ["paths", "view"])


def rank_usages(asking: DataFrame, records: DataFrame, view_only: bool = False) -> DataFrame:
    """Find usages: the project's sources, then the view; or the view alone."""
    asked = ix.targets(ix.usage_target(asking), FILE)
    return rank_scopes(asked, ix.usage_probes(), _usage_scopes(records, view_only))


def list_usages(ranked: DataFrame, records: DataFrame, view_only: bool = False) -> DataFrame:
    return list_answers(ranked, ix.usage_probes(), _usage_scopes(records, view_only))


_CARD = ("filename", "row", "col", "name_row", "name_col", "name", "ns", "arglist_strs", "doc")
# Docs are looked up in another order than definitions.  Fixed values.
_CARD_SCOPES = ("view", "classpath", "paths")


def doc_cards(asking: DataFrame, records: DataFrame) -> DataFrame:
    """Name, place, arguments and docstring of the first definition of what is asked for.

    Looks in the view, then in libraries, then in the project's sources.  Definitions
    shrink to the first per scope, key and extension, so a question meets a dozen
    candidates at most.  Asked per distinct ``(file, key, extension)``; carets share cards.
    """
    sem = F.col("semantic")
    none = F.lit(None).cast("string")
    asked_key = (
        F.when(
            sem.isin("namespace_definition", "namespace_usage"),
            lookup_key("namespace", F.coalesce("name", "to_ns"), none),
        )
        .when(sem == "symbol", lookup_key("var", symbol_namespace(F.col("symbol")), symbol_name(F.col("symbol"))))
        .when(sem.isin("var_definition", "var_usage"), lookup_key("var", F.coalesce("ns", "to_ns"), F.col("name")))
    )
    # A symbol takes a definition from a file with any extension.
    asked = (
        asking.select(*FILE, asked_key.alias("key"), "ext", (sem == "symbol").alias("any_ext"))
        .where(F.col("key").isNotNull())
        .groupBy(*FILE, "key", "ext", "any_ext")
        .agg(F.count("*").alias("n_asked"))
    )
    defs = ix.definition_entries_of(
        records.where(sem.isin("namespace_definition", "var_definition"))
    ).withColumn("def_ext", own_extension(F.col("ext")))
    firsts = [F.min_by(F.struct(*_CARD), ix.order()).alias("card"), F.min(ix.order()).alias("ord")]
    in_view = shown(defs).groupBy(*FILE, "key", "def_ext").agg(*firsts).withColumn("answer_scope", F.lit("view"))
    saved = defs.where(F.col("scope") != "view")
    in_project = (
        saved.withColumnRenamed("scope", "answer_scope").groupBy("project", "key", "def_ext", "answer_scope").agg(*firsts)
    )
    rank = F.lit(None).cast("int")
    for n, scope in enumerate(_CARD_SCOPES):
        rank = F.when(F.col("answer_scope") == scope, n).otherwise(rank)
    columns = [*FILE, "key", "ext", "any_ext", "n_asked", "answer_scope", "def_ext", "card", "ord"]
    candidates = (
        asked.join(met(in_view, FILE), [*FILE, "key"]).select(*columns)
        .unionByName(asked.join(met(in_project, ix.PROJECT), ["project", "key"]).select(*columns))
        .where(F.col("any_ext") | F.array_contains(definition_extensions(F.col("ext")), F.col("def_ext")))
    )
    found = (
        candidates.groupBy(*FILE, "key", "ext", "any_ext", "n_asked")
        .agg(F.min_by(F.struct("answer_scope", "card"), F.struct(rank, "ord")).alias("d"))
        .select(*FILE, "key", "ext", "any_ext", "n_asked", "d.answer_scope", F.col("d.card").alias("d"))
    )
    ns, name = F.col("d.ns"), F.coalesce("d.name", F.lit(""))
    return found.select(
        *FILE, "key", "ext", "any_ext", "n_asked", "answer_scope",
        F.when(ns != "", F.concat(ns, F.lit("/"), name)).otherwise(name).alias("qualified_name"),
        F.col("d.filename").alias("def_filename"),
        F.coalesce(F.when(F.col("d.name_row") != 0, F.col("d.name_row")), F.col("d.row")).alias("line"),
        F.coalesce(F.when(F.col("d.name_col") != 0, F.col("d.name_col")), F.col("d.col")).alias("column"),
        F.array_join(F.coalesce("d.arglist_strs", F.array().cast("array<string>")), " ").alias("arglists"),
        clean_doc(F.col("d.doc")).alias("doc"),
    )
