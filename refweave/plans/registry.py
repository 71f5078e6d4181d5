"""Every operator as a query over the given tables.

``documents`` are read as source code (see ``sources.documents``) and ``events`` as
editor events.  All queries run over all rows.  Records, and the record under every
caret, are written once per session and shared.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import scalars as sc
from ..operators import catalog as cat
from ..operators import findings as fi
from ..operators import index as ix
from ..operators import lookup as lk
from ..operators import navigate as nav
from ..operators import position as ps
from ..operators import regions as rg
from ..operators import rewrite as rw
from ..operators import scopes as sp
from ..operators.dedupe import dedupe, dedupe_answers, mark_single
from ..operators.report import usage_report
from ..schema import RECORD_FIELDS
from ..session import DEALT_BYTES, configured, derived_table, read_table, scratch, text_tasks, write_table
from ..sources import documents as docs
from ..sources import files as fs
from ..sources import reports as rp
from ..streaming import events as ev
from ..streaming import ingest as ig
from ..streaming import live
from . import state as st

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    """Register under the function's name, less a trailing underscore."""
    _QUERIES[f.__name__.rstrip("_")] = f
    return f


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


# -- inputs ------------------------------------------------------------------------


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")


def _by_project(spark: SparkSession, sf: str) -> DataFrame:
    """Documents project by project, as their records are to be written."""
    return _dealt(spark, sf).sortWithinPartitions("doc_id")


def _dealt(spark: SparkSession, sf: str) -> DataFrame:
    """Documents dealt by project."""
    return _documents(spark, sf).repartition(_n_tasks(spark, sf), docs.project())


def _n_tasks(spark: SparkSession, sf: str) -> int:
    """As many for all tables of one session, as they then meet without a shuffle."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _tasks:
        _tasks[key] = text_tasks(_documents(spark, sf), "text", DEALT_BYTES)
    return _tasks[key]


_tasks: dict[tuple[str, str], int] = {}


def _by_project_table(spark: SparkSession, name: str, sf: str, build: Callable[[], DataFrame], partition_by: Sequence[str] = ()) -> DataFrame:
    """A table dealt by project as documents are, so that it meets others of its kind, and them, without a shuffle."""
    return derived_table(spark, name, sf, build, partition_by, "project", lambda: _n_tasks(spark, sf))


def records(spark: SparkSession, sf: str) -> DataFrame:
    """All records, in Parquet by scope and kind, file by file."""
    return _by_project_table(
        spark, "records", sf,
        lambda: docs.records(_by_project(spark, sf)),
        partition_by=["scope", "semantic"],
    )


def files(spark: SparkSession, sf: str) -> DataFrame:
    return docs.source_files(_dealt(spark, sf))


def asked(spark: SparkSession, sf: str) -> DataFrame:
    """The record under every caret."""
    return _by_project_table(
        spark, "asked", sf,
        lambda: ps.at_position(records(spark, sf), docs.cursors(_dealt(spark, sf))),
    )


def editor_events(spark: SparkSession, sf: str) -> DataFrame:
    return as_editor_events(spark.read.parquet(f"{sf}/events.parquet"))


# How the event table's types read as editor events.
KIND_OF_EVENT = {
    "click": "modified",
    "view": "activated",
    "purchase": "saved",
    "signup": "project_loaded",
    "error": "closed",
}


def as_editor_events(events: DataFrame) -> DataFrame:
    kind = F.lit(None).cast("string")
    for source, name in KIND_OF_EVENT.items():
        kind = F.when(F.col("event_type") == source, name).otherwise(kind)
    syntax = F.element_at(
        F.array(F.lit("Clojure"), F.lit("ClojureScript"), F.lit("Python")),
        (F.col("user_id") % 3 + 1).cast("int"),
    )
    return events.select(
        F.concat(F.lit("v"), "user_id").alias("view_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        kind.alias("kind"),
        F.col("event_id").alias("change_count"),
        syntax.alias("syntax"),
        (F.col("user_id") % 5 == 0).alias("is_scratch"),
        F.col("props").alias("raw_json"),
    )


def _target() -> list[Column]:
    kind, t1, t2 = sc.key_parts(F.col(ix.TARGET))
    return [kind.alias("target_kind"), t1.alias("t1"), t2.alias("t2")]


# -- scans, filters, key views -------------------------------------------------------


@query
def usages_per_definition(spark, sf):
    """How often each var is used: definitions first, then counts, then the join."""
    r = records(spark, sf)
    defs = ix.definition_entries_of(r.where("semantic = 'var_definition'")).groupBy("project", "ns", "name").agg(
        F.count("*").alias("n_definitions")
    )
    used = ix.records_of(r, "var_usage").groupBy("project", F.col("to_ns").alias("ns"), "name").agg(
        F.count("*").alias("n_usages"), F.countDistinct("filename").alias("n_files")
    )
    return defs.join(used, ["project", "ns", "name"], "left").na.fill(0)


@query
def records_(spark, sf):
    return records(spark, sf).select(
        "project", "scope", "filename", "semantic", "file_ord", "pos", "row", "col", "end_row", "end_col",
        "name_row", "name_end_col", "name", "ns", "from_ns", "to_ns", "from_var", "alias", "local_id",
        "class_name", "method_name", "symbol", "reg", "keys_destructuring", "doc", "level", "message",
        F.array_join("arglist_strs", " ").alias("arglists"),
    )


@query
def valid_records(spark, sf):
    return records(spark, sf).groupBy("project", "semantic").agg(
        F.count("*").alias("n_all"),
        F.count_if(ix.has_row()).alias("n_with_row"),
        F.count_if(ix.is_valid()).alias("n_valid"),
    )


@query
def classpath_scope(spark, sf):
    r = ix.valid_records(sp.in_scope(records(spark, sf), "classpath"))
    return r.select("project", "filename", "semantic", "pos", "name", "ns", "row", "col")


@query
def report_scan(spark, sf):
    """Records written as JSON reports and read back as records."""
    reports = rp.to_reports(records(spark, sf).withColumn("scope", F.lit("view")))
    parsed = rp.parse_reports(reports.withColumn("run_seq", F.lit(1).cast("bigint")))
    return (
        rp.report_records(parsed)
        .groupBy("project", "filename", "semantic")
        .agg(
            F.count("*").alias("n_records"),
            F.sum("row").alias("sum_row"),
            F.sum("col").alias("sum_col"),
            F.count("name").alias("n_named"),
            F.sum(F.size("arglist_strs")).alias("n_arglists"),
        )
    )


@query
def report_quarantine(spark, sf):
    """Reports of all scopes, some cut short and some no objects: what is read and what is set aside."""
    doc = F.regexp_extract("filename", "/d([0-9]+)", 1).cast("bigint")
    cut = F.left("value", F.floor(F.length("value") / 2).cast("int"))
    reports = rp.to_reports(records(spark, sf)).withColumns(
        {"value": F.when(doc % 7 == 0, cut).when(doc % 7 == 1, "[1]").otherwise(F.col("value")),
         "run_seq": F.lit(1).cast("bigint")}
    )
    parsed = rp.parse_reports(reports)
    set_aside = rp.quarantine(parsed).groupBy("project", "scope").agg(F.count("*").alias("n_quarantined"))
    read = rp.report_records(parsed).groupBy("project", "scope").agg(
        F.count("*").alias("n_records"), F.countDistinct("filename").alias("n_files")
    )
    return set_aside.join(read, ["project", "scope"], "full").na.fill(0)


@query
def report_summaries(spark, sf):
    reports = rp.to_reports(records(spark, sf)).withColumn("run_seq", F.lit(1).cast("bigint"))
    return rp.parse_reports(reports).select(
        "project", "filename",
        F.col("report.summary.error").alias("errors"),
        F.col("report.summary.warning").alias("warnings"),
        "is_readable",
    )


#: A report is a long string, and Parquet is read in batches of 4,096 rows unless told otherwise.
FEW_AT_ONCE = {"spark.sql.parquet.columnarReaderBatchSize": "128"}


@query
def hooks(spark, sf):
    """Reports streamed into a log; what a hook was shown after each batch, added up."""
    source, seen = scratch(spark, "reports"), scratch(spark, "seen")
    reports = rp.to_reports(records(spark, sf).withColumn("scope", F.lit("view"))).select(
        "project", "scope", F.lit(1).cast("bigint").alias("run_seq"), "value"
    )
    reports.write.parquet(source)

    def count_kinds(context, batch):
        counts = batch.groupBy("project", "semantic").agg(F.count("*").alias("n"), F.count("name").alias("n_named"))
        counts.write.mode("overwrite").parquet(f"{seen}/batch_id={context['batch_id']}")

    stream = spark.readStream.schema(reports.schema).parquet(source)
    with configured(spark, FEW_AT_ONCE):
        ig.ingest(stream, scratch(spark, "log"), scratch(spark, "log-state"), [count_kinds]).awaitTermination()
    return spark.read.parquet(seen).groupBy("project", "semantic").agg(
        F.sum("n").alias("n"), F.sum("n_named").alias("n_named")
    )


@query
def keyword_regs(spark, sf):
    r = ix.records_of(records(spark, sf), "keyword").where(sc.is_registering())
    return r.select("project", "filename", "row", "col", "ns", "name", "reg")


@query
def recursive_usages(spark, sf):
    r = lk.recursive_usages(records(spark, sf))
    return r.select("project", "filename", "row", "col", "from_ns", "name")


@query
def project_files(spark, sf):
    """Files inside project directories: each project's own, and every one of another's."""
    f = files(spark, sf).select("project", "filename")
    projects = f.select("project").distinct().withColumn("directory", F.concat(F.lit("/"), "project", F.lit("/")))
    return st.project_files(f, projects).select("project", "filename")


@query
def ns_row_keys(spark, sf):
    r = ix.namespace_rows(records(spark, sf))
    return r.select("project", "filename", "idx_row", "to_ns", "alias", "pos")


@query
def locals_(spark, sf):
    return ix.last_bindings(records(spark, sf)).select("project", "filename", "local_id", "name", "row", "col")


@query
def keyword_groups(spark, sf):
    r = ix.records_of(records(spark, sf), "keyword")
    return r.groupBy("project", "ns", "name").agg(
        F.count("*").alias("n"),
        F.min(F.struct("file_ord", "pos"))["file_ord"].alias("first_file"),
        F.count_if(sc.is_registering()).alias("n_registering"),
    )


@query
def var_groups(spark, sf):
    r = ix.records_of(records(spark, sf), "var_definition", "var_usage")
    return r.groupBy("project", F.coalesce("ns", "to_ns").alias("var_ns"), "name").agg(
        F.count_if(F.col("semantic") == "var_definition").alias("n_definitions"),
        F.count_if(F.col("semantic") == "var_usage").alias("n_usages"),
        F.min("file_ord").alias("first_file"),
    )


@query
def symbol_groups(spark, sf):
    r = ix.records_of(records(spark, sf), "symbol")
    return r.groupBy("project", "symbol").agg(F.count("*").alias("n"), F.min("file_ord").alias("first_file"))


@query
def java_groups(spark, sf):
    r = ix.records_of(records(spark, sf), "java_class_usage")
    return r.groupBy("project", "class_name").agg(
        F.count("*").alias("n"), F.count("method_name").alias("n_with_method")
    )


@query
def file_semantic_counts(spark, sf):
    return records(spark, sf).groupBy("project", "filename", "semantic").agg(F.count("*").alias("n"))


# -- scalars ---------------------------------------------------------------------------


@query
def file_ext(spark, sf):
    ext = sc.file_extension(F.col("filename"))
    return files(spark, sf).select(
        "filename",
        ext.alias("ext"),
        F.array_join(F.sort_array(sc.definition_extensions(ext)), " ").alias("definition_exts"),
        sc.language(F.lit(None).cast("string"), ext).alias("language"),
    )


@query
def symbol_parts(spark, sf):
    s = F.col("symbol")
    return (
        ix.records_of(records(spark, sf), "symbol")
        .select("project", "symbol").distinct()
        .select("project", "symbol", sc.symbol_namespace(s).alias("sym_ns"), sc.symbol_name(s).alias("sym_name"))
    )


@query
def locations(spark, sf):
    r = ix.valid_records(records(spark, sf))
    return r.select("semantic", "pos", sc.location().alias("at")).select("semantic", "pos", "at.*")


@query
def qualified_names(spark, sf):
    """Name of the record under every caret, counted per file."""
    return (
        asked(spark, sf)
        .withColumn("qualified_name", sc.qualified_name())
        .groupBy("project", "filename", "semantic", "qualified_name")
        .agg(F.count("*").alias("n_carets"))
    )


@query
def labels(spark, sf):
    r = ix.valid_records(records(spark, sf)).where(~F.col("semantic").isin("local", "java_class_usage"))
    lab = sc.label(show_namespace=True, show_row_col=True, show_filename=True)
    return r.select(
        "project", "filename", "semantic", "pos", sc.symbol_kind().alias("kind"), lab.alias("l")
    ).select("project", "filename", "semantic", "pos", "kind", "l.*")


@query
def inspect(spark, sf):
    """Records as key-value pairs, all fields, and how often each pair occurs."""
    r = records(spark, sf).withColumns(
        {"arglist_strs": F.array_join("arglist_strs", " "), "fixed_arities": F.array_join("fixed_arities", " ")}
    )
    shown = rp.listed_pairs(r, [c for c, _, _ in RECORD_FIELDS])
    return shown.groupBy("k", "v").agg(F.count("*").alias("n"))


@query
def inspect_events(spark, sf):
    return editor_events(spark, sf).select(
        "change_count", F.explode(rp.inspect(F.col("raw_json"))).alias("key", "value")
    )


# -- lookups -------------------------------------------------------------------------

_FOUND = ["n_asked", "branch", "filename", "semantic", "row", "col"]


def _found(df: DataFrame, *extra: str) -> DataFrame:
    return df.select("project", *_target(), *_FOUND, "pos", *extra)


@query
def keyword_occurrences(spark, sf):
    return _found(lk.keyword_occurrences(records(spark, sf)))


@query
def keyword_usages(spark, sf):
    return _found(lk.keyword_usages(records(spark, sf)))


@query
def keyword_definitions(spark, sf):
    return _found(lk.keyword_definitions(records(spark, sf)), "is_first")


@query
def local_bindings(spark, sf):
    return lk.local_bindings(records(spark, sf)).select(
        "filename", "local_id", "row", "col",
        F.col("binding.row").alias("binding_row"), F.col("binding.col").alias("binding_col"),
    )


@query
def local_usages(spark, sf):
    return _found(lk.local_usages(records(spark, sf)))


@query
def var_definitions(spark, sf):
    return _found(lk.var_definitions(records(spark, sf)))


@query
def var_definition_first(spark, sf):
    r = lk.var_definition_first(records(spark, sf))
    return r.select(
        "filename", "semantic", "pos",
        F.col("definition.filename").alias("def_filename"), F.col("definition.pos").alias("def_pos"),
    )


@query
def var_usages(spark, sf):
    return _found(lk.var_usages(records(spark, sf)))


@query
def symbol_definitions(spark, sf):
    return _found(lk.symbol_definitions(records(spark, sf)), "is_first")


@query
def symbol_usages(spark, sf):
    return _found(lk.symbol_usages(records(spark, sf)))


@query
def java_usages(spark, sf):
    return _found(lk.java_usages(records(spark, sf)))


@query
def ns_definitions(spark, sf):
    return _found(lk.namespace_definitions(records(spark, sf)))


@query
def ns_definition_first(spark, sf):
    r = lk.namespace_definition_first(records(spark, sf))
    return r.select("filename", "semantic", "pos", F.col("definition.filename").alias("def_filename"))


@query
def ns_usages(spark, sf):
    return _found(lk.namespace_usages(records(spark, sf)))


@query
def ns_var_usages(spark, sf):
    r = lk.namespace_vars(records(spark, sf))
    return r.select(
        "project", "to_ns", "n_asked", "name", "filename", "row", "col",
        F.col("group_ord.file_ord").alias("group_file"), F.col("group_ord.pos").alias("group_pos"),
    )


@query
def usages(spark, sf):
    """Usages of everything, one row per place; a single one is where an editor goes directly."""
    r = records(spark, sf)
    group = ["project", ix.TARGET]
    # Read twice below: once to count, once to list.
    listed = _by_project_table(
        spark, "usage_places", sf,
        lambda: dedupe_answers(lk.find_usages(ix.valid_records(r), r), group),
    )
    return mark_single(listed, group).select("project", *_target(), *_FOUND, "is_single")


@query
def definitions(spark, sf):
    r = records(spark, sf)
    group = ["project", ix.TARGET]
    listed = dedupe_answers(lk.find_definitions(ix.valid_records(r), r), group)
    return mark_single(listed, group).select("project", *_target(), *_FOUND, "is_single")


@query
def call_edges(spark, sf):
    return lk.call_edges(records(spark, sf))


@query
def call_degrees(spark, sf):
    return lk.call_degrees(lk.call_edges(records(spark, sf)))


# -- positions ---------------------------------------------------------------------------


@query
def at_position(spark, sf):
    return asked(spark, sf).select("cursor_id", "hit_type", "semantic", "pos", "hit_start_col", "hit_end_col")


@query
def destructured_locals(spark, sf):
    r = ps.destructured_locals(records(spark, sf))
    return r.select("project", "filename", "keyword_pos", "keyword_name", "local_id", "local_pos")


@query
def require_sites(spark, sf):
    r = nav.require_sites(asked(spark, sf), records(spark, sf))
    return r.select(
        "cursor_id", F.col("site.semantic").alias("site_kind"),
        F.col("site.line").alias("line"), F.col("site.column").alias("column"),
    )


# -- scopes ------------------------------------------------------------------------------



def definition_ranks(spark: SparkSession, sf: str) -> DataFrame:
    """Which scope answers each question for definitions."""
    return _by_project_table(
        spark, "definition_ranks", sf,
        lambda: sp.rank_definitions(asked(spark, sf), records(spark, sf)),
    )


def usage_ranks(spark: SparkSession, sf: str) -> DataFrame:
    """Which scope answers each question for usages."""
    return _by_project_table(
        spark, "usage_ranks", sf,
        lambda: sp.rank_usages(asked(spark, sf), records(spark, sf)),
    )


def _ranked(df: DataFrame, *counts: str) -> DataFrame:
    return df.select("project", "filename", *_target(), "n_asked", *counts, "answer_scope")


def _answers(df: DataFrame) -> DataFrame:
    return df.select(
        "answer_scope", "project", "asking_file", *_target(), "n_asked", "filename", "row", "col", "semantic"
    )


@query
def definitions_by_scope(spark, sf):
    """Per file and target: which scope answers, and how many records each holds."""
    return _ranked(definition_ranks(spark, sf), "n_view", "n_paths", "n_classpath")


@query
def definition_answers(spark, sf):
    return _answers(sp.list_definitions(definition_ranks(spark, sf), records(spark, sf)))


@query
def usages_by_scope(spark, sf):
    return _ranked(usage_ranks(spark, sf), "n_paths", "n_view")


@query
def usage_answers(spark, sf):
    return _answers(sp.list_usages(usage_ranks(spark, sf), records(spark, sf)))


@query
def usages_in_view(spark, sf):
    return _ranked(sp.rank_usages(asked(spark, sf), records(spark, sf), view_only=True), "n_view")


@query
def doc_cards(spark, sf):
    cards = sp.doc_cards(asked(spark, sf), records(spark, sf))
    return cards.select(
        "project", "filename", "ext", "any_ext", "n_asked", "answer_scope", "qualified_name", "def_filename", "line",
        "column", "arglists", "doc",
    )


@query
def usage_report_(spark, sf):
    report = usage_report(asked(spark, sf), usage_ranks(spark, sf), records(spark, sf))
    return report.select(
        "project", "shown_name", "part", "filename", "row", "col", "line"
    )


# -- open views before saved files ---------------------------------------------------------


def workspace(spark: SparkSession, sf: str) -> DataFrame:
    """Records of saved files and of open views, which may be of the same file."""
    def build():
        return sp.overlay(docs.workspace(_by_project(spark, sf)), docs.open_views(_dealt(spark, sf)))

    return _by_project_table(spark, "workspace", sf, build, partition_by=["scope", "semantic"])


def open_asked(spark: SparkSession, sf: str) -> DataFrame:
    """The record under every caret of what files show."""
    return _by_project_table(
        spark, "open_asked", sf,
        lambda: ps.at_position(sp.shown(workspace(spark, sf)), docs.cursors(docs.shown_documents(_dealt(spark, sf)))),
    )


def open_definition_ranks(spark: SparkSession, sf: str) -> DataFrame:
    return _by_project_table(
        spark, "open_definition_ranks", sf, lambda: sp.rank_definitions(open_asked(spark, sf), workspace(spark, sf))
    )


def open_usage_ranks(spark: SparkSession, sf: str) -> DataFrame:
    return _by_project_table(
        spark, "open_usage_ranks", sf, lambda: sp.rank_usages(open_asked(spark, sf), workspace(spark, sf))
    )


@query
def open_records(spark, sf):
    """What each file shows, and what it hides."""
    return workspace(spark, sf).groupBy("project", "filename", "scope", "shown").agg(
        F.count("*").alias("n"), F.sum("pos").alias("sum_pos")
    )


@query
def open_at_position(spark, sf):
    return open_asked(spark, sf).select(
        "cursor_id", "hit_type", "semantic", "pos", "hit_start_col", "hit_end_col"
    )


@query
def open_definitions_by_scope(spark, sf):
    return _ranked(open_definition_ranks(spark, sf), "n_view", "n_paths", "n_classpath")


@query
def open_definition_answers(spark, sf):
    return _answers(sp.list_definitions(open_definition_ranks(spark, sf), workspace(spark, sf)))


@query
def open_usages_by_scope(spark, sf):
    return _ranked(open_usage_ranks(spark, sf), "n_paths", "n_view")


@query
def open_usage_answers(spark, sf):
    return _answers(sp.list_usages(open_usage_ranks(spark, sf), workspace(spark, sf)))


@query
def open_doc_cards(spark, sf):
    cards = sp.doc_cards(open_asked(spark, sf), workspace(spark, sf))
    return cards.select(
        "project", "filename", "ext", "any_ext", "n_asked", "answer_scope", "qualified_name", "def_filename", "line",
        "column", "arglists", "doc",
    )


@query
def open_catalog(spark, sf):
    """Definitions of the sources, or where those were never analysed of the open views."""
    r = workspace(spark, sf)
    listed = cat.catalog_view_paths(r.where(F.col("scope") == "view"), sp.in_scope(r, "paths"))
    return listed.select("project", "from_scope", "qualified_name", "filename", "row", "col", "semantic")


@query
def open_view_report(spark, sf):
    """Views analysed again replace all that they showed before."""
    first = workspace(spark, sf).where(F.col("scope") == "view").withColumn("run_seq", F.lit(1).cast("bigint"))
    again = first.where((F.col("file_ord") % 30 == 0) & (F.col("pos") < F.lit(3 << 31)))
    log = first.unionByName(again.withColumn("run_seq", F.lit(2).cast("bigint")))
    newest = st.latest_report(log, ["project", "scope", "filename"])
    return newest.groupBy("project", "filename", "run_seq").agg(F.count("*").alias("n"), F.sum("pos").alias("sum_pos"))


@query
def java_definitions(spark, sf):
    """The definition of each class that is used: the last one under its name, or none."""
    r = workspace(spark, sf)
    found = lk.java_definitions(ix.valid_records(sp.shown(r)), sp.in_scope(r, "classpath"))
    return found.select(
        "project", "class_name", "n_asked", F.col("definition.filename").alias("def_filename"),
        F.col("definition.pos").alias("def_pos"),
    )


# -- lists ---------------------------------------------------------------------------------


@query
def outline(spark, sf):
    listed = cat.outline(records(spark, sf))
    return cat.by_place(listed.select("project", "filename", "row", "col", "semantic", "label.trigger", "label.annotation"))


@query
def deduped(spark, sf):
    """One record per place of a file, whatever its kind: the last wins."""
    r = ix.valid_records(records(spark, sf)).select("project", "filename", "row", "col", "semantic", "file_ord", "pos")
    d = dedupe(r, ["project", "filename"], ["semantic", "file_ord", "pos"])
    return d.select(
        "project", "filename", "row", "col", "semantic", "n_same_place",
        F.col("list_ord.semantic").alias("first_semantic"),
    )


@query
def catalog(spark, sf):
    listed = cat.catalogues(records(spark, sf))
    return cat.by_name(listed).select("list", "project", "qualified_name", "filename", "row", "col", "semantic")


@query
def catalog_view_paths(spark, sf):
    r = records(spark, sf)
    listed = cat.catalog_view_paths(r, sp.in_scope(r, "paths"))
    return listed.select("project", "from_scope", "qualified_name", "filename", "row", "col", "semantic")


@query
def keyword_view_paths(spark, sf):
    r = records(spark, sf)
    listed = cat.catalog_view_paths(r, sp.in_scope(r, "paths"), ("keyword",))
    return listed.select("project", "from_scope", "qualified_name", "filename", "row", "col")


@query
def ns_usages_in_view(spark, sf):
    """Var usages in a file of each namespace its carets are on; places are not merged."""
    spaces = (
        asked(spark, sf).where(F.col("semantic").isin("var_usage", "namespace_usage"))
        .groupBy("project", "filename", "to_ns").agg(F.count("*").alias("n_asked"))
    )
    used = ix.records_of(records(spark, sf), "var_usage").select("project", "filename", "to_ns", "row", "col", "name")
    return used.join(spaces, ["project", "filename", "to_ns"])


@query
def findings_sorted(spark, sf):
    f = fi.findings(records(spark, sf))
    return cat.by_place(f).select("project", "filename", "row", "col", "level", "label.trigger", "label.annotation")


@query
def finding_regions(spark, sf):
    f = fi.finding_regions(records(spark, sf))
    return f.select("project", "filename", "level", "message", "pos", "region.*")


@query
def finding_summary(spark, sf):
    return fi.finding_summary(records(spark, sf))


@query
def findings_by_severity(spark, sf):
    return fi.findings_by_severity(records(spark, sf))


@query
def next_prev(spark, sf):
    return nav.next_prev(records(spark, sf)).select(
        "filename", "semantic", "pos", "next_row", "next_col", "prev_row", "prev_col"
    )


@query
def namespace_jump(spark, sf):
    return nav.namespace_jump(records(spark, sf))


# -- regions and rename ----------------------------------------------------------------------


@query
def regions(spark, sf):
    r = rg.record_regions(ix.valid_records(records(spark, sf)), files(spark, sf), text=False)
    return r.select("filename", "semantic", "pos", "a", "b")


@query
def region_text(spark, sf):
    """Source text of every record, counted per file."""
    r = rg.record_regions(ix.valid_records(records(spark, sf)), files(spark, sf))
    return r.groupBy("filename", "semantic", "region_text").agg(F.count("*").alias("n"))


def carets(spark: SparkSession, sf: str) -> DataFrame:
    """What each caret stands for: a region of its own, and groups it shares."""
    return _by_project_table(
        spark, "carets", sf,
        lambda: rg.caret_targets(asked(spark, sf), records(spark, sf)),
    )


def region_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Regions by file and the key they share."""
    return _by_project_table(spark, "region_groups", sf, lambda: rg.region_groups(records(spark, sf)))


@query
def highlights(spark, sf):
    h = rg.highlights(carets(spark, sf), region_groups(spark, sf))
    return h.select("cursor_id", "hit_type", "n_regions", "n_highlighted")


def _highlight_counts(spark, sf, highlight_self: bool) -> DataFrame:
    counts = rg.highlight_counts(carets(spark, sf), region_groups(spark, sf), highlight_self)
    return counts.select("project", "filename", "n_carets", "n_highlighted")


@query
def highlight_counts(spark, sf):
    return _highlight_counts(spark, sf, True)


@query
def highlight_counts_others(spark, sf):
    """Without what each caret itself is on, as an editor counts by default."""
    return _highlight_counts(spark, sf, False)


def _rename_regions(spark, sf) -> tuple[DataFrame, DataFrame]:
    requests = docs.requests(_dealt(spark, sf))
    # A caret is of one project, by which both are dealt.
    hit = asked(spark, sf).join(requests.select("project", "cursor_id"), ["project", "cursor_id"], "left_semi")
    return rg.text_regions(hit, records(spark, sf), files(spark, sf), region_groups(spark, sf)), requests


@query
def rename_regions(spark, sf):
    found, _ = _rename_regions(spark, sf)
    return found.select("cursor_id", "filename", "a", "b", "region_text").distinct()


@query
def renamed_files(spark, sf):
    found, requests = _rename_regions(spark, sf)
    out = rw.renamed_files(found, requests, files(spark, sf))
    return out.select("cursor_id", "filename", F.md5("new_content").alias("new_md5"), "n_edits", "n_overlapping")


def _rename_tables(spark, sf) -> tuple[DataFrame, DataFrame]:
    return rg.rename_tables(asked(spark, sf), carets(spark, sf), region_groups(spark, sf), files(spark, sf))


def _shown_key() -> Column:
    """A group's key, with a sign that every reader takes where a part is missing."""
    return F.translate("key", "\0", "\1").alias("key")


@query
def rename_targets(spark, sf):
    """The groups that each caret selects or renames."""
    return _rename_tables(spark, sf)[0].select("cursor_id", "filename", _shown_key(), "region_text")


@query
def rename_edits(spark, sf):
    """The regions of each group that a caret selects or renames."""
    return _rename_tables(spark, sf)[1].select("filename", _shown_key(), "region_text", "a", "b")


# -- state -------------------------------------------------------------------------------------


def run_log(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs: all documents, then the changed ones, now three lines long.

    Of the files run again, those with ``doc_id % 30 = 0`` came back without records.
    """
    first = records(spark, sf).withColumn("run_seq", F.lit(1).cast("bigint"))
    again = first.where((F.col("file_ord") % 3 == 0) & (F.col("file_ord") % 30 != 0) & (F.col("pos") < F.lit(4 << 31)))
    return first.unionByName(again.withColumn("run_seq", F.lit(2).cast("bigint")))


@query
def current_records(spark, sf):
    current = st.current_records(run_log(spark, sf))
    return current.groupBy("project", "filename", "semantic", "run_seq").agg(
        F.count("*").alias("n"), F.sum("pos").alias("sum_pos")
    )


@query
def current_records_mentioned(spark, sf):
    """The same, when runs also say which files they read: files without records go away."""
    log = run_log(spark, sf)
    empty = (
        records(spark, sf).where(F.col("file_ord") % 30 == 0)
        .select("project", "scope", "filename", "file_ord").distinct()
        .withColumn("run_seq", F.lit(2).cast("bigint"))
    )
    return st.current_records(log, empty).groupBy("project", "filename", "run_seq").agg(F.count("*").alias("n"))


def _kept(df: DataFrame, name: str, tasks: int) -> DataFrame:
    """Written, as a compacted log is, and read back."""
    return read_table(df.sparkSession, write_table(df, name, scratch(df.sparkSession, name), (), "project", tasks), "project")


@query
def compacted_records(spark, sf):
    """The log merged run by run: the second run, then an older one that came late, then a third one."""
    runs = run_log(spark, sf)
    first, second = runs.where("run_seq = 1"), runs.where("run_seq = 2")
    late = first.where(F.col("file_ord") % 3 == 0)
    third = first.where((F.col("file_ord") % 7 == 0) & (F.col("pos") < F.lit(3 << 31))).withColumn("run_seq", F.lit(3).cast("bigint"))
    emptied = first.where(F.col("file_ord") % 70 == 1).select("project", "scope", "filename", "file_ord").distinct()
    emptied = emptied.withColumn("run_seq", F.lit(3).cast("bigint"))
    current = first.where(F.col("file_ord") % 3 != 0)
    versions = st.file_versions(current).drop("first_run")
    tasks = _n_tasks(spark, sf)
    for delta, mentioned in ((second, None), (late, None), (third, emptied)):
        current, versions = st.compact(current, versions, delta, mentioned)
        current, versions = _kept(current, "compacted", tasks), _kept(versions, "versions", tasks)
    return current.groupBy("project", "filename", "semantic", "run_seq").agg(
        F.count("*").alias("n"), F.sum("pos").alias("sum_pos")
    )


@query
def latest_report(spark, sf):
    """Library reports replace everything of their project."""
    log = run_log(spark, sf).where(F.col("scope") == "classpath")
    return st.latest_report(log).groupBy("project", "run_seq", "semantic").agg(F.count("*").alias("n"))


@query
def cleared_state(spark, sf):
    log = run_log(spark, sf)
    clears = (
        log.select("project").distinct()
        .where(F.substring("project", 2, 20).cast("bigint") % 7 == 0)
        .withColumn("clear_seq", F.lit(1).cast("bigint"))
    )
    return st.without_cleared(log, clears).groupBy("project", "run_seq").agg(F.count("*").alias("n"))


# -- events --------------------------------------------------------------------------------------


@query
def applicable_events(spark, sf):
    return ev.applicable(editor_events(spark, sf)).select("change_count", "view_id", "kind", "syntax")


@query
def refresh_requests(spark, sf):
    r = ev.refresh_requests(ev.applicable(editor_events(spark, sf)))
    return r.select("change_count", "view_id", "kind", "refresh", "is_delayed", "annotate")


# Events of the table are hours apart, so pauses are counted in hours here.
GAP = "6 hours"


def _view_state(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Newest edit and last analysis of each view, as of the last event."""
    events = ev.applicable(editor_events(spark, sf))
    now = editor_events(spark, sf).agg(F.max("ts")).scalar()
    due = ev.debounced(events, GAP).where(F.col("analyse_at") <= now)
    return ev.view_versions(events), ev.view_analyses(events, due)


@query
def stale_files(spark, sf):
    """Views changed since their last analysis."""
    return st.stale_files(*_view_state(spark, sf))


@query
def fresh_highlights(spark, sf):
    """Highlights of views analysed at their present version; document n is open in view n."""
    view = F.concat(F.lit("v"), F.regexp_extract("filename", "/d([0-9]+)", 1))
    # The gate comes first: only carets of fresh views are looked at.  Files pass it, so carets stay where they are.
    shown = carets(spark, sf).select(*ix.FILE).distinct().withColumn("view_id", view)
    passed = st.fresh(shown, *_view_state(spark, sf), ["view_id"]).select(*ix.FILE)
    fresh = carets(spark, sf).join(passed, list(ix.FILE), "left_semi")
    counts = rg.highlight_counts(fresh, region_groups(spark, sf), False)
    return counts.select(view.alias("view_id"), "filename", "n_carets", "n_highlighted")


@query
def closed_view_state(spark, sf):
    """Edits still known after views were closed."""
    events = ev.applicable(editor_events(spark, sf))
    log = events.where("kind = 'modified'").select("view_id", F.col("change_count").alias("run_seq"))
    kept = st.without_cleared(log, ev.closed_views(events), ["view_id"])
    return kept.groupBy("view_id").agg(F.count("*").alias("n"))


def _bursts(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_edit", "analyse_at")})


@query
def debounced_edits(spark, sf):
    return _bursts(ev.debounced(ev.applicable(editor_events(spark, sf)), GAP))


_LAST_USER = 9_000_000_000_001  # of the closing event; like all others it has to be applicable


@query
def debounced_edits_stream(spark, sf):
    """The same, streamed.  A last event far in the future lets every burst close."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    last = scratch(spark, "sentinel")
    (
        events.agg((F.max("ts") + F.expr("interval 30 days")).alias("ts"), F.max("event_id").alias("event_id"))
        .select("event_id", "ts", F.lit(_LAST_USER).cast("bigint").alias("user_id"), F.lit("click").alias("event_type"),
                F.lit(0.0).alias("value"), F.lit("{}").alias("props"))
        .write.parquet(last)
    )
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf).unionByName(
        spark.readStream.schema(events.schema).parquet(last)
    )
    bursts = ev.debounced(ev.applicable(as_editor_events(stream)), GAP)
    out = ig.to_table(bursts, scratch(spark, "bursts"), scratch(spark, "bursts-state"))
    return _bursts(out.where(F.col("view_id") != f"v{_LAST_USER}"))


def _live_views(spark, sf, last: bool) -> DataFrame:
    """Events in three files, one micro-batch each, through the stateful operator; ``last`` adds an event that closes all bursts."""
    events, folder = spark.read.parquet(f"{sf}/events.parquet"), scratch(spark, "live")
    begin, end = events.agg(F.min("ts"), F.max("ts")).first()
    third = F.floor(F.lit(3) * (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit(begin).cast("timestamp")))
                    / (F.unix_micros(F.lit(end).cast("timestamp")) - F.unix_micros(F.lit(begin).cast("timestamp")) + 1))
    for n in range(3):
        events.where(third == n).coalesce(1).write.mode("append").parquet(folder)
    if last:
        (
            events.agg((F.max("ts") + F.expr("interval 30 days")).alias("ts"), F.max("event_id").alias("event_id"))
            .select("event_id", "ts", F.lit(_LAST_USER).cast("bigint").alias("user_id"), F.lit("click").alias("event_type"),
                    F.lit(0.0).alias("value"), F.lit("{}").alias("props"))
            .coalesce(1).write.mode("append").parquet(folder)
        )
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    spark.conf.set(store, live.ROCKSDB)
    try:
        seen = live.followed(ev.applicable(as_editor_events(stream).withWatermark("ts", "0 seconds")), GAP)
        return ig.to_table(seen, scratch(spark, "followed"), scratch(spark, "followed-state"))
    finally:
        spark.conf.set(store, before)


@query
def live_bursts(spark, sf):
    """Bursts as they fall due, from a stateful operator with timers."""
    out = _live_views(spark, sf, True).where(F.col("view_id") != f"v{_LAST_USER}")
    return _bursts(live.bursts(out))


@query
def live_stale_files(spark, sf):
    """Views changed since their last analysis, followed live up to the last event."""
    return live.stale(_live_views(spark, sf, False))


# -- archives ------------------------------------------------------------------------------------


@query
def archive_members(spark, sf):
    """Every document packed into an archive, and read back out of it."""
    f = files(spark, sf).select(
        F.concat(F.lit("/jars"), "filename", F.lit(".jar")).alias("archive"),
        F.substring("filename", 2, 1000).alias("member"),
        "content",
    )
    wanted = fs.wanted_members(f.select(F.concat_ws(":", "archive", "member").alias("filename")))
    return fs.read_members(fs.pack_members(f), wanted).select("archive", "member", F.md5("content").alias("content_md5"))
