import pytest
from conftest import rows
from pyspark.sql import functions as F

from refweave.operators import catalog as cat
from refweave.operators import index as ix
from refweave.operators import lookup as lk
from refweave.operators import navigate as nav
from refweave.operators import scopes as sp
from refweave.operators.dedupe import dedupe, dedupe_answers, mark_single
from refweave.operators.report import usage_report, write_report
from refweave.plans import state as st


def var_def(name, ns="n", **kw):
    return ("var_definition", {"name": name, "ns": ns, "name_row": kw.get("row", 1), "name_col": kw.get("col", 1)} | kw)


def var_use(name, to="n", **kw):
    return ("var_usage", {"name": name, "to_ns": to, "name_row": kw.get("row", 1), "name_col": kw.get("col", 1)} | kw)


def test_keyword_without_namespace_matches_only_those(make):
    r = make(
        ("keyword", {"name": "k", "row": 1}), ("keyword", {"name": "k", "row": 2}), ("keyword", {"name": "k", "ns": "", "row": 3}),
        ("keyword", {"name": "k", "ns": "a", "row": 4}), ("keyword", {"name": "k", "row": 5, "reg": "spec/def"}),
    )
    found = lk.keyword_occurrences(r)
    assert rows(found, "row", "n_asked") == [(1, 3), (2, 3), (3, 1), (4, 1), (5, 3)]
    assert rows(lk.keyword_usages(r), "row") == [(1,), (2,), (3,), (4,)]
    assert rows(lk.keyword_definitions(r), "row", "is_first") == [(5, True)]


def test_projects_do_not_mix(make):
    r = make(var_def("f"), project="p").unionByName(make(var_use("f"), project="q"))
    assert lk.var_definitions(r).count() == 1
    assert lk.var_usages(r).select("project").distinct().count() == 1


def test_first_definition_needs_a_fitting_extension(make):
    r = make(
        var_def("f", filename="/p/a.cljs", row=1), var_def("f", filename="/p/b.cljc", row=2),
        var_def("f", filename="/p/c.clj", row=3), var_def("f", filename="/p/noext", row=4),
        var_use("f", filename="/p/u.clj"), var_use("f", filename="/p/u.cljs"), var_use("f", filename="/p/u.cljc"),
        var_use("f", filename="/p/u.bb"), var_use("f", filename="-"),
    )
    found = lk.var_definition_first(r).where("semantic = 'var_usage'")
    got = dict(rows(found, "filename", F.col("definition.row")))
    assert got == {"/p/u.clj": 2, "/p/u.cljs": 1, "/p/u.cljc": 1, "/p/u.bb": 2, "-": 3}


def test_namespace_usages_from_a_file_without_extension_find_nothing(make):
    use = lambda f: ("namespace_usage", {"to_ns": "n", "name_row": 1, "filename": f})
    assert lk.namespace_usages(make(use("-"))).count() == 0
    assert lk.namespace_usages(make(use("-"), use("a.clj"))).count() == 2


def test_vars_and_symbols_find_each_other(make):
    r = make(var_def("f", row=1), var_use("f", row=2), ("symbol", {"symbol": "n/f", "row": 3}), ("symbol", {"symbol": "n/g/x", "row": 4}),
             var_use("g", row=5))
    by_var = lk.var_usages(r)
    assert rows(by_var.where("target LIKE '%f'"), "branch", "row") == [(0, 2), (1, 3)]
    by_symbol = lk.symbol_usages(r)
    assert rows(by_symbol, "branch", "row") == [(0, 3), (0, 4), (1, 2), (1, 5)]
    assert rows(lk.symbol_definitions(r), "row", "is_first") == [(1, True)]


def test_java_method_narrows_usages(make):
    use = lambda row, m=None: ("java_class_usage", {"class_name": "C", "method_name": m, "row": row})
    found = lk.java_usages(make(use(1), use(2, "m"), use(3, "x"), use(4, "")))
    got = {}
    for t, row in rows(found, "target", "row"):
        got.setdefault(t.split("\x1f")[2], set()).add(row)
    assert got == {"\x00": {1, 2, 3, 4}, "m": {2}, "x": {3}}


def test_java_definition_is_the_last(make):
    r = make(("java_class_definition", {"class_name": "C", "row": 1}), ("java_class_definition", {"class_name": "C", "row": 2}),
             ("java_class_usage", {"class_name": "C"}), ("java_class_usage", {"class_name": "D"}))
    found = lk.java_definitions(r, r)
    assert rows(found, "class_name", F.col("definition.row")) == [("C", 2), ("D", None)]


def test_local_usage_without_binding(make):
    r = make(("local", {"local_id": 1, "row": 1}), ("local", {"local_id": 1, "row": 2}), ("local_usage", {"local_id": 1, "name_row": 3}),
             ("local_usage", {"local_id": 9, "name_row": 4}))
    assert rows(lk.local_bindings(r), "local_id", F.col("binding.row")) == [(1, 2), (9, None)]


def test_recursive_usage_treats_missing_as_equal(make):
    r = make(var_use("f", from_ns="n", from_var="f"), var_use("f", from_ns="m", from_var="f"),
             ("var_usage", {"name_row": 1}))
    assert lk.recursive_usages(r).count() == 2


def test_dedupe_keeps_last_record_at_first_position(make):
    r = make(var_def("a", row=1), var_def("b", row=2), var_def("c", row=1), ("keyword", {"name": "k", "row": None}))
    kept = dedupe(r.select("project", "filename", "row", "col", "name", "file_ord", "pos"), ["project"], ["file_ord", "pos"])
    assert [x.name for x in kept.orderBy("list_ord").collect()] == ["c", "b"]
    one = mark_single(kept.where("name = 'c'"), ["project"])
    assert one.first().is_single
    twice = make(var_def("f"), var_use("f", row=2, pos=1), var_use("f", row=2, pos=5))
    listed = dedupe_answers(lk.var_usages(twice), ["project", "target"])
    assert rows(listed, "row", "pos", "semantic") == [(2, 5, "var_usage")]


def as_asked(df):
    """Records as carets on them."""
    return df.withColumns({"cursor_id": F.col("pos"), "begin_row": F.col("row"), "begin_col": F.col("col")})


@pytest.fixture
def scoped(make):
    in_file = make(var_def("both", row=7), var_use("both"), var_use("lib"), var_use("src"), var_use("none"),
                   ("local", {"local_id": 1, "row": 2, "name": "x"}), ("local_usage", {"local_id": 1, "row": 3, "name_row": 3, "name": "x"}))
    other = make(var_def("src", filename="/p/b.clj"), var_def("both", filename="/p/b.clj"), var_use("both", filename="/p/b.clj"))
    lib = make(var_def("lib", filename="/l/c.clj", doc=" D\n   e"), var_def("src", filename="/l/c.clj", doc="L"), scope="classpath")
    return in_file, in_file.unionByName(other).unionByName(lib)


def test_definitions_come_from_view_then_sources_then_libraries(scoped):
    asking, records = scoped
    ranked = sp.rank_definitions(asking, records)
    got = {t.split("\x1f")[2]: s for t, s in rows(ranked, "target", "answer_scope")}
    assert got == {"both": "view", "lib": "classpath", "src": "paths", "none": None, "1": "view"}
    listed = sp.list_definitions(ranked, records)
    assert ("paths", "/p/b.clj", None) in rows(listed, "answer_scope", "filename", "asking_file")
    assert ("view", "/p/a.clj", "/p/a.clj") in rows(listed, "answer_scope", "filename", "asking_file")


def test_docs_come_from_libraries_before_sources(scoped):
    asking, records = scoped
    cards = {x.qualified_name: x for x in sp.doc_cards(asking, records).collect()}
    assert cards["n/src"].answer_scope == "classpath" and cards["n/src"].doc == "L"
    assert cards["n/lib"].doc == "D\ne"
    assert cards["n/both"].answer_scope == "view" and cards["n/both"].line == 7


def test_usages_come_from_sources_then_view(scoped):
    asking, records = scoped
    ranked = sp.rank_usages(asking, records)
    got = {t.split("\x1f")[2]: (s, n) for t, s, n in rows(ranked, "target", "answer_scope", "n_paths")}
    assert got["both"] == ("paths", 2) and got["1"] == ("view", 0)
    view = sp.rank_usages(asking, records, view_only=True)
    assert {x.answer_scope for x in view.collect()} == {"view"}


def test_usage_report(scoped, tmp_path):
    asking, records = scoped
    asked = as_asked(asking)
    report = usage_report(asked, sp.rank_usages(asked, records), records)
    lines = [x.line for x in report.orderBy("project", "shown_name", "part", "filename", "row", "col").collect()]
    at = lines.index("Find Usages: n/both")
    assert lines[at + 1 : at + 3] == ["- /p/a.clj:1:1", "- /p/b.clj:1:1"]
    write_report(report, str(tmp_path / "report"))
    written = [l for p in sorted((tmp_path / "report").glob("part-*")) for l in p.read_text().splitlines()]
    assert written == lines


def test_usage_report_says_not_found(make):
    r = make(var_def("unused"))
    asked = as_asked(r)
    lines = [x.line for x in usage_report(asked, sp.rank_usages(asked, r), r).orderBy("part").collect()]
    assert lines == ["Find Usages: n/unused", "Not found."]


def test_catalogue_falls_back_to_views(make):
    views = make(var_def("a"), project="p").unionByName(make(var_def("b"), project="q"))
    paths = make(var_def("c", filename="/p/s.clj"), ("keyword", {"name": "k", "reg": "x", "filename": "/p/s.clj", "row": 2}), project="p")
    listed = cat.catalog_view_paths(views, paths)
    assert rows(listed, "project", "from_scope", "qualified_name") == [("p", "paths", ":k"), ("p", "paths", "n/c"), ("q", "view", "n/b")]
    ordered = [x.qualified_name for x in cat.by_name(cat.catalog(paths)).collect()]
    assert ordered == [":k", "n/c"]


def test_next_prev_walks_definition_usages_symbols(make):
    r = make(var_use("f", row=1), var_def("f", row=2), var_use("f", row=3), ("symbol", {"symbol": "n/f", "row": 4}), var_def("f", row=5))
    got = {x.row: (x.next_row, x.prev_row) for x in nav.next_prev(r).collect()}
    assert got == {1: (3, 2), 2: (1, None), 3: (4, 1), 5: (1, None)}


def test_destructuring_keyword_walks_its_local(make):
    r = make(("keyword", {"name": "k", "row": 1, "col": 2, "end_row": 1, "end_col": 3, "keys_destructuring": True}),
             ("keyword", {"name": "lost", "row": 2, "col": 2, "end_row": 2, "end_col": 3, "keys_destructuring": True}),
             ("local", {"name": "k", "row": 1, "col": 2, "end_row": 1, "end_col": 3, "local_id": 1}),
             ("local_usage", {"name": "k", "row": 9, "name_row": 9, "name_col": 4, "local_id": 1}))
    got = {(x.semantic, x.row): (x.next_row, x.prev_row) for x in nav.next_prev(r).collect()}
    assert got == {("keyword", 1): (9, None), ("local", 1): (9, None), ("local_usage", 9): (None, 1)}


def test_require_sites_pick_the_first(make):
    r = make(("namespace_usage", {"to_ns": "n", "name_row": 1, "name_col": 5, "row": 1}),
             ("namespace_usage", {"to_ns": "n", "name_row": 2, "name_col": 5, "row": 2}), var_use("f", row=3),
             ("java_class_usage", {"class_name": "C", "row": 4, "col": 2}))
    sites = nav.require_sites(as_asked(r), r)
    assert rows(sites, "pos", F.col("site.line")) == [(0, 1), (1, 1), (2, 1), (3, 4)]


def test_current_records_replace_whole_files(make):
    one = make(var_def("a", row=1), var_def("b", filename="/p/b.clj"), var_def("z", filename="/p/z.clj")).withColumn("run_seq", F.lit(1))
    two = make(var_def("c", row=9)).withColumn("run_seq", F.lit(2)).withColumn("file_ord", F.lit(77).cast("bigint"))
    log = one.unionByName(two)
    current = st.current_records(log)
    assert rows(current, "name", "file_ord") == [("b", 1), ("c", 0), ("z", 2)]
    empty = two.select("project", "scope", F.lit("/p/z.clj").alias("filename"), "run_seq", "file_ord")
    assert rows(st.current_records(log, empty), "name") == [("b",), ("c",)]
    clears = one.select("project", F.lit(1).alias("clear_seq")).limit(1)
    assert rows(st.without_cleared(log, clears), "name") == [("c",)]


def test_fresh_files_only(spark):
    asked = spark.createDataFrame([("v1",), ("v2",), ("v3",)], "view_id string")
    versions = spark.createDataFrame([("v1", 3), ("v2", 3)], "view_id string, change_count int")
    analyses = spark.createDataFrame([("v1", 3), ("v2", 2)], "view_id string, analysed_count int")
    assert rows(st.fresh(asked, versions, analyses, ["view_id"]), "view_id") == [("v1",)]
    assert rows(st.stale_files(versions, analyses), "view_id") == [("v2",)]


def test_an_open_view_stands_before_its_saved_file(make):
    saved = make(var_def("old", row=1), var_def("both", row=2), var_use("both", row=3))
    other = make(var_def("new", filename="/p/b.clj"), var_use("both", filename="/p/b.clj", row=4), var_use("old", filename="/p/b.clj", row=5))
    view = make(var_def("new", row=1), var_def("both", row=9), var_use("both", row=8), var_use("old", row=7), scope="view")
    emptied = make(var_def("gone", filename="/p/c.clj"))
    is_open = view.select("project", "filename").unionByName(emptied.select("project", "filename"))
    r = sp.overlay(saved.unionByName(other).unionByName(view).unionByName(emptied), is_open)
    assert rows(r.where("not shown"), "filename", "row") == [("/p/a.clj", 1), ("/p/a.clj", 2), ("/p/a.clj", 3), ("/p/c.clj", 1)]
    assert rows(sp.in_scope(r, "view").where("filename = '/p/a.clj'"), "scope").count(("view",)) == 4

    asking = sp.shown(r)
    ranked = sp.rank_definitions(asking, r)
    got = {(f, t.split("\x1f")[2]): (s, v, p) for f, t, s, v, p in rows(ranked, "filename", "target", "answer_scope", "n_view", "n_paths")}
    assert got["/p/a.clj", "both"] == ("view", 1, 1)  # once in each scope, not twice in one
    assert got["/p/a.clj", "old"] == ("paths", 0, 1)  # no longer in the view, still in what was saved
    assert got["/p/b.clj", "both"] == ("paths", 0, 1)
    listed = sp.list_definitions(ranked, r)
    assert [x.row for x in listed.where("asking_file = '/p/a.clj'").collect()] == [9]

    used = sp.rank_usages(asking, r)
    counts = {(f, t.split("\x1f")[2]): (s, p, v) for f, t, s, p, v in rows(used, "filename", "target", "answer_scope", "n_paths", "n_view")}
    assert counts["/p/a.clj", "both"] == ("paths", 2, 1)
    assert counts["/p/a.clj", "old"] == ("paths", 1, 1)
    cards = {(c.filename, c.qualified_name): c for c in sp.doc_cards(asking, r).collect()}
    assert cards["/p/a.clj", "n/both"].line == 9 and cards["/p/b.clj", "n/both"].line == 2
    assert cards["/p/b.clj", "n/new"].answer_scope == "view"
    without_sources = cat.catalog_view_paths(sp.in_scope(r, "view").where("scope = 'view'"), r.where("false"))
    assert {x.from_scope for x in without_sources.collect()} == {"view"}
