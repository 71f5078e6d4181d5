import inspect

import pytest
from pyspark.sql import functions as F

from refweave.functions import scalars as sc
from refweave.functions import text as tx


def one(spark, expression, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return df.select(expression.alias("x")).first().x


@pytest.mark.parametrize(
    "filename, ext",
    [("/a/b.clj", ".clj"), ("b.test.cljc", ".cljc"), ("-", ""), (".x", ""), ("a.", ""), ("a.b/c", ""),
     ("x.jar:p/q.cljs", ".cljs"), ("a.clj/", ".clj"), (None, None), ("", None)],
)
def test_file_extension(spark, filename, ext):
    assert one(spark, sc.file_extension(F.col("f").cast("string")), f=filename) == ext


@pytest.mark.parametrize("ext, fits", [(".cljc", {".clj", ".cljs", ".cljc"}), (".cljs", {".cljs", ".cljc"}), ("", {".clj"})])
def test_definition_extensions(spark, ext, fits):
    assert set(one(spark, sc.definition_extensions(F.col("e")), e=ext)) == fits


@pytest.mark.parametrize(
    "symbol, ns, name",
    [("a/b", "a", "b"), ("b", None, "b"), ("a/b/c", "a", "b"), ("clojure.core//", "clojure.core", ""), ("/", "", "")],
)
def test_symbols_split_on_every_slash(spark, symbol, ns, name):
    assert one(spark, sc.symbol_namespace(F.col("s")), s=symbol) == ns
    assert one(spark, sc.symbol_name(F.col("s")), s=symbol) == name


@pytest.mark.parametrize(
    "doc",
    ["One line", "  First\n    second\n      third\n", "\n\n  a\n\n  b\n\n", "a\n\tb\n\t\tc", "x\n  \n  y", "", "é\n   ü\n  ö",
     "no indent\nat all"],
)
def test_clean_doc(spark, doc):
    assert one(spark, sc.clean_doc(F.col("d")), d=doc) == inspect.cleandoc(doc)


def test_lookup_key_keeps_missing_apart_from_empty(spark):
    keys = {
        one(spark, sc.lookup_key("k", F.col("a").cast("string"), F.col("b").cast("string")), a=a, b=b)
        for a in (None, "", "x") for b in (None, "", "x")
    }
    assert len(keys) == 9


def test_key_parts_inverts_lookup_key(spark):
    key = sc.lookup_key("var", F.col("a").cast("string"), F.col("b").cast("string"))
    for a, b in [("n", "x"), (None, "x"), ("", None)]:
        got = [one(spark, part, a=a, b=b) for part in sc.key_parts(key)]
        assert got == ["var", a, b]


@pytest.mark.parametrize("n", [1, 2, 255, 256, 257, 1000])
def test_running_starts(spark, n):
    lengths = [(7 * i) % 13 for i in range(n)]
    df = spark.createDataFrame([(lengths,)], "l array<int>")
    assert df.select(tx.running_starts(F.col("l"))).first()[0] == [sum(lengths[:i]) for i in range(n)]


def test_text_between_reads_across_pieces(spark):
    content = "".join(chr(97 + i % 26) if i % 50 else "\n" for i in range(2000)) + "é𝄞ü"
    spans = [(0, 5), (250, 260), (255, 256), (256, 257), (10, 1500), (1999, 2003), (7, 7)]
    df = spark.createDataFrame([(content, a, b) for a, b in spans], "c string, a int, b int")
    got = df.select(tx.text_between(tx.pieces(F.col("c")), F.col("a"), F.col("b"))).collect()
    assert [g[0] for g in got] == [content[a:b] for a, b in spans]


def test_labels(make):
    r = make(
        ("keyword", {"name": "k", "ns": "", "reg": "re-frame/sub", "row": 2, "col": 3}),
        ("var_definition", {"name": "f", "ns": "n", "arglist_strs": ["[a]", "[a b]"]}),
        ("var_usage", {"name": "f", "to_ns": "n", "from_ns": "m", "from_var": ""}),
        ("local", {"name": "x"}),
        ("finding", {"message": "bad", "type": "syntax", "level": "error"}),
    )
    full = sc.label(show_namespace=True, show_row_col=True, show_filename=True)
    got = {x.semantic: x.l for x in r.select("semantic", full.alias("l")).collect()}
    assert tuple(got["keyword"]) == (":k:2:3", "/p/a.clj", "re-frame/sub")
    assert tuple(got["var_definition"]) == ("n/f:1:1", "/p/a.clj", "[a] [a b]")
    assert tuple(got["var_usage"]) == ("m:1:1", "/p/a.clj", "")
    assert got["local"] is None
    assert tuple(got["finding"]) == ("bad", "", "syntax")
    plain = {x.semantic: x.l for x in r.select("semantic", sc.label().alias("l")).collect()}
    assert plain["var_definition"].trigger == "f" and plain["var_usage"].trigger == ""


def test_qualified_names(make):
    r = make(
        ("keyword", {"name": "k", "ns": "a"}), ("keyword", {"name": "k"}), ("var_usage", {"name": "v", "ns": "", "to_ns": "t"}),
        ("namespace_usage", {"to_ns": "t"}), ("symbol", {"symbol": "s"}),
    )
    assert [x[0] for x in r.orderBy("pos").select(sc.qualified_name()).collect()] == [":a/k", ":k", "t/v", "t", None]


def test_below_directory(spark):
    inside = sc.below_directory(F.col("f"), F.col("d"))
    assert one(spark, inside, f="/a/b/c.clj", d="/a/b")
    assert one(spark, inside, f="/a/b/c.clj", d="/a/b/")
    assert not one(spark, inside, f="/a/bc/c.clj", d="/a/b")
    assert not one(spark, inside, f="/a/b", d="/a/b")
