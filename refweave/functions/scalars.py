"""Column expressions over one record.  All run inside codegen, no UDFs."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Control characters never occur in source names, so they are safe as separators.
_SEP, _NONE = "\x1f", "\x00"


def text_or_null(c) -> Column:
    """The empty string counts as missing."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c != "", c)


def number_or_null(c) -> Column:
    """Zero counts as missing."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c != 0, c)


def lookup_key(kind: Column | str, *parts: Column) -> Column:
    """One string key in which a missing part equals a missing part, and nothing else."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.concat_ws(_SEP, kind, *(F.coalesce(p, F.lit(_NONE)) for p in parts))


def key_parts(key: Column) -> tuple[Column, Column, Column]:
    """Kind and two parts of a :func:`lookup_key`."""
    parts = F.split(key, _SEP)

    def part(n: int) -> Column:
        return F.when(F.get(parts, F.lit(n)) != _NONE, F.get(parts, F.lit(n)))

    return parts[0], part(1), part(2)


def file_extension(filename: Column) -> Column:
    """Last suffix of the last path part, '' without one, null without a filename."""
    base = F.regexp_extract(filename, r"([^/]+)/*$", 1)
    return F.when(filename != "", F.regexp_extract(base, r"^.+(\.[^.]+)$", 1))


def definition_extensions(ext: Column) -> Column:
    """Extensions of the files in which a thing seen in an ``ext`` file may be defined."""
    return (
        F.when(ext == ".cljc", F.array(F.lit(".clj"), F.lit(".cljs"), F.lit(".cljc")))
        .when(ext != "", F.array(ext, F.lit(".cljc")))
        .otherwise(F.array(F.lit(".clj")))
    )


def own_extension(ext: Column) -> Column:
    """Extension a definition counts as: a file without one counts as Clojure."""
    return F.when(ext != "", ext).otherwise(F.lit(".clj"))


def extension_name(ext: Column) -> Column:
    return F.regexp_replace(ext, r"\.", "")


def language(lang: Column, ext: Column) -> Column:
    return F.coalesce(text_or_null(lang), extension_name(ext))


def symbol_namespace(symbol: Column) -> Column:
    parts = F.split(symbol, "/")
    return F.when(F.size(parts) > 1, parts[0])


def symbol_name(symbol: Column) -> Column:
    parts = F.split(symbol, "/")
    return F.when(F.size(parts) > 1, parts[1]).otherwise(parts[0])


def owner() -> Column:
    """Namespace a name belongs to; an empty ``ns`` falls through to ``to``."""
    return F.coalesce(text_or_null("ns"), text_or_null("to_ns"))


def qualified_name() -> Column:
    prefix = F.when(F.col("semantic") == "keyword", ":").otherwise("")
    ns, name = owner(), text_or_null("name")
    return F.when(
        name.isNotNull(),
        F.concat(prefix, F.when(ns.isNotNull(), F.concat(ns, F.lit("/"), name)).otherwise(name)),
    ).otherwise(ns)


def location() -> Column:
    """Where an editor would jump to; null without a filename."""
    return F.when(
        F.col("filename") != "",
        F.struct(
            F.col("filename").alias("filename"),
            F.coalesce(number_or_null("name_row"), F.col("row")).alias("line"),
            F.coalesce(number_or_null("name_col"), F.col("col")).alias("column"),
        ),
    )


def region() -> Column:
    """Name position where the record has one, else the position of the form."""
    return F.struct(
        F.coalesce("name_row", "row").alias("start_row"),
        F.coalesce("name_col", "col").alias("start_col"),
        F.coalesce("name_end_row", "end_row").alias("end_row"),
        F.coalesce("name_end_col", "end_col").alias("end_col"),
    )


def alias_region() -> Column:
    return F.when(
        F.col("alias") != "",
        F.struct(
            F.col("alias_row").alias("start_row"),
            F.col("alias_col").alias("start_col"),
            F.col("alias_end_row").alias("end_row"),
            F.col("alias_end_col").alias("end_col"),
        ),
    )


def namespace_part_region() -> Column:
    """Part of a var usage that names its namespace: the alias, or all of the name."""
    aliased = F.col("alias") != ""
    complete = (
        F.col("name_row").isNotNull()
        & F.col("name_col").isNotNull()
        & F.col("name_end_row").isNotNull()
        & F.col("name_end_col").isNotNull()
    )
    return F.when(
        complete,
        F.struct(
            F.col("name_row").alias("start_row"),
            F.col("name_col").alias("start_col"),
            F.when(aliased, F.col("name_row")).otherwise(F.col("name_end_row")).alias("end_row"),
            F.when(aliased, F.col("name_col") + F.length("alias"))
            .otherwise(F.col("name_end_col"))
            .alias("end_col"),
        ),
    )


def finding_region() -> Column:
    return F.struct(
        F.col("row").alias("start_row"),
        F.col("col").alias("start_col"),
        F.coalesce(number_or_null("end_row"), F.col("row")).alias("end_row"),
        F.coalesce(number_or_null("end_col"), F.col("col")).alias("end_col"),
    )


def label(show_namespace=False, show_row_col=False, show_filename=False) -> Column:
    """List entry ``(trigger, details, annotation)``; null for kinds never listed."""
    sem = F.col("semantic")
    at = F.concat_ws(":", "row", "col")
    name = F.coalesce("name", F.lit(""))
    from_var = text_or_null("from_var")
    var_ns = F.coalesce("ns", "to_ns", F.lit(""))

    var = F.concat(var_ns, F.lit("/"), name) if show_namespace else name
    used_in = (
        F.when(from_var.isNotNull(), F.concat(F.coalesce("from_ns", F.lit("")), F.lit("/"), from_var))
        .otherwise(F.coalesce("from_ns", F.lit("")))
        if show_namespace
        else F.coalesce(from_var, F.lit(""))
    )
    keyword_ns = text_or_null("ns")
    keyword = F.concat(
        F.lit(":"), F.when(keyword_ns.isNotNull(), F.concat(keyword_ns, F.lit("/"))).otherwise(""), name
    )

    def with_position(c: Column) -> Column:
        return F.concat_ws(":", c, at) if show_row_col else c

    trigger = (
        F.when(sem == "namespace_definition", with_position(name))
        .when(sem == "namespace_usage", with_position(F.coalesce("from_ns", F.lit(""))))
        .when(sem == "var_definition", with_position(var))
        .when(sem == "var_usage", with_position(used_in))
        .when(sem == "local_usage", at)
        .when(sem == "keyword", with_position(keyword))
        .when(sem == "symbol", with_position(F.coalesce("symbol", F.lit(""))))
        .when(sem == "finding", F.col("message"))
    )
    filename = F.coalesce("filename", F.lit(""))
    details = (
        F.when(sem == "finding", "")
        .when(sem == "local_usage", filename)
        .otherwise(filename if show_filename else F.lit(""))
    )
    annotation = (
        F.when(sem == "var_definition", F.array_join(F.coalesce("arglist_strs", F.array().cast("array<string>")), " "))
        .when(sem == "keyword", F.coalesce("reg", F.lit("")))
        .when(sem == "finding", F.col("type"))
        .otherwise("")
    )
    return F.when(
        trigger.isNotNull(),
        F.struct(trigger.alias("trigger"), details.alias("details"), annotation.alias("annotation")),
    )


def symbol_kind() -> Column:
    sem = F.col("semantic")
    return (
        F.when(sem == "keyword", "keyword")
        .when(sem.isin("local", "local_usage"), "variable")
        .when(
            sem.isin("var_definition", "var_usage"),
            F.when(F.coalesce(F.size("arglist_strs"), F.lit(0)) > 0, "function").otherwise("variable"),
        )
        .when(sem.isin("namespace_definition", "namespace_usage"), "namespace")
        .otherwise("ambiguous")
    )


def clean_doc(doc: Column) -> Column:
    """Docstring without its common indent, outer blank lines and tabs."""

    def expand_tabs(line):
        cells = F.split(line, "\t")
        return F.aggregate(
            F.slice(cells, F.lit(2), F.size(cells)),
            cells[0],
            lambda done, cell: F.concat(
                F.rpad(done, (F.floor(F.length(done) / 8).cast("int") + 1) * 8, F.lit(" ")), cell
            ),
        )

    def indent(line):
        return F.length(line) - F.length(F.ltrim(line))

    lines = F.transform(F.split(doc, "\n"), expand_tabs)
    later = F.slice(lines, F.lit(2), F.size(lines))
    margin = F.array_min(F.transform(F.filter(later, lambda x: F.ltrim(x) != ""), indent))
    body = F.transform(later, lambda x: F.substring(x, F.coalesce(margin, F.lit(0)) + 1, F.length(x)))
    joined = F.array_join(F.concat(F.array(F.ltrim(lines[0])), body), "\n")
    return F.coalesce(F.btrim(joined, F.lit("\n")), F.lit(""))


# -- predicates ------------------------------------------------------------------


def has_position() -> Column:
    return (F.col("row") != 0) & (F.col("col") != 0)


def is_registering() -> Column:
    """Keyword that defines something, such as a spec or an event handler."""
    return F.coalesce(F.col("reg"), F.lit("")) != ""


def is_recursive() -> Column:
    return F.col("from_ns").eqNullSafe(F.col("to_ns")) & F.col("name").eqNullSafe(F.col("from_var"))


def below_directory(filename: Column, directory: Column) -> Column:
    return F.startswith(filename, F.concat(F.rtrim(directory, F.lit("/")), F.lit("/")))
