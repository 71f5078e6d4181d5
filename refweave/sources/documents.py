"""Documents read as source code: words are names, and each record kind has a rule.

Gives the engine records, files and caret positions over any table
``documents(doc_id, text, lang)``.  Lines are rows, single spaces separate words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import running_starts
from ..schema import RECORD_FIELDS

# File extension per document language; others have none.
EXTENSION_OF_LANG = {"en": ".clj", "fr": ".cljs", "de": ".cljc"}

DOCS_PER_PROJECT = 50
DOCS_PER_NAMESPACE = 5

LONG_LINE = 64  # words


def project() -> Column:
    return F.concat(F.lit("p"), F.expr(f"doc_id div {DOCS_PER_PROJECT}"))


def _ext() -> Column:
    ext = F.lit("")
    for lang, value in EXTENSION_OF_LANG.items():
        ext = F.when(F.col("lang") == lang, value).otherwise(ext)
    return ext


def _filename() -> Column:
    return F.concat(F.lit("/"), project(), F.lit("/d"), F.col("doc_id"), _ext())


def _scope() -> Column:
    """Seven of ten documents are project sources, the rest are libraries."""
    return F.when(F.col("doc_id") % 10 < 7, "paths").otherwise("classpath")


def _name(token: Column) -> Column:
    return F.lower(F.rtrim(token, F.lit(".,")))


def source_files(documents: DataFrame) -> DataFrame:
    """``files(project, filename, content)``, one row per document."""
    return documents.select(
        project().alias("project"), _filename().alias("filename"), F.col("text").alias("content")
    )


def tokens(documents: DataFrame) -> DataFrame:
    """One row per word with its exact position, and the first two words of its line."""
    lines = documents.select(
        "doc_id",
        "lang",
        project().alias("project"),
        _filename().alias("filename"),
        _ext().alias("ext"),
        F.posexplode(F.split("text", "\n")).alias("line_no", "line"),
    )
    words = F.split("line", " ")
    # Arrays of starts only where finding each word's start from the begin of its line would take long.
    starts = running_starts(F.transform("words", lambda w: F.length(w) + 1))
    counted = lines.withColumn("words", words).withColumn("starts", F.when(F.size("words") > LONG_LINE, starts))
    placed = counted.select(
        "doc_id", "lang", "project", "filename", "ext",
        (F.col("line_no") + 1).alias("row"),
        F.col("line").alias("line"),
        _name(F.col("words")[0]).alias("first_name"),
        F.when(F.size("words") > 1, _name(F.get("words", F.lit(1)))).alias("second_name"),
        "starts",
        F.posexplode("words").alias("k", "tok"),
    )
    k = F.col("k")
    before = F.when(k == 0, 0).otherwise(F.length(F.call_function("substring_index", F.col("line"), F.lit(" "), k)) + 1)
    start = F.when(F.col("starts").isNull(), before).otherwise(F.get("starts", k))
    return placed.where(F.col("tok") != "").select(
        "doc_id", "lang", "project", "filename", "ext", "row",
        (k + 1).alias("i"),
        (start + 1).alias("col"),
        "tok",
        _name(F.col("tok")).alias("name"),
        "first_name",
        "second_name",
        F.when(k == 0, F.col("line")).alias("line"),
    )


def _semantics() -> Column:
    """Record kinds of one word; most words have one, some have several."""
    tok, name, row, i = F.col("tok"), F.col("name"), F.col("row"), F.col("i")
    initial = F.substring(tok, 1, 1)
    lower_initial = F.lower(initial) == initial
    size = F.length(name)
    rules = {
        "namespace_definition": (row == 1) & (i == 1),
        "namespace_usage": (row == 1) & (i == 3),
        "var_definition": (row >= 2) & (i == 1),
        "var_usage": (i > 1) & ~F.endswith(tok, F.lit(",")) & lower_initial & (size < 12),
        "keyword": F.endswith(tok, F.lit(",")),
        "local": (row >= 2) & (i == 2),
        "local_usage": (row >= 2) & (i > 2) & (name == F.col("second_name")),
        "java_class_usage": (i > 1) & ~lower_initial,
        "symbol": size.between(12, 15),
        "finding": size >= 16,
    }
    # Joined and split again: unlike a filtered array this stays in generated code.
    return F.split(F.concat_ws(" ", *(F.when(rule, F.lit(sem)) for sem, rule in rules.items())), " ")


#: Every so manieth document is open in a view, and there begins with a line more.
OPEN_EVERY, DRAFT = 10, "Draft notes of changes."
#: Of so many projects in turn, one was never analysed as a whole.
PROJECTS, UNREAD = 5, 4


def open_documents(documents: DataFrame) -> DataFrame:
    """What open views hold of their documents, not saved yet."""
    return documents.where(F.col("doc_id") % OPEN_EVERY == 0).withColumn(
        "text", F.concat(F.lit(DRAFT + "\n"), F.col("text"))
    )


def shown_documents(documents: DataFrame) -> DataFrame:
    """What an editor shows of each document: its open view, if it has one."""
    is_open = F.col("doc_id") % OPEN_EVERY == 0
    shown = F.when(is_open, F.concat(F.lit(DRAFT + "\n"), F.col("text"))).otherwise(F.col("text"))
    return documents.where(is_open.isNotNull()).withColumn("text", shown)


def workspace(documents: DataFrame) -> DataFrame:
    """Records of saved files and of open views, without the sources of projects that were never analysed.

    Libraries define a class where one of their lines begins with a usage of it.
    """
    saved = records(documents)
    number = F.substring("project", 2, 20).cast("bigint")
    unread = (F.col("scope") == "paths") & (number % PROJECTS == UNREAD)
    read = saved.where(~unread)
    sem = F.col("semantic")
    defining = (F.col("scope") == "classpath") & (sem == "java_class_usage") & (F.col("col") < 12)
    kinds = F.when(defining, F.array(sem, F.lit("java_class_definition"))).otherwise(F.array(sem))
    views = records(open_documents(documents)).withColumn("scope", F.lit("view"))
    return read.withColumn("semantic", F.explode(kinds)).unionByName(views)


def open_views(documents: DataFrame) -> DataFrame:
    """``(project, filename)`` of the files that are open."""
    return source_files(open_documents(documents)).select("project", "filename")


def records(documents: DataFrame) -> DataFrame:
    """All records of all documents, also those without a valid position."""
    sem = F.col("semantic")
    doc, row, i, name = F.col("doc_id"), F.col("row"), F.col("i"), F.col("name")
    size = F.length(name)

    own = F.concat(F.lit("n"), F.expr(f"doc_id div {DOCS_PER_NAMESPACE}"))
    following = F.concat(F.lit("n"), F.expr(f"doc_id div {DOCS_PER_NAMESPACE} + 1"))
    named = sem.isin(
        "namespace_definition", "namespace_usage", "var_definition", "var_usage", "local_usage", "finding"
    )
    lost_row = (sem == "var_usage") & ((doc + i) % 97 == 0)
    name_end = F.col("col") + size
    arglist = F.when(
        F.coalesce("second_name", F.lit("")) != "",
        F.array(F.concat(F.lit("["), F.col("second_name"), F.lit("]"))),
    ).otherwise(F.array().cast("array<string>"))

    values = {
        "filename": F.col("filename"),
        "row": F.when(~lost_row, row),
        "col": F.col("col"),
        "end_row": row,
        "end_col": F.when(named, F.col("col") + F.length("tok")).otherwise(name_end),
        "name_row": F.when(named, row),
        "name_col": F.when(named, F.col("col")),
        "name_end_row": F.when(named, row),
        "name_end_col": F.when(named, name_end),
        "name": F.when(sem == "namespace_definition", own).when(
            sem.isin("var_definition", "var_usage", "keyword", "local", "local_usage"), name
        ),
        "ns": F.when(sem == "var_definition", own).when(
            (sem == "keyword") & (size % 2 == 0), F.col("lang")
        ),
        "from_ns": F.when(sem.isin("namespace_usage", "var_usage"), own),
        "to_ns": F.when(sem == "namespace_usage", following).when(
            sem == "var_usage", F.when(i % 4 == 0, following).otherwise(own)
        ),
        "from_var": F.when((sem == "var_usage") & (row >= 2), F.col("first_name")),
        "alias": F.when(sem == "namespace_usage", name),
        "alias_row": F.when(sem == "namespace_usage", row),
        "alias_col": F.when(sem == "namespace_usage", F.col("col")),
        "alias_end_row": F.when(sem == "namespace_usage", row),
        "alias_end_col": F.when(sem == "namespace_usage", name_end),
        "local_id": F.when(sem.isin("local", "local_usage"), row.cast("bigint")),
        "class_name": F.when(sem == "java_class_usage", name),
        "method_name": F.when((sem == "java_class_usage") & F.endswith("tok", F.lit(".")), F.lit("m")),
        "symbol": F.when(sem == "symbol", F.concat(own, F.lit("/"), name)),
        "reg": F.when((sem == "keyword") & (size % 5 == 0), F.lit("reg/def")),
        "keys_destructuring": F.when(sem == "keyword", i == 2),
        "arglist_strs": F.when(sem == "var_definition", arglist),
        "doc": F.when(sem.isin("namespace_definition", "var_definition"), F.col("line")),
        "level": F.when(
            sem == "finding",
            F.when(size == 16, "info").when(size < 20, "warning").otherwise("error"),
        ),
        "type": F.when(sem == "finding", F.lit("long-token")),
        "message": F.when(sem == "finding", F.concat(F.lit("Token too long: "), name)),
    }
    tagged = tokens(documents).withColumn("semantic", F.explode(_semantics())).where(sem != "")
    return tagged.select(
        "project",
        _scope().alias("scope"),
        "semantic",
        "ext",
        doc.cast("bigint").alias("file_ord"),
        (F.shiftleft(row.cast("bigint"), 31) + i).alias("pos"),
        *(
            values.get(column, F.lit(None)).cast(kind).alias(column)
            for column, _, kind in RECORD_FIELDS
        ),
    )


def cursors(documents: DataFrame) -> DataFrame:
    """A caret in the middle of every word of every document."""
    at = F.col("col") + F.floor(F.length("name") / 2).cast("int")
    return tokens(documents).select(
        F.concat_ws(":", "doc_id", "row", "i").alias("cursor_id"),
        "project",
        "filename",
        F.col("row").alias("begin_row"),
        at.alias("begin_col"),
        F.col("row").alias("end_row"),
        at.alias("end_col"),
    )


def requests(documents: DataFrame, new_text: str = "renamed") -> DataFrame:
    """One rename per document: the caret on the first word of its second line, or else its first caret."""
    word = F.substring_index("cursor_id", ":", -1).cast("int")
    carets = cursors(documents)
    later = ~((F.col("begin_row") == 2) & (word == 1))
    first = F.min_by(F.struct(*carets.columns), F.struct(later, "begin_row", word)).alias("c")
    return carets.groupBy("project", "filename").agg(first).select("c.*").withColumn("new_text", F.lit(new_text))
