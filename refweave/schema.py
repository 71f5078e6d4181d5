"""The record table: one row per fact the linter reports."""

# (column, report field, Spark type).  Fixed values: the linter's field names.
RECORD_FIELDS = [
    ("filename", "filename", "string"),
    ("row", "row", "int"),
    ("col", "col", "int"),
    ("end_row", "end-row", "int"),
    ("end_col", "end-col", "int"),
    ("name_row", "name-row", "int"),
    ("name_col", "name-col", "int"),
    ("name_end_row", "name-end-row", "int"),
    ("name_end_col", "name-end-col", "int"),
    ("name", "name", "string"),
    ("ns", "ns", "string"),
    ("from_ns", "from", "string"),
    ("to_ns", "to", "string"),
    ("from_var", "from-var", "string"),
    ("alias", "alias", "string"),
    ("alias_row", "alias-row", "int"),
    ("alias_col", "alias-col", "int"),
    ("alias_end_row", "alias-end-row", "int"),
    ("alias_end_col", "alias-end-col", "int"),
    ("local_id", "id", "bigint"),
    ("class_name", "class", "string"),
    ("method_name", "method-name", "string"),
    ("uri", "uri", "string"),
    ("symbol", "symbol", "string"),
    ("reg", "reg", "string"),
    ("keys_destructuring", "keys-destructuring", "boolean"),
    ("arglist_strs", "arglist-strs", "array<string>"),
    ("doc", "doc", "string"),
    ("lang", "lang", "string"),
    ("defined_by", "defined-by", "string"),
    ("refer", "refer", "boolean"),
    ("macro", "macro", "boolean"),
    ("arity", "arity", "int"),
    ("fixed_arities", "fixed-arities", "array<int>"),
    ("level", "level", "string"),
    ("type", "type", "string"),
    ("message", "message", "string"),
]

# Report array -> semantic tag.  Fixed values: the linter's array names.
SEMANTIC_OF_ARRAY = {
    "namespace-definitions": "namespace_definition",
    "namespace-usages": "namespace_usage",
    "var-definitions": "var_definition",
    "var-usages": "var_usage",
    "locals": "local",
    "local-usages": "local_usage",
    "keywords": "keyword",
    "symbols": "symbol",
    "java-class-usages": "java_class_usage",
    "java-class-definitions": "java_class_definition",
}

FINDING = "finding"
SEMANTICS = [*SEMANTIC_OF_ARRAY.values(), FINDING]

# What each scope answers questions about.  A view knows everything about one
# file; the sources of a project lack locals and findings; libraries only define.
SCOPE_SEMANTICS = {
    "view": SEMANTICS,
    "paths": [s for s in SEMANTICS if s not in ("local", "local_usage", FINDING)],
    "classpath": [
        "namespace_definition",
        "var_definition",
        "keyword",
        "java_class_definition",
    ],
}

# Identity and order columns in front of the report fields.  ``file_ord`` is the
# order in which files entered the index, ``pos`` the place within a report array;
# together they are the order that "the first" and "the last" refer to.
KEY_COLUMNS = ["project", "scope", "semantic", "ext", "file_ord", "pos"]

RECORD_COLUMNS = [*KEY_COLUMNS, *(column for column, _, _ in RECORD_FIELDS)]
