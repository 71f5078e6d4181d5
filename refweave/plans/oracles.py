"""The same queries in ANSI SQL, over the same tables, written from the definitions."""

from __future__ import annotations

_TOKENS = """
lines AS (
  SELECT doc_id, lang, CAST(u.row AS INTEGER) AS row, u.line
  FROM documents, LATERAL unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(line, row)
),
words AS (
  SELECT doc_id, lang, row, line, CAST(u.i AS INTEGER) AS i, u.tok
  FROM lines, LATERAL unnest(string_split(line, ' ')) WITH ORDINALITY AS u(tok, i)
),
placed AS (
  SELECT *,
    CAST(1 + coalesce(sum(length(tok) + 1) OVER (PARTITION BY doc_id, row ORDER BY i
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS col,
    lower(regexp_replace(tok, '[.,]+$', '')) AS tname,
    'p' || (doc_id // 50) AS project,
    CASE lang WHEN 'en' THEN '.clj' WHEN 'fr' THEN '.cljs' WHEN 'de' THEN '.cljc' ELSE '' END AS ext
  FROM words
),
named AS (
  SELECT *, '/' || project || '/d' || doc_id || ext AS filename,
    first_value(tname) OVER w AS first_name,
    nth_value(tname, 2) OVER w AS second_name
  FROM placed
  WINDOW w AS (PARTITION BY doc_id, row ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
),
toks AS (SELECT * FROM named WHERE tok <> ''),
cursors AS (
  SELECT concat_ws(':', doc_id, row, i) AS cursor_id, project, filename, row AS begin_row,
    CAST(col + length(tname) // 2 AS INTEGER) AS begin_col
  FROM toks
)"""

_RECORDS = (
    _TOKENS
    + """,
tagged AS (
  SELECT * FROM (SELECT *, unnest([
    CASE WHEN row = 1 AND i = 1 THEN 'namespace_definition' END,
    CASE WHEN row = 1 AND i = 3 THEN 'namespace_usage' END,
    CASE WHEN row >= 2 AND i = 1 THEN 'var_definition' END,
    CASE WHEN i > 1 AND right(tok, 1) <> ',' AND lower(substr(tok, 1, 1)) = substr(tok, 1, 1)
      AND length(tname) < 12 THEN 'var_usage' END,
    CASE WHEN right(tok, 1) = ',' THEN 'keyword' END,
    CASE WHEN row >= 2 AND i = 2 THEN 'local' END,
    CASE WHEN row >= 2 AND i > 2 AND tname = second_name THEN 'local_usage' END,
    CASE WHEN i > 1 AND lower(substr(tok, 1, 1)) <> substr(tok, 1, 1) THEN 'java_class_usage' END,
    CASE WHEN length(tname) BETWEEN 12 AND 15 THEN 'symbol' END,
    CASE WHEN length(tname) >= 16 THEN 'finding' END
  ]) AS semantic
  FROM toks) WHERE semantic IS NOT NULL
),
flagged AS (
  SELECT *, 'n' || (doc_id // 5) AS own, 'n' || (doc_id // 5 + 1) AS following, length(tname) AS size,
    semantic IN ('namespace_definition', 'namespace_usage', 'var_definition', 'var_usage', 'local_usage', 'finding') AS by_name,
    semantic = 'namespace_usage' AS nu, semantic = 'var_usage' AS vu
  FROM tagged
),
rec AS (
  SELECT project, CASE WHEN doc_id % 10 < 7 THEN 'paths' ELSE 'classpath' END AS scope, true AS shown, semantic, ext,
    doc_id AS file_ord, CAST(row AS BIGINT) * 2147483648 + i AS pos, filename,
    CASE WHEN vu AND (doc_id + i) % 97 = 0 THEN NULL ELSE row END AS row, col, row AS end_row,
    CAST(CASE WHEN by_name THEN col + length(tok) ELSE col + size END AS INTEGER) AS end_col,
    CASE WHEN by_name THEN row END AS name_row, CASE WHEN by_name THEN col END AS name_col,
    CASE WHEN by_name THEN row END AS name_end_row,
    CAST(CASE WHEN by_name THEN col + size END AS INTEGER) AS name_end_col,
    CASE WHEN semantic = 'namespace_definition' THEN own
      WHEN semantic IN ('var_definition', 'var_usage', 'keyword', 'local', 'local_usage') THEN tname END AS name,
    CASE WHEN semantic = 'var_definition' THEN own WHEN semantic = 'keyword' AND size % 2 = 0 THEN lang END AS ns,
    CASE WHEN nu OR vu THEN own END AS from_ns,
    CASE WHEN nu THEN following WHEN vu AND i % 4 = 0 THEN following WHEN vu THEN own END AS to_ns,
    CASE WHEN vu AND row >= 2 THEN first_name END AS from_var,
    CASE WHEN nu THEN tname END AS alias,
    CASE WHEN semantic IN ('local', 'local_usage') THEN CAST(row AS BIGINT) END AS local_id,
    CASE WHEN semantic = 'java_class_usage' THEN tname END AS class_name,
    CASE WHEN semantic = 'java_class_usage' AND right(tok, 1) = '.' THEN 'm' END AS method_name,
    CASE WHEN semantic = 'symbol' THEN own || '/' || tname END AS symbol,
    CASE WHEN semantic = 'keyword' AND size % 5 = 0 THEN 'reg/def' END AS reg,
    CASE WHEN semantic = 'keyword' THEN i = 2 END AS keys_destructuring,
    CASE WHEN semantic = 'var_definition' THEN
      CASE WHEN coalesce(second_name, '') <> '' THEN '[' || second_name || ']' ELSE '' END END AS arglists,
    CASE WHEN semantic IN ('namespace_definition', 'var_definition') THEN line END AS doc,
    CASE WHEN semantic = 'finding' THEN
      CASE WHEN size = 16 THEN 'info' WHEN size < 20 THEN 'warning' ELSE 'error' END END AS level,
    CASE WHEN semantic = 'finding' THEN 'Token too long: ' || tname END AS message
  FROM flagged
),
v AS (SELECT * FROM rec WHERE semantic = 'finding' OR (row <> 0 AND col <> 0))"""
)

_HITS = (
    _RECORDS
    + """,
hits AS (
  SELECT project, filename, semantic, pos, coalesce(name_row, row) AS hrow, coalesce(name_col, col) AS sc,
    coalesce(name_end_col, end_col) AS ec,
    CASE semantic WHEN 'local' THEN 'local_binding' ELSE semantic END AS hit_type,
    CASE semantic WHEN 'local_usage' THEN 0 WHEN 'local' THEN 1 WHEN 'var_usage' THEN 2 WHEN 'var_definition' THEN 3
      WHEN 'keyword' THEN 4 WHEN 'namespace_usage' THEN 5 WHEN 'namespace_definition' THEN 7
      WHEN 'java_class_usage' THEN 8 WHEN 'symbol' THEN 9 END AS pri
  FROM v WHERE semantic <> 'finding'
),
best AS (
  SELECT cursor_id, any_value(c.begin_row) AS begin_row, any_value(c.begin_col) AS begin_col,
    arg_min({'filename': h.filename, 'semantic': h.semantic, 'pos': h.pos, 'hit_type': h.hit_type, 'sc': h.sc, 'ec': h.ec},
            CAST(h.pri AS HUGEINT) * 9223372036854775808 + h.pos) AS h
  FROM cursors c JOIN (SELECT *, unnest(range(sc // 32, ec // 32 + 1)) AS bucket FROM hits) h
    ON c.filename = h.filename AND c.begin_row = h.hrow AND c.begin_col // 32 = h.bucket
    AND h.sc <= c.begin_col AND h.ec >= c.begin_col
  GROUP BY cursor_id
),
asked AS (
  SELECT b.cursor_id, b.begin_row, b.begin_col, b.h.hit_type AS hit_type, b.h.sc AS sc, b.h.ec AS ec, r.*
  FROM best b JOIN rec r ON r.filename = b.h.filename AND r.semantic = b.h.semantic AND r.pos = b.h.pos
)"""
)


def _key(kind: str, *parts: str) -> str:
    return f"'{kind}'" + "".join(f" || chr(31) || coalesce({p}, chr(1))" for p in parts)


# Keys that usages and definitions are found under.
_ENTRIES = f""",
uent AS (
  SELECT *, {_key('keyword', 'ns', 'name')} AS key FROM v WHERE semantic = 'keyword' AND reg IS NULL
  UNION ALL SELECT *, {_key('local', 'filename', 'CAST(local_id AS VARCHAR)')} FROM v WHERE semantic = 'local_usage'
  UNION ALL SELECT *, {_key('var', 'to_ns', 'name')} FROM v WHERE semantic = 'var_usage'
  UNION ALL SELECT *, {_key('symbol', 'symbol')} FROM v WHERE semantic = 'symbol'
  UNION ALL SELECT *, {_key('java', 'class_name')} FROM v WHERE semantic = 'java_class_usage'
  UNION ALL SELECT *, {_key('java-method', 'class_name', 'method_name')} FROM v WHERE semantic = 'java_class_usage' AND method_name IS NOT NULL
  UNION ALL SELECT *, {_key('namespace', 'to_ns')} FROM v WHERE semantic = 'namespace_usage'
),
dent AS (
  SELECT *, {_key('keyword', 'ns', 'name')} AS key FROM v WHERE semantic = 'keyword' AND reg IS NOT NULL
  UNION ALL SELECT *, {_key('local', 'filename', 'CAST(local_id AS VARCHAR)')} FROM v WHERE semantic = 'local'
  UNION ALL SELECT *, {_key('var', 'ns', 'name')} FROM v WHERE semantic = 'var_definition'
  UNION ALL SELECT *, {_key('namespace', 'name')} FROM v WHERE semantic = 'namespace_definition'
)"""

_UTARGET = """
  CASE WHEN semantic = 'keyword' THEN 'keyword' WHEN semantic IN ('local', 'local_usage') THEN 'local'
    WHEN semantic IN ('var_definition', 'var_usage') THEN 'var' WHEN semantic = 'symbol' THEN 'symbol'
    WHEN semantic = 'java_class_usage' THEN 'java'
    WHEN semantic IN ('namespace_definition', 'namespace_usage') AND ext <> '' THEN 'namespace' END AS target_kind,
  CASE WHEN semantic = 'keyword' THEN ns WHEN semantic IN ('local', 'local_usage') THEN filename
    WHEN semantic IN ('var_definition', 'var_usage') THEN coalesce(ns, to_ns) WHEN semantic = 'symbol' THEN symbol
    WHEN semantic = 'java_class_usage' THEN class_name
    WHEN semantic IN ('namespace_definition', 'namespace_usage') THEN coalesce(name, to_ns) END AS t1,
  CASE WHEN semantic IN ('keyword', 'var_definition', 'var_usage') THEN name
    WHEN semantic IN ('local', 'local_usage') THEN CAST(local_id AS VARCHAR)
    WHEN semantic = 'java_class_usage' THEN method_name END AS t2"""

_DTARGET = """
  CASE semantic WHEN 'keyword' THEN 'keyword' WHEN 'local_usage' THEN 'local' WHEN 'var_usage' THEN 'var'
    WHEN 'symbol' THEN 'symbol' WHEN 'namespace_usage' THEN 'namespace' END AS target_kind,
  CASE semantic WHEN 'keyword' THEN ns WHEN 'local_usage' THEN filename WHEN 'var_usage' THEN to_ns
    WHEN 'symbol' THEN symbol WHEN 'namespace_usage' THEN to_ns END AS t1,
  CASE semantic WHEN 'keyword' THEN name WHEN 'var_usage' THEN name
    WHEN 'local_usage' THEN CAST(local_id AS VARCHAR) END AS t2"""

_UPROBES = f"""unnest(CASE target_kind
    WHEN 'var' THEN [{{'b': 0, 'k': {_key('var', 't1', 't2')}}}, {{'b': 1, 'k': {_key('symbol', "t1 || '/' || t2")}}}]
    WHEN 'symbol' THEN [{{'b': 0, 'k': {_key('symbol', 't1')}}},
      {{'b': 1, 'k': {_key('var', "split_part(t1, '/', 1)", "split_part(t1, '/', 2)")}}}]
    WHEN 'java' THEN [{{'b': 0, 'k': CASE WHEN t2 IS NULL THEN {_key('java', 't1')} ELSE {_key('java-method', 't1', 't2')} END}}]
    WHEN 'namespace' THEN [{{'b': 0, 'k': {_key('namespace', 't1')}}}]
    WHEN 'local' THEN [{{'b': 0, 'k': {_key('local', 't1', 't2')}}}]
    ELSE [{{'b': 0, 'k': {_key('keyword', 't1', 't2')}}}] END) AS p"""

_DPROBES = f"""unnest([{{'b': 0, 'k': CASE target_kind
    WHEN 'symbol' THEN {_key('var', "split_part(t1, '/', 1)", "split_part(t1, '/', 2)")}
    WHEN 'namespace' THEN {_key('namespace', 't1')}
    WHEN 'local' THEN {_key('local', 't1', 't2')}
    WHEN 'var' THEN {_key('var', 't1', 't2')}
    ELSE {_key('keyword', 't1', 't2')} END}}]) AS p"""

_SQL: dict[str, str] = {}


def all_sql() -> dict[str, str]:
    return dict(_SQL)


def _add(name: str, body: str, prefix: str = _RECORDS, ctes: str = "") -> None:
    _SQL[name] = f"WITH {prefix.strip()}{ctes}\n{body.strip()}"


def _lookup(name: str, asking: str, target: str, probes: str, entries: str, extra: str = "") -> None:
    """Targets of the ``asking`` records joined with what is found under their keys."""
    ctes = f"""{_ENTRIES},
targets AS (
  SELECT project, target_kind, t1, t2, count(*) AS n_asked FROM (SELECT *, {target} FROM v WHERE {asking})
  WHERE target_kind IS NOT NULL GROUP BY ALL
),
probed AS (SELECT *, {probes} FROM targets),
found AS (
  SELECT a.project, a.target_kind, a.t1, a.t2, a.n_asked, CAST(a.p.b AS INTEGER) AS branch, r.filename, r.semantic,
    r.row, r.col, r.pos, r.file_ord
  FROM probed a JOIN {entries} r ON a.project = r.project AND a.p.k = r.key
)"""
    columns = "project, target_kind, t1, t2, n_asked, branch, filename, semantic, row, col, pos"
    if extra == "first":
        body = f"""SELECT {columns}, row_number() OVER (PARTITION BY project, target_kind, t1, t2
          ORDER BY branch, file_ord, pos) = 1 AS is_first FROM found"""
    elif extra == "places":
        body = """
SELECT project, target_kind, t1, t2, n_asked, branch, filename, semantic, row, col,
  count(*) OVER (PARTITION BY project, target_kind, t1, t2) = 1 AS is_single
FROM (SELECT *, row_number() OVER (PARTITION BY project, target_kind, t1, t2, filename, row, col
        ORDER BY branch DESC, file_ord DESC, pos DESC) AS rn FROM found)
WHERE rn = 1"""
    else:
        body = f"SELECT {columns} FROM found"
    _add(name, body, ctes=ctes)


# -- scans, filters, key views -------------------------------------------------------

_add("usages_per_definition", """
SELECT d.project, d.ns, d.name, d.n_definitions, coalesce(u.n_usages, 0) AS n_usages, coalesce(u.n_files, 0) AS n_files
FROM (SELECT project, ns, name, count(*) AS n_definitions FROM v WHERE semantic = 'var_definition' GROUP BY ALL) d
LEFT JOIN (SELECT project, to_ns, name, count(*) AS n_usages, count(DISTINCT filename) AS n_files
  FROM v WHERE semantic = 'var_usage' GROUP BY ALL) u
  ON d.project = u.project AND d.ns = u.to_ns AND d.name = u.name""")

_add("records", """
SELECT project, scope, filename, semantic, file_ord, pos, row, col, end_row, end_col, name_row, name_end_col, name, ns,
  from_ns, to_ns, from_var, alias, local_id, class_name, method_name, symbol, reg, keys_destructuring, doc, level,
  message, arglists
FROM rec""")

_add("valid_records", """
SELECT project, semantic, count(*) AS n_all, count(row) AS n_with_row,
  count(*) FILTER (WHERE semantic = 'finding' OR (row <> 0 AND col <> 0)) AS n_valid
FROM rec GROUP BY ALL""")

_add("classpath_scope", """
SELECT project, filename, semantic, pos, name, ns, row, col FROM v
WHERE scope = 'classpath' AND semantic IN ('namespace_definition', 'var_definition', 'keyword')""")

_add("report_quarantine", """
SELECT project, scope, count(DISTINCT filename) FILTER (WHERE bad) AS n_quarantined,
  count(*) FILTER (WHERE NOT bad AND visible) AS n_records, count(DISTINCT filename) FILTER (WHERE NOT bad AND visible) AS n_files
FROM (SELECT *, file_ord % 7 IN (0, 1) AS bad,
    (scope = 'paths' AND semantic NOT IN ('local', 'local_usage', 'finding'))
      OR (scope = 'classpath' AND semantic IN ('namespace_definition', 'var_definition', 'keyword')) AS visible FROM rec)
GROUP BY project, scope HAVING n_quarantined > 0 OR n_records > 0""")

_add("report_scan", """
SELECT project, filename, semantic, count(*) AS n_records, CAST(sum(row) AS BIGINT) AS sum_row,
  CAST(sum(col) AS BIGINT) AS sum_col, count(name) AS n_named,
  CAST(sum(CASE WHEN arglists <> '' THEN 1 WHEN arglists = '' THEN 0 END) AS BIGINT) AS n_arglists
FROM rec GROUP BY ALL""")

_add("report_summaries", """
SELECT project, filename, CAST(count(*) FILTER (WHERE level = 'error') AS INTEGER) AS errors,
  CAST(count(*) FILTER (WHERE level = 'warning') AS INTEGER) AS warnings, true AS is_readable
FROM rec GROUP BY ALL""")

_add("hooks", """
SELECT project, semantic, count(*) AS n, count(name) AS n_named FROM rec GROUP BY ALL""")

_add("keyword_regs", """
SELECT project, filename, row, col, ns, name, reg FROM v WHERE semantic = 'keyword' AND coalesce(reg, '') <> ''""")

_add("recursive_usages", """
SELECT project, filename, row, col, from_ns, name FROM v
WHERE semantic = 'var_usage' AND from_ns IS NOT DISTINCT FROM to_ns AND name IS NOT DISTINCT FROM from_var""")

_SQL["project_files"] = """
SELECT 'p' || (doc_id // 50) AS project, '/p' || (doc_id // 50) || '/d' || doc_id ||
  CASE lang WHEN 'en' THEN '.clj' WHEN 'fr' THEN '.cljs' WHEN 'de' THEN '.cljc' ELSE '' END AS filename
FROM documents"""

_add("ns_row_keys", """
SELECT project, filename, name_row AS idx_row, to_ns, alias, pos FROM v WHERE semantic = 'namespace_usage'
UNION ALL
SELECT project, filename, name_row AS idx_row, to_ns, alias, pos FROM v WHERE semantic = 'namespace_usage' AND alias <> ''""")

_add("locals", """
SELECT project, filename, local_id, name, row, col FROM v WHERE semantic = 'local'
QUALIFY row_number() OVER (PARTITION BY project, filename, local_id ORDER BY file_ord DESC, pos DESC) = 1""")

_add("keyword_groups", """
SELECT project, ns, name, count(*) AS n, min(file_ord) AS first_file, count(reg) AS n_registering
FROM v WHERE semantic = 'keyword' GROUP BY ALL""")

_add("var_groups", """
SELECT project, coalesce(ns, to_ns) AS var_ns, name, count(*) FILTER (WHERE semantic = 'var_definition') AS n_definitions,
  count(*) FILTER (WHERE semantic = 'var_usage') AS n_usages, min(file_ord) AS first_file
FROM v WHERE semantic IN ('var_definition', 'var_usage') GROUP BY ALL""")

_add("symbol_groups", """
SELECT project, symbol, count(*) AS n, min(file_ord) AS first_file FROM v WHERE semantic = 'symbol' GROUP BY ALL""")

_add("java_groups", """
SELECT project, class_name, count(*) AS n, count(method_name) AS n_with_method
FROM v WHERE semantic = 'java_class_usage' GROUP BY ALL""")

_add("file_semantic_counts", "SELECT project, filename, semantic, count(*) AS n FROM rec GROUP BY ALL")

# -- scalars ---------------------------------------------------------------------------

_SQL["file_ext"] = """
WITH f AS (
  SELECT '/p' || (doc_id // 50) || '/d' || doc_id ||
    CASE lang WHEN 'en' THEN '.clj' WHEN 'fr' THEN '.cljs' WHEN 'de' THEN '.cljc' ELSE '' END AS filename FROM documents
), e AS (SELECT filename, regexp_extract(filename, '[^/.](\\.[^./]+)$', 1) AS ext FROM f)
SELECT filename, ext,
  CASE ext WHEN '.cljc' THEN '.clj .cljc .cljs' WHEN '' THEN '.clj' WHEN '.clj' THEN '.clj .cljc' ELSE '.cljc .cljs' END AS definition_exts,
  replace(ext, '.', '') AS language
FROM e"""

_add("symbol_parts", """
SELECT DISTINCT project, symbol,
  CASE WHEN contains(symbol, '/') THEN split_part(symbol, '/', 1) END AS sym_ns,
  CASE WHEN contains(symbol, '/') THEN split_part(symbol, '/', 2) ELSE symbol END AS sym_name
FROM v WHERE semantic = 'symbol'""")

_add("locations", """
SELECT semantic, pos, filename, coalesce(nullif(name_row, 0), row) AS line, coalesce(nullif(name_col, 0), col) AS "column"
FROM v""")

_QNAME = """CASE WHEN coalesce(name, '') <> '' THEN
    CASE WHEN semantic = 'keyword' THEN ':' ELSE '' END ||
    CASE WHEN coalesce(nullif(ns, ''), nullif(to_ns, '')) IS NOT NULL
      THEN coalesce(nullif(ns, ''), nullif(to_ns, '')) || '/' ELSE '' END || name
  ELSE coalesce(nullif(ns, ''), nullif(to_ns, '')) END"""

_add("qualified_names", f"""
SELECT project, filename, semantic, {_QNAME} AS qualified_name, count(*) AS n_carets FROM asked GROUP BY ALL""",
     prefix=_HITS)

_add("labels", """
SELECT project, filename, semantic, pos,
  CASE WHEN semantic = 'keyword' THEN 'keyword' WHEN semantic = 'local_usage' THEN 'variable'
    WHEN semantic = 'var_definition' AND arglists <> '' THEN 'function'
    WHEN semantic IN ('var_definition', 'var_usage') THEN 'variable'
    WHEN semantic IN ('namespace_definition', 'namespace_usage') THEN 'namespace' ELSE 'ambiguous' END AS kind,
  CASE semantic
    WHEN 'namespace_definition' THEN name || ':' || row || ':' || col
    WHEN 'namespace_usage' THEN from_ns || ':' || row || ':' || col
    WHEN 'var_definition' THEN ns || '/' || name || ':' || row || ':' || col
    WHEN 'var_usage' THEN from_ns || CASE WHEN coalesce(from_var, '') <> '' THEN '/' || from_var ELSE '' END || ':' || row || ':' || col
    WHEN 'local_usage' THEN row || ':' || col
    WHEN 'keyword' THEN ':' || CASE WHEN ns <> '' THEN ns || '/' ELSE '' END || name || ':' || row || ':' || col
    WHEN 'symbol' THEN symbol || ':' || row || ':' || col
    WHEN 'finding' THEN message END AS "trigger",
  CASE WHEN semantic = 'finding' THEN '' ELSE filename END AS details,
  CASE semantic WHEN 'var_definition' THEN arglists WHEN 'keyword' THEN coalesce(reg, '')
    WHEN 'finding' THEN 'long-token' ELSE '' END AS annotation
FROM v WHERE semantic NOT IN ('local', 'java_class_usage')""")

# Columns that rec leaves to the rules of one kind.
_SHOWN = {
    "arglist_strs": "arglists",
    "alias_row": "CASE WHEN semantic = 'namespace_usage' THEN end_row END",
    "alias_col": "CASE WHEN semantic = 'namespace_usage' THEN col END",
    "alias_end_row": "CASE WHEN semantic = 'namespace_usage' THEN end_row END",
    "alias_end_col": "CASE WHEN semantic = 'namespace_usage' THEN name_end_col END",
    "type": "CASE WHEN semantic = 'finding' THEN 'long-token' END",
}
_SHOWN |= {c: c for c in (
    "filename row col end_row end_col name_row name_col name_end_row name_end_col name ns from_ns to_ns from_var alias "
    "local_id class_name method_name symbol reg keys_destructuring doc level message"
).split()}
_add("inspect", f"""
SELECT k, v, count(*) AS n FROM (
  SELECT unnest([{", ".join(f"{{'k': '{k}', 'v': CAST({v} AS VARCHAR)}}" for k, v in _SHOWN.items())}], recursive := true)
  FROM rec)
WHERE v IS NOT NULL GROUP BY ALL""")

_SQL["inspect_events"] = """
SELECT event_id AS change_count, 'k' AS key, json_extract_string(props, '$.k') AS value FROM events"""

# -- lookups ---------------------------------------------------------------------------

_KEYWORD = "semantic = 'keyword'"
_lookup("keyword_occurrences", _KEYWORD, _UTARGET, _UPROBES,
        f"(SELECT *, {_key('keyword', 'ns', 'name')} AS key FROM v WHERE semantic = 'keyword')")
_lookup("keyword_usages", _KEYWORD, _UTARGET, _UPROBES, "uent")
_lookup("keyword_definitions", _KEYWORD, _DTARGET, _DPROBES, "dent", "first")
_lookup("local_usages", "semantic IN ('local', 'local_usage')", _UTARGET, _UPROBES, "uent")
_lookup("var_definitions", "semantic IN ('var_definition', 'var_usage')", _UTARGET,
        _DPROBES, "dent")
_lookup("var_usages", "semantic IN ('var_definition', 'var_usage')", _UTARGET, _UPROBES, "uent")
_lookup("symbol_definitions", "semantic = 'symbol'", _DTARGET, _DPROBES, "dent", "first")
_lookup("symbol_usages", "semantic = 'symbol'", _UTARGET, _UPROBES, "uent")
_lookup("java_usages", "semantic = 'java_class_usage'", _UTARGET, _UPROBES, "uent")
_lookup("ns_definitions", "semantic IN ('namespace_definition', 'namespace_usage')",
        "'namespace' AS target_kind, coalesce(name, to_ns) AS t1, CAST(NULL AS VARCHAR) AS t2", _DPROBES, "dent")
_lookup("ns_usages", "semantic IN ('namespace_definition', 'namespace_usage')", _UTARGET, _UPROBES, "uent")
_lookup("usages", "true", _UTARGET, _UPROBES, "uent", "places")
_lookup("definitions", "true", _DTARGET, _DPROBES, "dent", "places")

# In one pass: the last binding of each local, if any, next to every row of it.
_add("local_bindings", """
SELECT filename, local_id, row, col, binding_row, binding_col
FROM (SELECT semantic, filename, local_id, row, col,
    arg_max(row, pos) FILTER (WHERE semantic = 'local') OVER same AS binding_row,
    arg_max(col, pos) FILTER (WHERE semantic = 'local') OVER same AS binding_col
  FROM v WHERE semantic IN ('local', 'local_usage') WINDOW same AS (PARTITION BY filename, local_id))
WHERE semantic = 'local_usage'""")

# Extensions that fit: the asker's, with .cljc standing for all and none for .clj.
_FITS = """list_contains(CASE q.ext WHEN '.cljc' THEN ['.clj', '.cljs', '.cljc'] WHEN '' THEN ['.clj']
    ELSE [q.ext, '.cljc'] END, CASE d.ext WHEN '' THEN '.clj' ELSE d.ext END)"""

_add("var_definition_first", f"""
SELECT q.filename, q.semantic, q.pos, arg_min(d.filename, CAST(d.file_ord AS HUGEINT) * 9223372036854775808 + d.pos) AS def_filename,
  arg_min(d.pos, CAST(d.file_ord AS HUGEINT) * 9223372036854775808 + d.pos) AS def_pos
FROM (SELECT * FROM v WHERE semantic IN ('var_definition', 'var_usage')) q
LEFT JOIN (SELECT * FROM v WHERE semantic = 'var_definition') d
  ON q.project = d.project AND coalesce(q.ns, q.to_ns) = d.ns AND q.name = d.name AND {_FITS}
GROUP BY q.filename, q.semantic, q.pos""")

_add("ns_definition_first", f"""
SELECT q.filename, q.semantic, q.pos, arg_min(d.filename, CAST(d.file_ord AS HUGEINT) * 9223372036854775808 + d.pos) AS def_filename
FROM (SELECT * FROM v WHERE semantic IN ('namespace_definition', 'namespace_usage')) q
LEFT JOIN (SELECT * FROM v WHERE semantic = 'namespace_definition') d
  ON q.project = d.project AND coalesce(q.name, q.to_ns) = d.name AND {_FITS}
GROUP BY q.filename, q.semantic, q.pos""")

_add("ns_var_usages", """
SELECT a.project, a.to_ns, a.n_asked, r.name, r.filename, r.row, r.col,
  first_value(r.file_ord) OVER w AS group_file, first_value(r.pos) OVER w AS group_pos
FROM (SELECT project, coalesce(name, to_ns) AS to_ns, count(*) AS n_asked FROM v
  WHERE semantic IN ('namespace_definition', 'namespace_usage') GROUP BY ALL) a
JOIN v r ON r.semantic = 'var_usage' AND a.project = r.project AND a.to_ns = r.to_ns
WINDOW w AS (PARTITION BY a.project, a.to_ns, r.name ORDER BY r.file_ord, r.pos)""")

_EDGES = """SELECT project, from_ns, from_var, to_ns, name, count(*) AS n_calls FROM v WHERE semantic = 'var_usage' GROUP BY ALL"""
_add("call_edges", _EDGES)
_add("call_degrees", """
SELECT project, ns, name, CAST(sum(o) AS BIGINT) AS n_callees, CAST(sum(i) AS BIGINT) AS n_callers,
  CAST(sum(i * n_calls) AS BIGINT) AS n_called
FROM (SELECT project, from_ns AS ns, from_var AS name, 1 AS o, 0 AS i, n_calls FROM e
  UNION ALL SELECT project, to_ns, name, 0, 1, n_calls FROM e)
GROUP BY ALL""", ctes=f", e AS ({_EDGES})")

# -- positions -------------------------------------------------------------------------

# An alias lies where the name lies, so the name, tried first, hides it.
_add("at_position", """
SELECT cursor_id, hit_type, semantic, pos, sc AS hit_start_col, ec AS hit_end_col FROM asked""", prefix=_HITS)

_BOUND = """
bound AS (
  SELECT k.project, k.filename, k.pos AS keyword_pos, k.name AS keyword_name, l.local_id, l.pos AS local_pos,
    l.col AS lsc, l.end_col AS lec, k.row AS krow, k.col AS kcol
  FROM v k JOIN v l ON k.semantic = 'keyword' AND k.keys_destructuring AND l.semantic = 'local'
    AND k.filename = l.filename AND k.row = l.row AND l.col <= k.col AND l.end_col >= k.end_col
  QUALIFY row_number() OVER (PARTITION BY k.filename, k.pos ORDER BY l.pos) = 1
)"""
_add("destructured_locals", """
SELECT project, filename, keyword_pos, keyword_name, local_id, local_pos FROM bound""", ctes="," + _BOUND)

_add("require_sites", """
SELECT a.cursor_id, s.semantic AS site_kind, coalesce(s.name_row, s.row) AS line, coalesce(s.name_col, s.col) AS "column"
FROM asked a JOIN (SELECT * FROM v WHERE semantic = 'namespace_usage'
  QUALIFY row_number() OVER (PARTITION BY filename, to_ns ORDER BY pos) = 1) s
  ON a.filename = s.filename AND a.to_ns = s.to_ns
UNION ALL
SELECT a.cursor_id, s.semantic, s.row, s.col
FROM asked a JOIN (SELECT * FROM v WHERE semantic = 'java_class_usage'
  QUALIFY row_number() OVER (PARTITION BY filename, class_name ORDER BY pos) = 1) s
  ON a.filename = s.filename AND a.class_name = s.class_name
WHERE a.to_ns IS NULL""", prefix=_HITS)

# -- scopes ----------------------------------------------------------------------------

_SCOPE_VIEW = {
    "view": "e.shown",
    "paths": "e.scope = 'paths' AND e.semantic NOT IN ('local', 'local_usage', 'finding')",
    "classpath": "e.scope = 'classpath' AND e.semantic IN ('namespace_definition', 'var_definition', 'keyword')",
}


def _scopes(
    name: str, answers_name: str | None, target: str, probes: str, entries: str, order: list[str], prefix: str = _HITS
) -> None:
    counts = ", ".join(f"coalesce(sum(n_{s}), 0) AS n_{s}" for s in order)
    joins, columns = "", ""
    for s in order:
        unit = "project, filename" if s == "view" else "project"
        same = " AND b.filename = c_view.filename" if s == "view" else ""
        joins += f"""
  LEFT JOIN (SELECT {unit}, key, count(*) AS n_{s} FROM {entries} e WHERE {_SCOPE_VIEW[s]} GROUP BY ALL) c_{s}
    ON b.project = c_{s}.project AND b.p.k = c_{s}.key{same}"""
        columns += f", c_{s}.n_{s}"
    winner = "CASE " + " ".join(f"WHEN n_{s} > 0 THEN '{s}'" for s in order) + " END"
    ctes = f"""{_ENTRIES},
asks AS (
  SELECT project, filename, target_kind, t1, t2, count(*) AS n_asked FROM (SELECT *, {target} FROM asked)
  WHERE target_kind IS NOT NULL GROUP BY ALL
),
probed AS (SELECT *, {probes} FROM asks),
counted AS (
  SELECT b.project, b.filename, b.target_kind, b.t1, b.t2, b.n_asked{columns} FROM probed b {joins}
),
ranked AS (
  SELECT *, {winner} AS answer_scope FROM (
    SELECT project, filename, target_kind, t1, t2, n_asked, {counts} FROM counted
    GROUP BY project, filename, target_kind, t1, t2, n_asked)
)"""
    ns = ", ".join(f"CAST(n_{s} AS BIGINT) AS n_{s}" for s in order)
    _add(name, f"SELECT project, filename, target_kind, t1, t2, n_asked, {ns}, answer_scope FROM ranked",
         prefix=prefix, ctes=ctes)
    parts = []
    for s in order:
        file_, same = ("w.filename", " AND w.filename = e.filename") if s == "view" else ("CAST(NULL AS VARCHAR)", "")
        parts.append(f"""
  SELECT '{s}' AS answer_scope, w.project, w.file_ AS asking_file, w.target_kind, w.t1, w.t2, w.n_asked, w.p.b AS b,
    e.filename, e.row, e.col, e.semantic, e.file_ord, e.pos
  FROM (SELECT *, {probes} FROM (
      SELECT project, {file_} AS file_, target_kind, t1, t2, sum(n_asked) AS n_asked
      FROM ranked w WHERE answer_scope = '{s}' GROUP BY ALL)) w
  JOIN {entries} e ON w.project = e.project AND w.p.k = e.key{same.replace('w.filename', 'w.file_')} AND {_SCOPE_VIEW[s]}""")
    ctes += f""",
answers AS (SELECT * FROM ({' UNION ALL '.join(parts)})
  QUALIFY row_number() OVER (PARTITION BY answer_scope, project, asking_file, target_kind, t1, t2, filename, row, col
    ORDER BY b DESC, file_ord DESC, pos DESC) = 1)"""
    if answers_name:
        _add(answers_name, """
SELECT answer_scope, project, asking_file, target_kind, t1, t2, CAST(n_asked AS BIGINT) AS n_asked, filename, row, col,
  semantic FROM answers""", prefix=prefix, ctes=ctes)
    if answers_name == "usage_answers":
        _add("usage_report", """
SELECT project, shown_name, 0 AS part, CAST(NULL AS VARCHAR) AS filename, CAST(NULL AS INTEGER) AS row,
  CAST(NULL AS INTEGER) AS col, 'Find Usages: ' || shown_name AS line FROM lastask
UNION ALL
SELECT l.project, l.shown_name, 1, w.filename, w.row, w.col,
  CASE WHEN w.filename IS NULL THEN 'Not found.' ELSE '- ' || w.filename || ':' || w.line || ':' || w.col_ END
FROM lastask l
LEFT JOIN ranked k ON l.project = k.project AND l.filename = k.filename
  AND l.target_kind IS NOT DISTINCT FROM k.target_kind AND l.t1 IS NOT DISTINCT FROM k.t1 AND l.t2 IS NOT DISTINCT FROM k.t2
LEFT JOIN (SELECT a.*, coalesce(r.name_row, r.row) AS line, coalesce(r.name_col, r.col) AS col_ FROM answers a
    JOIN v r ON a.filename = r.filename AND a.semantic = r.semantic AND a.pos = r.pos) w
  ON w.project = k.project AND w.answer_scope = k.answer_scope
  AND (w.asking_file IS NULL OR w.asking_file = k.filename)
  AND k.target_kind IS NOT DISTINCT FROM w.target_kind AND k.t1 IS NOT DISTINCT FROM w.t1 AND k.t2 IS NOT DISTINCT FROM w.t2""",
             prefix=prefix, ctes=ctes + f""",
lastask AS (
  SELECT project, filename, shown_name, target_kind, t1, t2 FROM (
    SELECT *, {_QNAME} AS shown_name, {target} FROM asked)
  WHERE shown_name IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY project, shown_name ORDER BY file_ord DESC, begin_row DESC, begin_col DESC) = 1
)""")


_scopes("definitions_by_scope", "definition_answers", _DTARGET, _DPROBES, "dent", ["view", "paths", "classpath"])
_scopes("usages_by_scope", "usage_answers", _UTARGET, _UPROBES, "uent", ["paths", "view"])
_scopes("usages_in_view", None, _UTARGET, _UPROBES, "uent", ["view"])


def _opened(sql: str) -> str:
    """The same over saved files and open views: each line of a document is read for both."""
    sql = sql.strip()
    for old, new in [
        ("SELECT doc_id, lang, CAST(u.row AS INTEGER) AS row, u.line\n  FROM documents,",
         "SELECT doc_id, lang, is_open, CAST(u.row AS INTEGER) AS row, u.line\n  FROM texts,"),
        ("SELECT doc_id, lang, row, line,", "SELECT doc_id, lang, is_open, row, line,"),
        ("PARTITION BY doc_id, row", "PARTITION BY doc_id, is_open, row"),
        ("  FROM toks\n)", "  FROM toks WHERE is_open OR doc_id % 10 <> 0\n)"),
        ("CASE WHEN doc_id % 10 < 7 THEN 'paths' ELSE 'classpath' END AS scope, true AS shown",
         "CASE WHEN is_open THEN 'view' WHEN doc_id % 10 < 7 THEN 'paths' ELSE 'classpath' END AS scope,\n"
         "    is_open OR doc_id % 10 <> 0 AS shown"),
        ("\nrec AS (", "\nallrec AS ("),
        ("v AS (SELECT * FROM rec WHERE",
         "rec AS (SELECT * FROM allrec WHERE NOT (scope = 'paths' AND CAST(substr(project, 2) AS BIGINT) % 5 = 4)\n"
         "  UNION ALL SELECT * REPLACE ('java_class_definition' AS semantic) FROM allrec\n"
         "  WHERE scope = 'classpath' AND semantic = 'java_class_usage' AND col < 12),\nv AS (SELECT * FROM rec WHERE"),
        ("FROM v WHERE semantic <> 'finding'\n)", "FROM v WHERE shown AND semantic NOT IN ('finding', 'java_class_definition')\n)"),
        ("AND r.pos = b.h.pos\n)", "AND r.pos = b.h.pos AND r.shown\n)"),
    ]:
        assert old in sql or "hits" not in sql, old
        sql = sql.replace(old, new)
    return """texts AS (
  SELECT doc_id, lang, text, false AS is_open FROM documents
  UNION ALL SELECT doc_id, lang, 'Draft notes of changes.' || chr(10) || text, true FROM documents WHERE doc_id % 10 = 0
),
""" + sql


_OPEN_RECORDS, _OPEN_HITS = _opened(_RECORDS), _opened(_HITS)
_scopes("open_definitions_by_scope", "open_definition_answers", _DTARGET, _DPROBES, "dent", ["view", "paths", "classpath"],
        prefix=_OPEN_HITS)
_scopes("open_usages_by_scope", "open_usage_answers", _UTARGET, _UPROBES, "uent", ["paths", "view"], prefix=_OPEN_HITS)

_add("open_records", """
SELECT project, filename, scope, shown, count(*) AS n, CAST(sum(pos) AS BIGINT) AS sum_pos FROM rec GROUP BY ALL""",
     prefix=_OPEN_RECORDS)

_add("open_at_position", """
SELECT cursor_id, hit_type, semantic, pos, sc AS hit_start_col, ec AS hit_end_col FROM asked""", prefix=_OPEN_HITS)

_add("open_view_report", """
SELECT project, filename, run_seq, count(*) AS n, CAST(sum(pos) AS BIGINT) AS sum_pos
FROM (SELECT *, unnest(CASE WHEN pos < 6442450944 THEN [1, 2] ELSE [1] END)::bigint AS run_seq FROM rec WHERE scope = 'view')
WHERE run_seq = CASE WHEN file_ord % 30 = 0 THEN 2 ELSE 1 END GROUP BY ALL""", prefix=_OPEN_RECORDS)

_add("java_definitions", """
SELECT project, class_name, count(*) FILTER (WHERE asks) AS n_asked,
  arg_max(filename, CAST(file_ord AS HUGEINT) * 9223372036854775808 + pos) FILTER (WHERE defines) AS def_filename,
  arg_max(pos, CAST(file_ord AS HUGEINT) * 9223372036854775808 + pos) FILTER (WHERE defines) AS def_pos
FROM (SELECT *, shown AS asks, semantic = 'java_class_definition' AND scope = 'classpath' AS defines FROM v
  WHERE semantic IN ('java_class_usage', 'java_class_definition'))
GROUP BY ALL HAVING n_asked > 0""", prefix=_OPEN_RECORDS)

for _name, _prefix in (("doc_cards", _HITS), ("open_doc_cards", _OPEN_HITS)):
    _add(_name, f"""
SELECT project, filename, ext, any_ext, n_asked, scope_name AS answer_scope,
  CASE WHEN coalesce(d_ns, '') <> '' THEN d_ns || '/' || d_name ELSE d_name END AS qualified_name,
  d_filename AS def_filename, line, col_ AS "column", arglists, trim(doc, ' ') AS doc
FROM (
  SELECT q.project, q.filename, q.ext, q.any_ext, q.n_asked, s.scope_name, d.ns AS d_ns, d.name AS d_name,
    d.filename AS d_filename, d.name_row AS line, d.name_col AS col_, coalesce(d.arglists, '') AS arglists, d.doc,
    row_number() OVER (PARTITION BY q.filename, q.key, q.ext, q.any_ext ORDER BY s.rank, d.file_ord, d.pos) AS rn
  FROM (
    SELECT project, filename, ext, semantic = 'symbol' AS any_ext, count(*) AS n_asked,
      CASE WHEN semantic IN ('namespace_definition', 'namespace_usage') THEN {_key('namespace', 'coalesce(name, to_ns)')}
        WHEN semantic = 'symbol' THEN {_key('var', "split_part(symbol, '/', 1)", "split_part(symbol, '/', 2)")}
        ELSE {_key('var', 'coalesce(ns, to_ns)', 'name')} END AS key
    FROM asked WHERE semantic IN ('var_definition', 'var_usage', 'namespace_definition', 'namespace_usage', 'symbol')
    GROUP BY ALL) q
  JOIN (SELECT * FROM dent WHERE semantic IN ('var_definition', 'namespace_definition')) d
    ON q.project = d.project AND q.key = d.key AND (q.any_ext OR {_FITS})
  JOIN (VALUES ('view', 1), ('classpath', 2), ('paths', 3)) s(scope_name, rank)
    ON CASE s.scope_name WHEN 'view' THEN q.filename = d.filename AND d.shown ELSE d.scope = s.scope_name END
) WHERE rn = 1""", prefix=_prefix, ctes=_ENTRIES)

# -- lists -----------------------------------------------------------------------------

_LISTED = """(semantic IN ('namespace_definition', 'var_definition') OR (semantic = 'keyword' AND reg <> ''))"""
_KIND_ORD = "CASE semantic WHEN 'namespace_definition' THEN 0 WHEN 'var_definition' THEN 1 ELSE 2 END"


def _last_per_place(source: str, group: str, order: str) -> str:
    return f"""(SELECT * FROM ({source})
  QUALIFY row_number() OVER (PARTITION BY {group}, filename, row, col ORDER BY {order}) = 1)"""


_add("outline", f"""
SELECT project, filename, row, col, semantic,
  CASE WHEN semantic = 'keyword' THEN ':' || CASE WHEN ns <> '' THEN ns || '/' ELSE '' END || name ELSE name END AS "trigger",
  CASE semantic WHEN 'keyword' THEN reg WHEN 'var_definition' THEN arglists ELSE '' END AS annotation
FROM {_last_per_place(f"SELECT * FROM v WHERE {_LISTED}", "project", f"{_KIND_ORD} DESC, pos DESC")}""")

_add("deduped", """
SELECT project, filename, row, col, max(semantic) AS semantic, count(*) AS n_same_place, min(semantic) AS first_semantic
FROM v GROUP BY ALL""")


def _catalog(scope: str, kinds: str) -> str:
    return _last_per_place(
        f"SELECT * FROM v WHERE scope = '{scope}' AND {_LISTED} AND semantic IN ({kinds})",
        "project", f"{_KIND_ORD} DESC, file_ord DESC, pos DESC",
    )


_ALL_KINDS = "'namespace_definition', 'var_definition', 'keyword'"
_add("catalog", " UNION ALL ".join(
    f"SELECT '{name}' AS list, project, {_QNAME} AS qualified_name, filename, row, col, semantic FROM {_catalog(scope, kinds)}"
    for name, scope, kinds in [
        ("anything-classpath", "classpath", _ALL_KINDS),
        ("keyword-classpath", "classpath", "'keyword'"),
        ("namespace-classpath", "classpath", "'namespace_definition'"),
        ("namespace-paths", "paths", "'namespace_definition'"),
    ]))

for _name, _kinds, _semantic, _views, _prefix in [
    ("catalog_view_paths", _ALL_KINDS, ", semantic", "shown", _RECORDS), ("keyword_view_paths", "'keyword'", "", "shown", _RECORDS),
    ("open_catalog", _ALL_KINDS, ", semantic", "scope = 'view'", _OPEN_RECORDS),
]:
    _add(_name, f"""
SELECT project, from_scope, {_QNAME} AS qualified_name, filename, row, col{_semantic}
FROM (SELECT * FROM (
  SELECT *, 'paths' AS from_scope FROM v WHERE scope = 'paths' AND semantic NOT IN ('local', 'local_usage', 'finding')
  UNION ALL
  SELECT *, 'view' FROM v WHERE {_views} AND project NOT IN (SELECT project FROM rec WHERE scope = 'paths')
  ) WHERE {_LISTED} AND semantic IN ({_kinds})
  QUALIFY row_number() OVER (PARTITION BY project, filename, row, col
    ORDER BY {_KIND_ORD} DESC, file_ord DESC, pos DESC) = 1)""", prefix=_prefix)

_add("ns_usages_in_view", """
SELECT project, filename, to_ns, row, col, name, n_asked
FROM (SELECT *, count(*) FILTER (WHERE is_caret) OVER (PARTITION BY filename, to_ns) AS n_asked FROM (
  SELECT project, filename, to_ns, row, col, name, false AS is_caret FROM v WHERE semantic = 'var_usage'
  UNION ALL
  SELECT project, filename, to_ns, NULL, NULL, NULL, true FROM asked WHERE semantic IN ('var_usage', 'namespace_usage')))
WHERE NOT is_caret AND n_asked > 0""", prefix=_HITS)

_add("findings_sorted", """
SELECT project, filename, row, col, level, message AS "trigger", 'long-token' AS annotation FROM v WHERE semantic = 'finding'""")

_add("finding_regions", """
SELECT project, filename, level, message, pos, row AS start_row, col AS start_col, end_row, end_col
FROM v WHERE semantic = 'finding' AND level IN ('error', 'warning')""")

_add("finding_summary", """
SELECT project, filename, errors, warnings,
  concat_ws(', ', CASE WHEN errors > 0 THEN 'Errors: ' || errors END, CASE WHEN warnings > 0 THEN 'Warnings: ' || warnings END) AS status
FROM (SELECT project, filename, count(*) FILTER (WHERE level = 'error') AS errors,
  count(*) FILTER (WHERE level = 'warning') AS warnings FROM rec GROUP BY ALL)""")

_add("findings_by_severity", """
SELECT project, filename, count(*) FILTER (WHERE level = 'error') AS error, count(*) FILTER (WHERE level = 'warning') AS warning
FROM v WHERE semantic = 'finding' AND level IN ('error', 'warning') GROUP BY ALL""")

_add("next_prev", f"""
SELECT filename, semantic, pos, next_row, next_col, prev_row, prev_col FROM steps
WHERE NOT (semantic = 'keyword' AND EXISTS (
  SELECT 1 FROM v k WHERE k.semantic = 'keyword' AND k.keys_destructuring AND k.filename = steps.filename AND k.pos = steps.pos))
UNION ALL
SELECT b.filename, 'keyword', b.keyword_pos, s.next_row, s.next_col, s.prev_row, s.prev_col
FROM bound b JOIN steps s ON s.semantic = 'local' AND s.filename = b.filename AND s.pos = b.local_pos""",
     ctes=f""",{_BOUND},
members AS (
  SELECT filename, semantic, pos, coalesce(name_row, row) AS r, coalesce(name_col, col) AS c, key, b FROM (
    SELECT *, {_key('var', 'ns', 'name')} AS key, 0 AS b FROM v WHERE semantic = 'var_definition'
    UNION ALL SELECT *, {_key('local', 'filename', 'CAST(local_id AS VARCHAR)')}, 0 FROM v WHERE semantic = 'local'
    UNION ALL SELECT *, {_key('keyword', 'ns', 'name')}, 1 FROM v WHERE semantic = 'keyword'
    UNION ALL SELECT *, {_key('var', 'to_ns', 'name')}, 1 FROM v WHERE semantic = 'var_usage'
    UNION ALL SELECT *, {_key('local', 'filename', 'CAST(local_id AS VARCHAR)')}, 1 FROM v WHERE semantic = 'local_usage'
    UNION ALL SELECT *, {_key('var', "split_part(symbol, '/', 1)", "split_part(symbol, '/', 2)")}, 2 FROM v WHERE semantic = 'symbol'
    UNION ALL SELECT *, {_key('java', 'class_name')}, CASE WHEN method_name IS NULL THEN 1 ELSE 3 END FROM v WHERE semantic = 'java_class_usage'
    UNION ALL SELECT *, {_key('java-method', 'class_name', 'method_name')}, 1 FROM v WHERE semantic = 'java_class_usage' AND method_name IS NOT NULL)
),
uses AS (
  SELECT *, lead(r) OVER w AS nr, lead(c) OVER w AS nc, lag(r) OVER w AS lr, lag(c) OVER w AS lc, row_number() OVER w AS rn
  FROM members WHERE b > 0
  WINDOW w AS (PARTITION BY filename, key ORDER BY CASE b WHEN 3 THEN 1 ELSE b END, pos)
),
homes AS (
  SELECT filename, key, CASE WHEN starts_with(key, 'local') THEN arg_max(r, pos) ELSE arg_min(r, pos) END AS hr,
    CASE WHEN starts_with(key, 'local') THEN arg_max(c, pos) ELSE arg_min(c, pos) END AS hc
  FROM members WHERE b = 0 GROUP BY filename, key
),
steps AS (
  SELECT u.filename, u.semantic, u.pos, u.nr AS next_row, u.nc AS next_col,
    CASE WHEN u.rn = 1 THEN h.hr ELSE u.lr END AS prev_row, CASE WHEN u.rn = 1 THEN h.hc ELSE u.lc END AS prev_col
  FROM uses u LEFT JOIN homes h ON u.filename = h.filename AND u.key = h.key WHERE u.b = 1
  UNION ALL
  SELECT d.filename, d.semantic, d.pos, u.r, u.c, CAST(NULL AS INTEGER), CAST(NULL AS INTEGER)
  FROM members d LEFT JOIN uses u ON u.filename = d.filename AND u.key = d.key AND u.rn = 1 WHERE d.b = 0
)""")

_add("namespace_jump", """
SELECT project, filename, to_ns, row, col, pos, next_row, next_col
FROM (SELECT semantic, project, filename, to_ns, row, col, pos,
    arg_min(name_row, pos) FILTER (WHERE semantic = 'var_usage') OVER same AS next_row,
    arg_min(name_col, pos) FILTER (WHERE semantic = 'var_usage') OVER same AS next_col
  FROM v WHERE semantic IN ('namespace_usage', 'var_usage') WINDOW same AS (PARTITION BY filename, to_ns))
WHERE semantic = 'namespace_usage' AND next_row IS NOT NULL""")

# -- regions and rename ------------------------------------------------------------------

_STARTS = """,
starts AS (
  SELECT '/p' || (doc_id // 50) || '/d' || doc_id ||
      CASE lang WHEN 'en' THEN '.clj' WHEN 'fr' THEN '.cljs' WHEN 'de' THEN '.cljc' ELSE '' END AS filename, row,
    coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at,
    line
  FROM lines
)"""
_SPAN = """SELECT r.filename, r.semantic, r.pos, r.project, coalesce(r.name_row, r.row) AS rrow, coalesce(r.name_col, r.col) AS sc,
  coalesce(r.name_end_col, r.end_col) AS ec FROM v r"""

_add("regions", f"""
SELECT r.filename, r.semantic, r.pos, CAST(s.at + r.sc - 1 AS INTEGER) AS a, CAST(s.at + r.ec - 1 AS INTEGER) AS b
FROM ({_SPAN}) r JOIN starts s ON r.filename = s.filename AND r.rrow = s.row""", ctes=_STARTS)

_add("region_text", f"""
SELECT r.filename, r.semantic, substr(s.line, r.sc, r.ec - r.sc) AS region_text, count(*) AS n
FROM ({_SPAN}) r JOIN starts s ON r.filename = s.filename AND r.rrow = s.row GROUP BY ALL""", ctes=_STARTS)

# All regions of the thing under a caret: (cursor_id, filename, row, sc, ec), duplicates kept.
_THING = f""",{_BOUND},
spans AS (SELECT *, coalesce(name_row, row) AS rrow, coalesce(name_col, col) AS rsc, coalesce(name_end_col, end_col) AS rec FROM v),
lastlocal AS (SELECT * FROM spans WHERE semantic = 'local'
  QUALIFY row_number() OVER (PARTITION BY filename, local_id ORDER BY pos DESC) = 1),
thing AS (
  SELECT a.cursor_id, a.filename, s.rrow, s.rsc, s.rec FROM asked a JOIN spans s
    ON a.hit_type = 'keyword' AND NOT a.keys_destructuring AND s.semantic = 'keyword' AND a.filename = s.filename
    AND a.ns IS NOT DISTINCT FROM s.ns AND a.name = s.name
  UNION ALL SELECT a.cursor_id, a.filename, a.begin_row, b.lsc, b.lec FROM asked a JOIN bound b
    ON a.hit_type = 'keyword' AND a.keys_destructuring AND a.filename = b.filename AND a.pos = b.keyword_pos
  UNION ALL SELECT a.cursor_id, a.filename, s.rrow, s.rsc, s.rec FROM asked a
    JOIN bound b ON a.hit_type = 'keyword' AND a.keys_destructuring AND a.filename = b.filename AND a.pos = b.keyword_pos
    JOIN spans s ON s.semantic = 'local_usage' AND s.filename = a.filename AND s.local_id = b.local_id
  UNION ALL SELECT cursor_id, filename, begin_row, sc, ec FROM asked
    WHERE hit_type IN ('symbol', 'local_binding', 'var_definition', 'namespace_definition', 'namespace_usage')
  UNION ALL SELECT a.cursor_id, a.filename, l.rrow, l.rsc, l.rec FROM asked a JOIN lastlocal l
    ON a.hit_type = 'local_usage' AND a.filename = l.filename AND a.local_id = l.local_id
  UNION ALL SELECT a.cursor_id, a.filename, s.rrow, s.rsc, s.rec FROM asked a JOIN spans s
    ON a.hit_type IN ('local_usage', 'local_binding') AND s.semantic = 'local_usage' AND a.filename = s.filename AND a.local_id = s.local_id
  UNION ALL SELECT a.cursor_id, a.filename, d.rrow, d.rsc, d.rec FROM asked a JOIN (
      SELECT * FROM spans WHERE semantic = 'var_definition'
      QUALIFY row_number() OVER (PARTITION BY filename, ns, name ORDER BY pos) = 1) d
    ON a.hit_type = 'var_usage' AND a.filename = d.filename AND a.to_ns = d.ns AND a.name = d.name
  UNION ALL SELECT a.cursor_id, a.filename, s.rrow, s.rsc, s.rec FROM asked a JOIN spans s
    ON a.hit_type IN ('var_usage', 'var_definition') AND s.semantic = 'var_usage' AND a.filename = s.filename
    AND coalesce(a.ns, a.to_ns) = s.to_ns AND a.name = s.name
  UNION ALL SELECT a.cursor_id, a.filename, s.rrow, s.rsc, s.rec FROM asked a JOIN spans s
    ON a.hit_type IN ('var_usage', 'var_definition') AND s.semantic = 'symbol' AND a.filename = s.filename
    AND coalesce(a.ns, a.to_ns) || '/' || a.name = s.symbol
  UNION ALL SELECT a.cursor_id, a.filename, s.rrow, s.rsc, s.rec FROM asked a JOIN spans s
    ON a.hit_type = 'java_class_usage' AND s.semantic = 'java_class_usage' AND a.filename = s.filename
    AND a.class_name = s.class_name AND (a.method_name IS NULL OR a.method_name = s.method_name)
  UNION ALL SELECT a.cursor_id, a.filename, s.rrow, s.rsc, s.rec FROM asked a JOIN spans s
    ON a.hit_type = 'namespace_usage' AND s.semantic = 'var_usage' AND a.filename = s.filename AND a.to_ns = s.to_ns
)"""

# Keywords that bind locals, without a binding at their place, are left out.
_TARGETED = """FROM asked a LEFT JOIN bound b ON a.filename = b.filename AND a.hit_type = 'keyword' AND a.pos = b.keyword_pos
  LEFT JOIN per_caret t ON a.cursor_id = t.cursor_id
WHERE NOT (a.hit_type = 'keyword' AND a.keys_destructuring AND b.local_id IS NULL)"""
_PER_CARET = """,
per_caret AS (
  SELECT t.cursor_id, count(*) AS n_regions,
    count(*) FILTER (WHERE NOT (t.rrow = a.begin_row AND t.rsc <= a.begin_col AND t.rec >= a.begin_col)) AS n_highlighted
  FROM thing t JOIN asked a ON t.cursor_id = a.cursor_id GROUP BY ALL
)"""
_add("highlights", f"""
SELECT a.cursor_id, a.hit_type, coalesce(t.n_regions, 0) AS n_regions, coalesce(t.n_highlighted, 0) AS n_highlighted
{_TARGETED}""", prefix=_HITS, ctes=_THING + _PER_CARET)

_add("highlight_counts", f"""
SELECT a.project, a.filename, count(*) AS n_carets, CAST(sum(coalesce(t.n_regions, 0)) AS BIGINT) AS n_highlighted
{_TARGETED} GROUP BY ALL""", prefix=_HITS, ctes=_THING + _PER_CARET)

_add("highlight_counts_others", f"""
SELECT a.project, a.filename, count(*) AS n_carets, CAST(sum(coalesce(t.n_highlighted, 0)) AS BIGINT) AS n_highlighted
{_TARGETED} GROUP BY ALL""", prefix=_HITS, ctes=_THING + _PER_CARET)

_RENAMED = (
    _THING
    + _STARTS
    + """,
requested AS (SELECT cursor_id FROM cursors
  QUALIFY row_number() OVER (PARTITION BY filename
    ORDER BY NOT (begin_row = 2 AND split_part(cursor_id, ':', 3) = '1'), begin_row, CAST(split_part(cursor_id, ':', 3) AS INTEGER)) = 1),
edits AS (
  SELECT DISTINCT t.cursor_id, t.filename, CAST(s.at + t.rsc - 1 AS INTEGER) AS a, CAST(s.at + t.rec - 1 AS INTEGER) AS b,
    substr(s.line, t.rsc, t.rec - t.rsc) AS region_text
  FROM thing t JOIN requested USING (cursor_id) JOIN asked q ON t.cursor_id = q.cursor_id
  JOIN starts s ON s.filename = t.filename AND s.row = t.rrow
  JOIN starts s0 ON s0.filename = t.filename AND s0.row = q.begin_row
  WHERE substr(s.line, t.rsc, t.rec - t.rsc) = substr(s0.line, q.sc, q.ec - q.sc)
)"""
)
_add("rename_regions", "SELECT cursor_id, filename, a, b, region_text FROM edits", prefix=_HITS, ctes=_RENAMED)

_add("renamed_files", """
SELECT e.cursor_id, e.filename, md5(string_agg(substr(d.text, e.prev + 1, e.a - e.prev) || 'renamed', '' ORDER BY e.a)
    || substr(any_value(d.text), max(e.b) + 1)) AS new_md5,
  CAST(count(*) AS INTEGER) AS n_edits, 0 AS n_overlapping
FROM (SELECT *, coalesce(lag(b) OVER (PARTITION BY cursor_id ORDER BY a), 0) AS prev FROM edits) e
JOIN documents d ON d.doc_id = CAST(split_part(e.cursor_id, ':', 1) AS BIGINT)
GROUP BY e.cursor_id, e.filename""", prefix=_HITS, ctes=_RENAMED)

# Groups of regions by key, and each caret's keys with the text under it.
def _key3(kind: str, a: str, b: str = "NULL") -> str:
    return f"'{kind}' || chr(31) || coalesce({a}, chr(1)) || chr(31) || coalesce({b}, chr(1))"


def _single(row: str, sc: str, ec: str) -> str:
    return f"'single:' || {row} || ':' || {sc} || ':' || {row} || ':' || {ec}"


_CARET_GROUPS = (
    _THING.split("thing AS (")[0].rstrip().rstrip(",")
    + _STARTS
    + f""",
grouped AS (
  SELECT filename, key, rrow, rsc, rec FROM (
    SELECT *, {_key3('keyword', 'ns', 'name')} AS key FROM spans WHERE semantic = 'keyword'
    UNION ALL SELECT *, {_key3('local', 'filename', 'CAST(local_id AS VARCHAR)')} FROM spans WHERE semantic = 'local_usage'
    UNION ALL SELECT *, {_key3('var', 'to_ns', 'name')} FROM spans WHERE semantic = 'var_usage'
    UNION ALL SELECT *, {_key3('symbol', 'symbol')} FROM spans WHERE semantic = 'symbol'
    UNION ALL SELECT *, {_key3('java', 'class_name')} FROM spans WHERE semantic = 'java_class_usage'
    UNION ALL SELECT *, {_key3('java', 'class_name', 'method_name')} FROM spans
      WHERE semantic = 'java_class_usage' AND method_name IS NOT NULL
    UNION ALL SELECT u.*, {_key3('vars-of', 'u.to_ns')} FROM spans u
      SEMI JOIN (SELECT * FROM v WHERE semantic = 'namespace_usage') n ON n.filename = u.filename AND n.to_ns = u.to_ns
      WHERE u.semantic = 'var_usage')
),
firstdef AS (SELECT * FROM spans WHERE semantic = 'var_definition'
  QUALIFY row_number() OVER (PARTITION BY filename, ns, name ORDER BY pos) = 1),
carets AS (
  SELECT a.*, substr(s.line, a.sc, a.ec - a.sc) AS region_text, a.hit_type = 'keyword' AND a.keys_destructuring AS destructs
  FROM asked a JOIN starts s ON s.filename = a.filename AND s.row = a.begin_row
),
single AS (
  SELECT cursor_id, filename, region_text, begin_row AS r, sc AS c1, ec AS c2 FROM carets
  WHERE hit_type IN ('symbol', 'local_binding', 'var_definition', 'namespace_definition', 'namespace_usage')
  UNION ALL SELECT a.cursor_id, a.filename, a.region_text, l.rrow, l.rsc, l.rec FROM carets a JOIN lastlocal l
    ON a.hit_type = 'local_usage' AND a.filename = l.filename AND a.local_id = l.local_id
  UNION ALL SELECT a.cursor_id, a.filename, a.region_text, d.rrow, d.rsc, d.rec FROM carets a JOIN firstdef d
    ON a.hit_type = 'var_usage' AND a.filename = d.filename AND a.to_ns = d.ns AND a.name = d.name
  UNION ALL SELECT a.cursor_id, a.filename, a.region_text, b.krow, b.lsc, b.lec FROM carets a JOIN bound b
    ON a.destructs AND a.filename = b.filename AND a.pos = b.keyword_pos
),
targets AS (
  SELECT DISTINCT cursor_id, filename, key, region_text FROM (
    SELECT cursor_id, filename, region_text, {_single('r', 'c1', 'c2')} AS key FROM single
    UNION ALL SELECT cursor_id, filename, region_text, {_key3('keyword', 'ns', 'name')} FROM carets
      WHERE hit_type = 'keyword' AND NOT destructs
    UNION ALL SELECT a.cursor_id, a.filename, a.region_text, {_key3('local', 'a.filename', 'CAST(b.local_id AS VARCHAR)')}
      FROM carets a JOIN bound b ON a.destructs AND a.filename = b.filename AND a.pos = b.keyword_pos
    UNION ALL SELECT cursor_id, filename, region_text, {_key3('local', 'filename', 'CAST(local_id AS VARCHAR)')} FROM carets
      WHERE hit_type IN ('local_binding', 'local_usage')
    UNION ALL SELECT cursor_id, filename, region_text, {_key3('var', 'coalesce(ns, to_ns)', 'name')} FROM carets
      WHERE hit_type IN ('var_definition', 'var_usage')
    UNION ALL SELECT cursor_id, filename, region_text, {_key3('symbol', "coalesce(ns, to_ns) || '/' || name")} FROM carets
      WHERE hit_type IN ('var_definition', 'var_usage')
    UNION ALL SELECT cursor_id, filename, region_text, {_key3('java', 'class_name', 'method_name')} FROM carets
      WHERE hit_type = 'java_class_usage'
    UNION ALL SELECT cursor_id, filename, region_text, {_key3('vars-of', 'to_ns')} FROM carets WHERE hit_type = 'namespace_usage')
),
placed_regions AS (
  SELECT DISTINCT g.filename, g.key, CAST(s.at + g.c1 - 1 AS INTEGER) AS a, CAST(s.at + g.c2 - 1 AS INTEGER) AS b,
    substr(s.line, g.c1, g.c2 - g.c1) AS region_text
  FROM (SELECT filename, key, rrow AS r, rsc AS c1, rec AS c2 FROM grouped
    UNION SELECT filename, {_single('r', 'c1', 'c2')}, r, c1, c2 FROM single) g
  JOIN starts s ON s.filename = g.filename AND s.row = g.r
)"""
)
_add("rename_targets", "SELECT cursor_id, filename, key, region_text FROM targets", prefix=_HITS, ctes=_CARET_GROUPS)
_add("rename_edits", """
SELECT e.filename, e.key, e.region_text, e.a, e.b FROM placed_regions e
SEMI JOIN targets t ON t.filename = e.filename AND t.key = e.key AND t.region_text = e.region_text""",
     prefix=_HITS, ctes=_CARET_GROUPS)

# -- state -----------------------------------------------------------------------------

_LOG = """,
log AS (
  SELECT *, CAST(1 AS BIGINT) AS run_seq FROM rec
  UNION ALL SELECT *, 2 FROM rec WHERE file_ord % 3 = 0 AND file_ord % 30 <> 0 AND pos < 8589934592
)"""
_add("current_records", """
SELECT project, filename, semantic, run_seq, count(*) AS n, CAST(sum(pos) AS BIGINT) AS sum_pos FROM log
WHERE run_seq = CASE WHEN file_ord % 3 = 0 AND file_ord % 30 <> 0 THEN 2 ELSE 1 END GROUP BY ALL""", ctes=_LOG)

_add("compacted_records", """
SELECT project, filename, semantic, run_seq, count(*) AS n, CAST(sum(pos) AS BIGINT) AS sum_pos
FROM (SELECT * FROM log UNION ALL SELECT *, 3 AS run_seq FROM rec WHERE file_ord % 7 = 0 AND pos < 6442450944)
WHERE file_ord % 70 <> 1 AND run_seq = CASE WHEN file_ord % 7 = 0 THEN 3 WHEN file_ord % 3 = 0 AND file_ord % 30 <> 0 THEN 2 ELSE 1 END
GROUP BY ALL""", ctes=_LOG)

_add("current_records_mentioned", """
SELECT project, filename, run_seq, count(*) AS n FROM log
WHERE run_seq = CASE WHEN file_ord % 3 = 0 THEN 2 ELSE 1 END GROUP BY ALL""", ctes=_LOG)

_add("latest_report", """
SELECT project, run_seq, semantic, count(*) AS n FROM log l
WHERE scope = 'classpath' AND run_seq = (SELECT max(run_seq) FROM log m WHERE m.scope = 'classpath' AND m.project = l.project)
GROUP BY ALL""", ctes=_LOG)

_add("cleared_state", """
SELECT project, run_seq, count(*) AS n FROM log
WHERE NOT (CAST(substr(project, 2) AS BIGINT) % 7 = 0 AND run_seq <= 1) GROUP BY ALL""", ctes=_LOG)

# -- events ----------------------------------------------------------------------------

_EVENTS = """
ev AS (
  SELECT 'v' || user_id AS view_id, ts, event_id AS change_count,
    CASE event_type WHEN 'click' THEN 'modified' WHEN 'view' THEN 'activated' WHEN 'purchase' THEN 'saved'
      WHEN 'signup' THEN 'project_loaded' WHEN 'error' THEN 'closed' END AS kind,
    CASE user_id % 3 WHEN 0 THEN 'Clojure' WHEN 1 THEN 'ClojureScript' ELSE 'Python' END AS syntax,
    user_id % 5 = 0 AS is_scratch
  FROM events
), applicable AS (SELECT * FROM ev WHERE syntax IN ('Clojure', 'ClojureScript') AND NOT is_scratch)"""
_add("applicable_events", "SELECT change_count, view_id, kind, syntax FROM applicable", prefix=_EVENTS)

_add("refresh_requests", """
SELECT change_count, view_id, kind, unnest(CASE WHEN kind IN ('activated', 'saved', 'modified') THEN ['view']
    WHEN kind = 'project_loaded' THEN ['paths', 'classpath'] ELSE [] END) AS refresh,
  kind = 'modified' AS is_delayed, kind = 'saved' AS annotate
FROM applicable""", prefix=_EVENTS)

_BURSTS = """
SELECT view_id, min(ts) AS first_edit, max(ts) + INTERVAL 6 HOUR AS analyse_at, max(change_count) AS change_count, count(*) AS n_edits
FROM (SELECT *, sum(CASE WHEN ts > prev + INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY view_id ORDER BY ts, change_count) AS burst
  FROM (SELECT *, lag(ts) OVER (PARTITION BY view_id ORDER BY ts, change_count) AS prev FROM applicable WHERE kind = 'modified'))
GROUP BY view_id, burst"""

_VIEW_STATE = f"""
FROM (SELECT view_id, max(change_count) AS change_count FROM applicable WHERE kind = 'modified' GROUP BY ALL) v
LEFT JOIN (
  SELECT view_id, max(n) AS analysed_count FROM (
    SELECT e.view_id, e.change_count AS n FROM applicable e
    JOIN (SELECT view_id, max(change_count) AS at FROM applicable WHERE kind IN ('activated', 'saved') GROUP BY ALL) s
      ON e.view_id = s.view_id AND e.change_count < s.at WHERE e.kind = 'modified'
    UNION ALL SELECT view_id, change_count FROM ({_BURSTS}) WHERE analyse_at <= (SELECT max(ts) FROM ev))
  GROUP BY ALL) n ON v.view_id = n.view_id"""

for _name in ("stale_files", "live_stale_files"):
    _add(_name, f"""
SELECT v.view_id, v.change_count, n.analysed_count {_VIEW_STATE}
WHERE v.change_count IS DISTINCT FROM n.analysed_count""", prefix=_EVENTS)

_add("fresh_highlights", f"""
SELECT f.view_id, h.filename, h.n_carets, h.n_highlighted
FROM (SELECT a.filename, count(*) AS n_carets, CAST(sum(coalesce(t.n_highlighted, 0)) AS BIGINT) AS n_highlighted
  {_TARGETED} GROUP BY ALL) h
JOIN (SELECT v.view_id {_VIEW_STATE} WHERE v.change_count = n.analysed_count) f
  ON f.view_id = 'v' || regexp_extract(h.filename, '/d([0-9]+)', 1)""", prefix=_HITS, ctes=_THING + _PER_CARET + "," + _EVENTS)

_add("closed_view_state", """
SELECT view_id, count(*) AS n FROM applicable e WHERE kind = 'modified' AND change_count > coalesce(
  (SELECT max(change_count) FROM applicable c WHERE c.kind = 'closed' AND c.view_id = e.view_id), -1)
GROUP BY ALL""", prefix=_EVENTS)

# A burst goes on while the next edit comes within the gap, or exactly at its end.
for _name in ("debounced_edits", "debounced_edits_stream", "live_bursts"):
    _add(_name, _BURSTS, prefix=_EVENTS)

# -- archives --------------------------------------------------------------------------

_SQL["archive_members"] = """
WITH f AS (
  SELECT 'p' || (doc_id // 50) || '/d' || doc_id ||
    CASE lang WHEN 'en' THEN '.clj' WHEN 'fr' THEN '.cljs' WHEN 'de' THEN '.cljc' ELSE '' END AS member, text FROM documents
)
SELECT '/jars/' || member || '.jar' AS archive, member, md5(text) AS content_md5 FROM f"""
