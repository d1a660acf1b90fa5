"""SQL for the check of functions, classes and their bodies.

Bodies are stated by levels instead of a stack: an opening brace at level d
belongs to the next closing brace that leaves level d, and an indented block
ends before the first line that is no deeper than its head.
"""

from __future__ import annotations

from bindings.corpus import files_cte, q
from bindings.metric_queries import CYCLOMATIC_SQL, FILES, ORACLES, count_all_sql, count_sql
from lintlake.operators import structure as st
from lintlake.rules import quality

_HIT_PLACES = """SELECT *, ms[k] AS m, CAST(list_sum(list_transform(ss[1:k], lambda s: length(s))) + coalesce(list_sum(list_transform(ms[1:k-1], lambda s: length(s))), 0) AS BIGINT) AS start0
 FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS k FROM ({hits}))"""

# Matched braces by level; a closing brace that opens a new minimum has no partner.
BRACES_SQL = """brace AS (SELECT path, t, length(part) AS n, i FROM (SELECT path, unnest(ts) AS t, unnest(parts[1:len(ts)]) AS part, generate_subscripts(ts, 1) AS i
  FROM (SELECT path, regexp_extract_all(text, '[{}]') AS ts, string_split_regex(text, '[{}]') AS parts FROM files WHERE regexp_matches(text, '[{}]')))),
 level AS (SELECT *, sum(n) OVER w + i - 1 AS pos0, sum(CASE t WHEN '{' THEN 1 ELSE -1 END) OVER w AS run FROM brace WINDOW w AS (PARTITION BY path ORDER BY i)),
 low AS (SELECT *, least(0, min(run) OVER (PARTITION BY path ORDER BY i)) AS floor FROM level),
 held AS (SELECT *, run - floor + CASE t WHEN '{' THEN 0 ELSE 1 END AS d FROM (SELECT *, coalesce(lag(floor) OVER (PARTITION BY path ORDER BY i), 0) AS before FROM low) WHERE t = '{' OR floor = before),
 pairs AS MATERIALIZED (SELECT path, CAST(pos0 AS BIGINT) AS open0, CAST(close0 AS BIGINT) AS close0 FROM (SELECT *, lead(pos0) OVER (PARTITION BY path, d ORDER BY i) AS close0 FROM held) WHERE t = '{')"""

_BLANK = "' ' || chr(9)"
# Lines of indented files; ``told`` lines can end a block, others are skipped.
INDENT_SQL = f"""ilines AS MATERIALIZED (SELECT path, start0, start0 + length(l) AS stop0, length(l) - length(ltrim(l, {_BLANK})) AS indent,
  NOT regexp_matches(l, '^\\s*$') AND NOT starts_with(ltrim(l, {_BLANK}), '#') AS told
  FROM (SELECT path, l, CAST(sum(length(l) + 1) OVER (PARTITION BY path ORDER BY pos) - length(l) - 1 AS BIGINT) AS start0
   FROM (SELECT path, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM files WHERE starts_with(language, 'python') AND regexp_matches(text, 'def|class'))))"""


def _ends_sql(heads: str) -> str:
    """``heads(path, start0, end0)`` in indented files with the end of each block."""
    return f"""SELECT path, start0, end0, max(coalesce(stop0, CASE strpos(substr(text, end0 + 1), chr(10)) WHEN 0 THEN length(text) ELSE end0 + strpos(substr(text, end0 + 1), chr(10)) - 1 END)) AS stop0 FROM (
  SELECT h.path, h.text, h.start0, h.end0, x.stop0 FROM (SELECT h.*, min(x.start0) AS break0 FROM (SELECT h.*, b.indent FROM {heads} h JOIN ilines b ON b.path = h.path AND b.start0 = h.start0) h
   LEFT JOIN ilines x ON x.path = h.path AND x.start0 > h.end0 AND x.told AND x.indent <= h.indent GROUP BY ALL) h
  LEFT JOIN ilines x ON x.path = h.path AND x.start0 > h.end0 AND x.told AND (break0 IS NULL OR x.start0 < break0)) GROUP BY path, start0, end0"""


def _heads(kind: str, patterns: dict) -> str:
    """Heads of one kind in files with braces."""
    named = [x for x in patterns if x != "python"]
    parts = []
    for language in named:
        ps = patterns[language]
        own = f"language = '{language}'"
        if language == "javascript":
            own = "language NOT IN (" + ", ".join(q(x) for x in patterns if x != "javascript") + ")"
        for p in [ps] if isinstance(ps, str) else ps:
            hits = f"SELECT project, path, language, text, regexp_extract_all(text, {q(p)}) AS ms, string_split_regex(text, {q(p)}) AS ss FROM files WHERE {own} AND regexp_matches(text, {q(p)})"
            parts.append(f"SELECT project, path, language, text, '{kind}' AS kind, regexp_extract(m, {q(p)}, 1) AS name, start0, start0 + length(m) AS end0, m FROM ({_HIT_PLACES.format(hits=hits)})")
    return " UNION ALL ".join(parts)


def _indented_heads(kind: str, pattern: str) -> str:
    # The start of a line is the break before it, so that hits do not depend on where the search goes on.
    p = q("\\n" + pattern.removeprefix("^"))
    hits = f"SELECT project, path, language, text, regexp_extract_all(chr(10) || text, {p}) AS ms, string_split_regex(chr(10) || text, {p}) AS ss FROM files WHERE language = 'python' AND regexp_matches(chr(10) || text, {p})"
    return f"SELECT project, path, language, text, '{kind}' AS kind, regexp_extract(m, {p}, 1) AS name, start0, start0 + length(m) - 1 AS end0 FROM ({_HIT_PLACES.format(hits=hits)})"


_FUNCTIONS = st.FUNCTION_HEADS
UNITS_SQL = f"""{BRACES_SQL},
 {INDENT_SQL},
 heads AS MATERIALIZED (SELECT *, CASE WHEN ends_with(m, '{{') THEN end0 - 1 WHEN regexp_matches(substr(text, end0 + 1), '^\\s*\\{{') THEN end0 + length(regexp_extract(substr(text, end0 + 1), '^\\s*\\{{')) - 1 END AS open0
  FROM ({_heads("function", _FUNCTIONS)} UNION ALL {_heads("class", st.CLASS_HEADS)})),
 iheads AS MATERIALIZED ({_indented_heads("function", _FUNCTIONS["python"][0])} UNION ALL {_indented_heads("class", st.CLASS_HEADS["python"])}),
 blocks AS ({_ends_sql("(SELECT DISTINCT path, text, start0, end0 FROM iheads)")}),
 bodies AS (SELECT project, h.path, language, kind, name, text, start0, CASE WHEN h.open0 IS NULL THEN string_split(substr(text, end0 + 1), chr(10))[1] ELSE substr(text, h.open0 + 2, coalesce(close0, length(text)) - h.open0 - 1) END AS body
   FROM heads h LEFT JOIN pairs p ON p.path = h.path AND p.open0 = h.open0
  UNION ALL SELECT project, h.path, language, kind, name, text, start0, ltrim(substr(text, end0 + 1, stop0 - end0), {_BLANK}) FROM iheads h JOIN blocks b USING (path, start0, end0)),
 units AS MATERIALIZED (SELECT project, path, language, kind, name, CAST(length(left(text, start0)) - length(replace(left(text, start0), chr(10), '')) + 1 AS INTEGER) AS line, body FROM bodies)"""


def units_sql(files: str) -> str:
    """``WITH files, ..., units(project, path, language, kind, name, line, body)``."""
    return f"WITH {files}, {UNITS_SQL}"


def _over(name: str, table: str) -> str:
    """The check of a file metric, over another table of texts."""
    sql = ORACLES[name].removeprefix(FILES).strip().removeprefix(",")
    if not sql.lstrip().upper().startswith("SELECT"):
        sql = "WITH " + sql
    # Bands are cut from whole numbers and means, so nothing is rounded before.
    return sql.replace("FROM files", f"FROM {table}").replace("round(CASE WHEN", "(CASE WHEN").replace("END, 4)", "END)")


METRICS_SQL = f""", fu AS MATERIALIZED (SELECT project, CAST(row_number() OVER () AS VARCHAR) AS path, path AS file, language, name, line, body AS text FROM units WHERE kind = 'function'),
 cyc AS ({_over("G10_cyclomatic", "fu")}), cog AS ({_over("W5_cognitive", "fu")}), hal AS ({_over("G11_halstead", "fu")}), nest AS ({_over("W4_nesting_depth", "fu")}),
 fm0 AS (SELECT u.project, u.file AS path, u.language, coalesce(u.name, 'anonymous') AS name, u.line, len(string_split(u.text, chr(10))) AS lines, cyclomatic, cognitive, max_depth AS nesting_depth, n1, volume, maintainability_index
  FROM fu u JOIN cyc USING (path) JOIN cog USING (path) JOIN hal USING (path) JOIN nest USING (path)),
 fm AS MATERIALIZED (SELECT *, CASE WHEN p >= 30 THEN 'critical' WHEN p >= 20 THEN 'high' WHEN p >= 10 THEN 'medium' ELSE 'low' END AS risk_level FROM (SELECT *, cyclomatic * 2 + cognitive + lines // 20 AS p FROM fm0)),
 cm0 AS (SELECT project, path, language, name, line, body, len(string_split(body, chr(10))) AS lines,
  CASE language WHEN 'python' THEN {count_sql(st.METHODS["python"], "body")} WHEN 'java' THEN {count_sql(st.METHODS["java"], "body")} ELSE {count_sql(st.METHODS["javascript"], "body")} END AS methods,
  CASE language WHEN 'python' THEN {count_sql(st.FIELDS["python"], "body")} WHEN 'java' THEN {count_sql(st.FIELDS["java"], "body")} ELSE {count_sql(st.FIELDS["javascript"], "body")} END AS fields,
  {count_all_sql(st.COUPLING, "body")} AS coupling FROM units WHERE kind = 'class'),
 cm AS MATERIALIZED (SELECT project, path, language, name, line, lines, CAST(methods AS INTEGER) AS methods, CAST(fields AS INTEGER) AS fields, CAST(coupling AS INTEGER) AS coupling,
  CASE WHEN methods = 0 OR fields = 0 THEN 100 WHEN fields / methods BETWEEN 0.5 AND 3 THEN 80 WHEN fields / methods BETWEEN 0.2 AND 5 THEN 60 ELSE 40 END AS cohesion,
  CASE WHEN p >= 30 THEN 'critical' WHEN p >= 20 THEN 'high' WHEN p >= 10 THEN 'medium' ELSE 'low' END AS risk_level FROM (SELECT *, methods * 2 + length(body) // 100 AS p FROM cm0))"""

REPORT_SQL = f""", part AS (SELECT path, count(*) AS total_functions, avg(maintainability_index) AS mi, count(*) FILTER (WHERE cyclomatic > 10) AS complex_functions, count(*) FILTER (WHERE maintainability_index < 50) AS low_index_functions FROM fm GROUP BY path),
 kinds AS (SELECT path, count(*) AS total_classes, count(*) FILTER (WHERE methods > 10) AS large_classes FROM cm GROUP BY path),
 wcyc AS (SELECT project, path, language, len(string_split(text, chr(10))) AS total_lines, {CYCLOMATIC_SQL} AS cyclomatic FROM files), wcog AS ({_over("W5_cognitive", "files")}), wnest AS ({_over("W4_nesting_depth", "files")}),
 report AS MATERIALIZED (SELECT f.project, path, f.language, total_lines, coalesce(total_functions, 0) AS total_functions, coalesce(total_classes, 0) AS total_classes, coalesce(complex_functions, 0) AS complex_functions,
  coalesce(low_index_functions, 0) AS low_index_functions, coalesce(large_classes, 0) AS large_classes, cyclomatic, cognitive, CAST(floor(coalesce(mi, 100) + 0.5) AS BIGINT) AS average_maintainability_index, max_depth AS max_nesting_depth
  FROM wcyc f JOIN wcog USING (path) JOIN wnest USING (path) LEFT JOIN part USING (path) LEFT JOIN kinds USING (path))"""


def _long_starts(pattern: str) -> str:
    hits = f"SELECT project, path, language, text, regexp_extract_all(text, {q(pattern)}) AS ms, string_split_regex(text, {q(pattern)}) AS ss FROM wide WHERE NOT starts_with(language, 'python') AND regexp_matches(text, {q(pattern)})"
    return f"SELECT project, path, language, text, start0 FROM ({_HIT_PLACES.format(hits=hits)})"


def _long_indented() -> str:
    p = q("\\n" + quality.PY_FUNCTION_START.removeprefix("^"))
    hits = f"SELECT project, path, language, text, regexp_extract_all(chr(10) || text, {p}) AS ms, string_split_regex(chr(10) || text, {p}) AS ss FROM wide WHERE starts_with(language, 'python') AND regexp_matches(chr(10) || text, {p})"
    return f"SELECT project, path, language, text, start0, start0 + length(m) - 1 AS end0 FROM ({_HIT_PLACES.format(hits=hits)})"


_N = "length(substr(text, start0 + 1, stop0 - start0)) - length(replace(substr(text, start0 + 1, stop0 - start0), chr(10), '')) + 1"
LONG_SQL = f"""wide AS (SELECT * FROM files WHERE language IN ('javascript', 'typescript', 'python') AND len(string_split(text, chr(10))) > {quality.LONG_FUNCTION_LINES}),
 begins AS (SELECT DISTINCT * FROM ({" UNION ALL ".join(_long_starts(p) for p in quality.JS_FUNCTION_STARTS)})),
 ibegins AS MATERIALIZED ({_long_indented()}),
 spans AS (SELECT project, b.path, language, text, start0, arg_min(close0, open0) AS stop0 FROM begins b JOIN pairs p ON p.path = b.path AND p.open0 >= start0 AND close0 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT project, i.path, language, text, start0, stop0 FROM ibegins i JOIN ({_ends_sql("ibegins")}) USING (path, start0, end0)),
 longs AS (SELECT project, path, language, CASE language WHEN 'python' THEN 'quality-python' ELSE 'quality-javascript' END AS engine, 'max-lines-per-function' AS rule, 'complexity' AS category, 'warning' AS severity,
  replace({q(quality.LONG_FUNCTION_MESSAGE)}, '{{count}}', CAST(number AS VARCHAR)) AS message, CAST(length(left(text, start0)) - length(replace(left(text, start0), chr(10), '')) + 1 AS INTEGER) AS line, 1 AS "column", CAST(number AS INTEGER) AS number
  FROM (SELECT *, {_N} AS number FROM spans) WHERE number > {quality.LONG_FUNCTION_LINES})"""


LONGS = f"{BRACES_SQL}, {INDENT_SQL}, {LONG_SQL}"


CORPUS_UNITS = units_sql(files_cte())
