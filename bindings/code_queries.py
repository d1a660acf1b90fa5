"""Structure, graphs, taint, line checks, rewrites and diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.corpus import WIDE, code_files, corpus, document_files, files_cte, page_files, q, read, wide_corpus
from bindings.dependency_queries import MANIFEST_SQL, manifest_files
from bindings.metric_queries import LINES_SQL
from bindings.report_queries import PROJECT_SQL
from bindings.rule_sql import hits_sql, repeats_sql
from bindings.unit_sql import CORPUS_UNITS, LONGS, METRICS_SQL, REPORT_SQL, UNITS_SQL, units_sql
from lintlake.functions import language as lang
from lintlake.operators import diagnostics as dx
from lintlake.operators import graph as g
from lintlake.operators import rewrite as rw
from lintlake.operators import scan
from lintlake.operators import structure as st
from lintlake.operators import taint as t
from lintlake.operators.duplicates import duplicate_blocks, repeated_text
from lintlake.plans.analysis import project_findings
from lintlake.rules import extra, review
from lintlake.sinks import exports

FILES = "WITH " + files_cte()
LINES = FILES + LINES_SQL
QUERIES, ORACLES = {}, {}


def add(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


# ---- languages -------------------------------------------------------------
_NAMES = ["app.js", "App.JSX", "a.d.ts", "x.spec.ts", "x.test.js", "t.test.py", "J.spec.java", "webpack.config.js", "tsconfig.json",
          "package.json", "Dockerfile", "Makefile", "m.py", "n.RS", "o.kts", "p.hh", "q.R", "r.unknown", "noext", ".bashrc", "s.ipynb", "t.sol", "u.tf", "v.tar.gz", "w.ps1"]


def _paths(s, d):
    from lintlake.functions.text import sql_string
    return read(s, d, "part").select(F.expr(f"concat('p', cast(p_partkey as string), '.d/', element_at(array({', '.join(map(sql_string, _NAMES))}), cast(p_partkey % {len(_NAMES)} as int) + 1)) AS path"))


_PATHS = f"WITH paths AS (SELECT 'p' || CAST(p_partkey AS VARCHAR) || '.d/' || [{','.join(map(q, _NAMES))}][p_partkey % {len(_NAMES)} + 1] AS path FROM part), n AS (SELECT path, string_split(path, '/')[-1] AS base, lower(regexp_extract(string_split(path, '/')[-1], '[^.](\\.[^.]*)$', 1)) AS ext, lower(regexp_extract(path, '(\\.[^.]*)$', 1)) AS last FROM paths)"
_case = lambda table, key: "CASE " + key + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"
_compound = " ".join("WHEN " + " OR ".join(f"ends_with(lower(base), '{e}')" for e in ends) + f" THEN '{v}'" for ends, v in lang.COMPOUND_SUFFIXES)
_named = " ".join(f"WHEN lower(base) IN ({','.join(map(q, names))}) THEN '{v}'" for names, v in lang.FILE_NAMES)
_P1 = f"CASE {_compound} {_named} ELSE coalesce({_case(lang.STANDARD, 'ext')}, 'unknown') END"
add("P1_P4_P5_languages", lambda s, d: _paths(s, d).select("path", lang.detect_language("path").alias("language")).select("path", "language", lang.normalize_language("language").alias("normalized"), lang.is_supported("language").alias("supported")),
    _PATHS + f" SELECT path, l AS language, CASE WHEN starts_with(l, 'javascript') THEN 'javascript' WHEN starts_with(l, 'typescript') THEN 'typescript' WHEN starts_with(l, 'python') THEN 'python' ELSE l END AS normalized, l IN ({','.join(map(q, lang.supported_languages()))}) AS supported FROM (SELECT *, {_P1} AS l FROM n)")
add("P2_extended_languages", lambda s, d: _paths(s, d).select("path", lang.detect_language_extended("path").alias("language")),
    _PATHS + f" SELECT path, coalesce({_case(lang.EXTENDED, 'last')}, 'unknown') AS language FROM n")
add("P3_scanner_languages", lambda s, d: _paths(s, d).select("path", lang.detect_scanner_language("path").alias("language"), lang.is_code_file("path").alias("is_code"), lang.sarif_language("path").alias("sarif_language")),
    _PATHS + f" SELECT path, CASE WHEN base = 'Dockerfile' THEN 'dockerfile' ELSE {_case(lang.SCANNER, 'ext')} END AS language, base = 'Dockerfile' OR ext IN ({','.join(map(q, lang.CODE_EXTENSIONS))}) AS is_code, coalesce({_case(lang.SARIF, 'ext')}, 'text') AS sarif_language FROM n")

# ---- search and line checks ------------------------------------------------
add("RS26_pattern_search", lambda s, d: scan.search_pattern(corpus(s, d), r"token\s*=", "**/*.py"),
    LINES + " SELECT project, path, language, CAST(pos AS INTEGER) AS line, trim(l, ' ') AS context FROM lines WHERE ends_with(path, '.py') AND regexp_matches(l, 'token\\s*=')")
_adv = extra.LINE_SECURITY
add("RS21_line_security", lambda s, d: t.line_security(corpus(s, d)),
    LINES + "".join((" UNION ALL" if i else "") + f" SELECT project, path, CAST(pos AS INTEGER) AS line, {q(m)} AS message, 'ERROR' AS severity, {q(sg)} AS suggestion, CAST(length(l) AS INTEGER) AS end_column FROM lines WHERE regexp_matches(l, {q(p)})" for i, (p, m, sg) in enumerate(_adv)))
_terms = [(x, s) for s, names in extra.SENSITIVE_TERMS.items() for x in names]
add("RS25_sensitive_terms", lambda s, d: t.sensitive_terms(corpus(s, d)),
    LINES + f", terms(term, severity) AS (VALUES {','.join(f'({q(a)},{q(b)})' for a, b in _terms)}) SELECT project, path, CAST(pos AS INTEGER) AS line, term, severity, regexp_replace(l, '^\\s+|\\s+$', '', 'g') AS context FROM lines, terms WHERE contains(l, term)")
_DEFS = LINES + """, nx AS (SELECT project, path, pos, l, coalesce(lead(l) OVER (PARTITION BY path ORDER BY pos), '') AS next_l, count(*) OVER (PARTITION BY path) AS n FROM lines),
 defs AS (SELECT *, lead(pos) OVER (PARTITION BY path ORDER BY pos) AS next_def, string_split(string_split(l, 'def ')[2], '(')[1] AS name FROM nx WHERE regexp_matches(l, '^\\s*def '))"""
add("W6_long_definitions", lambda s, d: t.long_definitions(corpus(s, d), 4),
    _DEFS + " SELECT project, path, CAST(pos AS INTEGER) AS line, '⚠️ 函数 `' || name || '` 过长 (' || (next_def - pos) || ' 行)，建议拆分' AS message, 'WARNING' AS severity, '将函数拆分为多个小函数，每个函数不超过 20 行' AS suggestion FROM defs WHERE next_def - pos > 4")
_DOC = "SELECT project, path, CAST(pos AS INTEGER) AS line, '📝 函数缺少文档字符串' AS message, 'INFO' AS severity, '添加文档字符串说明函数功能、参数和返回值' AS suggestion FROM defs WHERE pos < n AND NOT regexp_matches(next_l, '^\\s*(\"\"\"|'''''')')"
add("RS29_missing_docstrings", lambda s, d: t.missing_docstrings(corpus(s, d)), _DEFS + " " + _DOC)
_REVIEW = _DEFS + ", diags AS (" + " UNION ALL ".join(f"SELECT project, path, CAST(pos AS INTEGER) AS line, {q(m)} AS message, 'ERROR' AS severity, {q(sg)} AS suggestion FROM lines WHERE regexp_matches(l, {q(p)})" for p, m, sg in _adv) + " UNION ALL " + _DOC + " UNION ALL SELECT project, path, CAST(pos AS INTEGER), '⚠️ 函数 `' || name || '` 过长 (' || (next_def - pos) || ' 行)，建议拆分', 'WARNING', '将函数拆分为多个小函数，每个函数不超过 20 行' FROM defs WHERE next_def - pos > 50)"
add("SK7_review_comments", lambda s, d: exports.review_comments(t.review_diagnostics(corpus(s, d))),
    _REVIEW + " SELECT path, line AS position, message || chr(10) || chr(10) || '💡 **建议**: ' || suggestion AS body FROM diags")
_ADV3 = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} > {n} THEN {q(x)} END" for c, n, x in t.REVIEW_ADVICE) + "], lambda x: x IS NOT NULL), chr(10))"
add("G32_E13_review_summary", lambda s, d: t.review_summary(corpus(s, d), t.review_diagnostics(corpus(s, d))),
    _REVIEW + f", a AS (SELECT project, count(*) AS total_files, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS total_changes FROM files GROUP BY project), b AS (SELECT project, count(*) AS i, count(*) FILTER (WHERE severity = 'ERROR') AS c, count(*) FILTER (WHERE severity = 'WARNING') AS w, count(*) FILTER (WHERE severity = 'INFO') AS n FROM diags GROUP BY project), r AS (SELECT project, total_files, total_changes, coalesce(i, 0) AS issues_found, coalesce(c, 0) AS critical, coalesce(w, 0) AS warning, coalesce(n, 0) AS info FROM a LEFT JOIN b USING (project)) SELECT *, CASE WHEN critical > 0 OR warning > 5 OR info > 10 THEN {_ADV3} ELSE {q(t.REVIEW_FINE)} END AS recommendation FROM r")
_minor = "SELECT project, path, CAST(pos AS INTEGER) AS line, {m} AS issue, 'minor' AS level FROM lines WHERE language = 'python' AND {w}"
_DEEP = hits_sql(extra.DEEP_CHECK, files_cte()) .rstrip() + LINES_SQL + ", secrets AS (" + " UNION ALL ".join(
    f"SELECT project, path, text, unnest(range(1, len(ms) + 1)) AS k, ms, ss FROM (SELECT *, regexp_extract_all(text, {q(p)}) AS ms, string_split_regex(text, {q(p)}) AS ss FROM files WHERE language = 'python' AND regexp_matches(text, {q(p)}))"
    for p in [n + "\\s*=\\s*[\"'][^\"']+[\"']" for n in extra.DEEP_SECRET_NAMES]) + "), sp AS (SELECT project, path, text, ms[k] AS m, CAST(list_sum(list_transform(ss[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:k-1], lambda x: length(x))), 0) AS BIGINT) AS off FROM secrets)"
_DEEP_SQL = f"""SELECT project, path, line, message AS issue, 'major' AS level FROM findings WHERE language = 'python'
 UNION ALL SELECT project, path, CAST(length(left(text, off)) - length(replace(left(text, off), chr(10), '')) + 1 AS INTEGER), '发现硬编码的敏感信息', 'major' FROM sp WHERE NOT contains(substr(text, greatest(off - 49, 1), off + 1 + length(m) + 50 - greatest(off - 49, 1)), 'os.environ')
 UNION ALL {_minor.format(m=q('使用裸 except，建议指定具体异常类型'), w="regexp_matches(l, '\\bexcept\\s*:') AND NOT regexp_matches(l, 'except\\s+Exception')")}
 UNION ALL {_minor.format(m=q('使用 print 语句，生产环境建议使用 logging'), w="regexp_matches(l, '\\bprint\\s*\\(') AND NOT regexp_matches(l, '^\\s*#') AND NOT contains(lower(path), 'debug') AND NOT contains(lower(path), 'test')")}"""
add("RS22_deep_check", lambda s, d: t.deep_check(corpus(s, d)), _DEEP + " " + _DEEP_SQL)

# ---- taint -----------------------------------------------------------------
_SRC = " UNION ALL ".join(f"SELECT project, path, pos, {i} AS p, regexp_replace(l, '^\\s+|\\s+$', '', 'g') AS l FROM lines WHERE language = 'python' AND regexp_matches(l, {q(p)})" for i, p in enumerate(extra.TAINT_SOURCES))
_SNK = " UNION ALL ".join(f"SELECT project, path, pos, {q(n)} AS sink, {q(c)} AS cwe, {q(extra.SINK_ADVICE[n])} AS advice FROM lines WHERE language = 'python' AND regexp_matches(l, {q(p)})" for p, n, c in extra.TAINT_SINKS)
_TAINT = LINES + f", src AS ({_SRC}), ranked AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY pos, p) AS k FROM src), traces AS (SELECT path, string_agg('Line ' || pos || ': ' || l, chr(10) ORDER BY k) AS trace FROM ranked WHERE k <= 3 GROUP BY path), snk AS ({_SNK}), taints AS (SELECT project, snk.path, CAST(pos AS INTEGER) AS line, '🔴 ' || sink || '风险 - 可能使用用户输入' AS message, 'HIGH' AS risk_level, cwe, trace, advice AS recommendation FROM snk JOIN traces USING (path))"
_ROUTES = ", routes AS (SELECT project, path, unnest(regexp_extract_all(text, '@app\\.route\\([''\"]([^''\"]+)[''\"]', 1)) AS route, 'GET/POST' AS method, 'flask' AS k FROM files WHERE language = 'python' UNION ALL SELECT project, path, unnest(regexp_extract_all(text, '@router\\.(get|post|put|delete)\\([''\"]([^''\"]+)[''\"]', 2)), upper(unnest(regexp_extract_all(text, '@router\\.(get|post|put|delete)\\([''\"]([^''\"]+)[''\"]', 1))), 'fast' FROM files WHERE language = 'python'), ends AS (SELECT project, path, route, method, CASE WHEN k = 'flask' AND (contains(route, '<id>') OR contains(route, '<path:')) OR k = 'fast' AND contains(route, '{') THEN 'MEDIUM' ELSE 'LOW' END AS risk_level FROM routes)"
add("J8_W8_RS23_taint", lambda s, d: t.taint_findings(corpus(s, d)), _TAINT + " SELECT * FROM taints")
add("RS24_api_endpoints", lambda s, d: t.api_endpoints(corpus(s, d)), FILES + _ROUTES + " SELECT * FROM ends")
add("G36_E5_deep_scan", lambda s, d: t.deep_scan_report(t.taint_findings(corpus(s, d)), t.api_endpoints(corpus(s, d))),
    _TAINT + _ROUTES + " SELECT 'finding' AS kind, risk_level, count(*) AS count FROM taints GROUP BY 2 UNION ALL SELECT 'endpoint', risk_level, count(*) FROM ends GROUP BY 2")

# ---- structure -------------------------------------------------------------
_DEFP = q(r"def (\w+)\([^)]*\):")
_CALLS = f"calls AS (SELECT DISTINCT project, path, caller, callee FROM (SELECT project, path, caller, unnest(regexp_extract_all(body, '(\\w+)\\([^)]*\\)', 1)) AS callee FROM (SELECT project, path, unnest(regexp_extract_all(text, {_DEFP}, 1)) AS caller, unnest(string_split_regex(text, {_DEFP})[2:]) AS body FROM files WHERE language = 'python')) WHERE caller <> callee)"
add("M8_call_edges", lambda s, d: st.call_edges(corpus(s, d)), FILES + ", " + _CALLS + " SELECT * FROM calls")
add("J10_call_neighbourhood", lambda s, d: g.neighbourhood(st.call_edges(corpus(s, d)), "helper7", 2),
    FILES + ", " + _CALLS + """, e AS (SELECT DISTINCT caller, callee FROM calls), o1 AS (SELECT DISTINCT callee AS name FROM e WHERE caller = 'helper7' AND callee <> 'helper7'), o2 AS (SELECT DISTINCT callee AS name FROM e WHERE caller IN (SELECT name FROM o1) AND callee <> 'helper7' AND callee NOT IN (SELECT name FROM o1)),
 i1 AS (SELECT DISTINCT caller AS name FROM e WHERE callee = 'helper7' AND caller <> 'helper7'), i2 AS (SELECT DISTINCT caller AS name FROM e WHERE callee IN (SELECT name FROM i1) AND caller <> 'helper7' AND caller NOT IN (SELECT name FROM i1))
 SELECT 'callees' AS direction, name, 1 AS distance FROM o1 UNION ALL SELECT 'callees', name, 2 FROM o2 UNION ALL SELECT 'callers', name, 1 FROM i1 UNION ALL SELECT 'callers', name, 2 FROM i2""")
_EXT = "ext AS (SELECT project, path, language, child, nullif(arg_max(parent, spot), '') AS parent FROM (SELECT project, path, language, unnest(cs) AS child, unnest(ps) AS parent, generate_subscripts(cs, 1) AS spot FROM (SELECT project, path, language, CASE WHEN language = 'python' THEN regexp_extract_all(text, {b}, 1) ELSE regexp_extract_all(text, {a}, 1) END AS cs, CASE WHEN language = 'python' THEN regexp_extract_all(text, {b}, 2) ELSE regexp_extract_all(text, {a}, 2) END AS ps FROM files)) GROUP BY project, path, language, child)".format(
    a=q(r"class\s+(\w+)(?:\s+extends\s+(\w+))?"), b=q(r"class\s+(\w+)(?:\s*\(\s*(\w+)(?:\.[^(]*)?\s*\))?"))
_WALK = """, walk AS (SELECT path, child AS start, child AS cur, 0 AS depth, [child] AS seen, true AS open FROM ext UNION ALL SELECT w.path, w.start, e.parent, w.depth + 1, list_append(w.seen, e.parent), true FROM walk w JOIN ext e ON e.path = w.path AND e.child = w.cur WHERE e.parent IS NOT NULL AND e.parent NOT IN ('Object', 'object') AND NOT list_contains(w.seen, e.parent)),
 depths AS (SELECT project, path, language, child AS class_name, CAST((SELECT max(depth) FROM walk w WHERE w.path = ext.path AND w.start = ext.child) AS INTEGER) AS depth FROM ext)"""
add("J12_inheritance_depth", lambda s, d: g.inheritance_depth(st.inheritance_edges(corpus(s, d))), FILES.replace("WITH", "WITH RECURSIVE") + ", " + _EXT + _WALK + " SELECT * FROM depths")
add("J12_inheritance_summary", lambda s, d: g.inheritance_summary(g.inheritance_depth(st.inheritance_edges(corpus(s, d)))),
    FILES.replace("WITH", "WITH RECURSIVE") + ", " + _EXT + _WALK + " SELECT project, path, max(depth) AS max_depth, CAST(floor(avg(depth) + 0.5) AS INTEGER) AS average_depth, count(*) AS classes FROM depths GROUP BY project, path")
_IMP = [r"(?m)^\s*from\s+([\w.]+)\s+import\b", r"(?m)^\s*import\s+([\w.]+)", r"\bfrom\s+['\"]([^'\"]+)['\"]", r"\brequire\s*\(\s*['\"]([^'\"]+)['\"]\s*\)"]
_IMPORTS = "imps AS (SELECT DISTINCT project, module, imported FROM (SELECT project, regexp_extract(path, '([^/]+?)(\\.[^./]*)?$', 1) AS module, regexp_split_to_array(regexp_replace(unnest(list_concat(" + ", ".join(f"regexp_extract_all(text, {q(p)}, 1)" for p in _IMP) + ")), '\\.(js|ts|py)$', ''), '[/.]')[-1] AS imported FROM files) WHERE imported <> '' AND imported <> module)"
add("J11_import_edges", lambda s, d: st.import_edges(corpus(s, d)), FILES + ", " + _IMPORTS + " SELECT * FROM imps")
add("J11_module_dependents", lambda s, d: g.module_dependents(st.import_edges(corpus(s, d))),
    FILES + ", " + _IMPORTS + ", o AS (SELECT project, module AS name, count(DISTINCT imported) AS dependencies FROM imps GROUP BY 1, 2), b AS (SELECT project, imported AS name, count(DISTINCT module) AS dependents FROM imps GROUP BY 1, 2) SELECT coalesce(o.project, b.project) AS project, coalesce(o.name, b.name) AS name, coalesce(dependencies, 0) AS dependencies, coalesce(dependents, 0) AS dependents FROM o FULL JOIN b ON o.project = b.project AND o.name = b.name")


def module_edges(s, d):
    """Import edges of a module per customer: chains, tails and cycles in groups of 30."""
    block, own = "cast(floor(c_custkey / 30) as bigint)", "c_custkey % 30"
    return read(s, d, "customer").select(
        F.expr(f"concat('p', {block})").alias("project"), F.expr(f"concat('m', {own})").alias("module"),
        F.explode(F.expr(f"CASE WHEN c_custkey % 5 = 0 THEN array(concat('m', ({own} * 3 + 1) % 30), concat('m', ({own} + 4) % 30)) WHEN c_custkey % 7 = 0 THEN array(concat('x', c_custkey)) ELSE array(concat('m', ({own} * 3 + 1 + {block}) % 30)) END")).alias("imported"))


_ME = """me AS (SELECT 'p' || (c_custkey // 30) AS project, 'm' || (c_custkey % 30) AS module, unnest(CASE WHEN c_custkey % 5 = 0 THEN ['m' || ((c_custkey % 30 * 3 + 1) % 30), 'm' || ((c_custkey % 30 + 4) % 30)] WHEN c_custkey % 7 = 0 THEN ['x' || c_custkey] ELSE ['m' || ((c_custkey % 30 * 3 + 1 + c_custkey // 30) % 30)] END) AS imported FROM customer)"""
add("J11_circular_modules", lambda s, d: g.circular_modules(module_edges(s, d)),
    "WITH RECURSIVE " + _ME + """, e AS (SELECT DISTINCT project, module AS a, imported AS b FROM me WHERE module <> imported), reach AS (SELECT project, a, b FROM e UNION SELECT r.project, r.a, e.b FROM reach r JOIN e ON e.project = r.project AND e.a = r.b),
 same AS (SELECT r.project, r.a, r.b FROM reach r JOIN reach x ON x.project = r.project AND x.a = r.b AND x.b = r.a), grp AS (SELECT project, a AS module, min(b) AS cycle FROM same GROUP BY project, a)
 SELECT project, module, cycle, count(*) OVER (PARTITION BY project, cycle) AS size FROM grp""")
_SYM = "sym AS (SELECT DISTINCT project, path, language, kind, name FROM (SELECT project, path, language, 'function' AS kind, unnest(list_concat(" + ", ".join(f"regexp_extract_all(text, {q(p)}, 1)" for p in (r"\bdef\s+(\w+)", r"\bfunction\s+(\w+)", r"\bfunc\s+(\w+)", r"\bfn\s+(\w+)")) + ")) AS name FROM files UNION ALL SELECT project, path, language, 'class', unnest(regexp_extract_all(text, '\\bclass\\s+(\\w+)', 1)) FROM files UNION ALL SELECT project, path, language, 'import', unnest(list_concat(" + ", ".join(f"regexp_extract_all(text, {q(p)}, 1)" for p in _IMP) + ")) FROM files))"
add("M7_symbols", lambda s, d: st.symbols(corpus(s, d)), FILES + ", " + _SYM + " SELECT * FROM sym")
add("J9_reference_counts", lambda s, d: g.reference_counts(st.symbols(corpus(s, d)), st.word_totals(corpus(s, d))),
    FILES + ", " + _SYM + ", words AS (SELECT path, name, count(*) AS uses FROM (SELECT path, unnest(regexp_extract_all(text, '\\w+')) AS name FROM files) GROUP BY path, name), df AS (SELECT name, count(DISTINCT path) AS defined_in FROM sym WHERE kind IN ('function', 'class') GROUP BY name) SELECT name, defined_in, count(*) AS used_in, CAST(sum(uses) AS BIGINT) AS uses FROM df JOIN words USING (name) GROUP BY name, defined_in")
_REPORT = CORPUS_UNITS + METRICS_SQL + REPORT_SQL
_WIDE = files_cte(*WIDE)


def _measured(df, *names):
    return df.withColumns({n: F.round(n, 4) for n in names})


add("M2_code_units", lambda s, d: st.code_units(corpus(s, d)), CORPUS_UNITS + " SELECT * FROM units")
add("F7_function_metrics", lambda s, d: _measured(st.function_metrics(st.code_units(corpus(s, d))), "volume", "maintainability_index"),
    CORPUS_UNITS + METRICS_SQL + " SELECT * EXCLUDE p REPLACE (round(volume, 4) AS volume, round(maintainability_index, 4) AS maintainability_index) FROM fm")
add("F8_class_metrics", lambda s, d: st.class_metrics(st.code_units(corpus(s, d))), CORPUS_UNITS + METRICS_SQL + " SELECT * FROM cm")
add("G12_E8_complexity_report", lambda s, d: st.complexity_report(corpus(s, d)), _REPORT + " SELECT * FROM report")
add("G13_compare_complexity", lambda s, d: st.compare_complexity(st.complexity_report(corpus(s, d)), corpus(s, d).select(F.regexp_replace("path", "9", "x").alias("path"))),
    _REPORT + " SELECT p.path, r.* EXCLUDE path, CASE WHEN r.language IS NULL THEN 'File not found: ' || p.path END AS error FROM (SELECT replace(path, '9', 'x') AS path FROM files) p LEFT JOIN report r ON r.path = p.path")
add("T3_complex_functions", lambda s, d: _measured(st.complex_functions(st.function_metrics(st.code_units(wide_corpus(s, d)))), "volume", "maintainability_index"),
    units_sql(_WIDE) + METRICS_SQL + " SELECT * EXCLUDE p REPLACE (round(volume, 4) AS volume, round(maintainability_index, 4) AS maintainability_index) FROM fm WHERE risk_level IN ('high', 'critical') ORDER BY cyclomatic DESC, path, line, name LIMIT 10")
add("F21_complexity_advice", lambda s, d: st.complexity_recommendations(st.complexity_report(corpus(s, d))),
    _REPORT + " " + " UNION ALL ".join(f"SELECT project, path, {q(p)} AS priority, {q(c)} AS category, {m} AS message FROM report WHERE {w}" for w, p, c, m in [
        ("cyclomatic > 20", "high", "complexity", "'Overall code complexity is high. Consider refactoring complex functions.'"),
        ("complex_functions > 0", "high", "refactoring", "complex_functions || ' function(s) have high cyclomatic complexity. Consider breaking them into smaller functions.'"),
        ("max_nesting_depth > 5", "medium", "readability", "'Deep nesting detected. Consider using early returns or extracting methods.'"),
        ("large_classes > 0", "medium", "design", "large_classes || ' class(es) have too many methods. Consider applying Single Responsibility Principle.'"),
        ("low_index_functions > 0", "high", "maintainability", "low_index_functions || ' function(s) have low maintainability index. Refactoring recommended.'")]))
add("W2_long_functions", lambda s, d: st.long_functions(wide_corpus(s, d)).drop("sub_category", "suggestion", "match", "auto_fixable", "rule_order"),
    f"WITH {_WIDE}, {LONGS} SELECT * FROM longs")
add("E1_project_findings", lambda s, d: project_findings(corpus(s, d)).groupBy("project", "rule", "severity").agg(F.count("*").alias("findings")),
    PROJECT_SQL + "SELECT project, rule, severity, count(*) AS findings FROM found GROUP BY project, rule, severity")
_BODY_RULES = " UNION ALL ".join(
    f"SELECT project, path, {q(rule)} AS rule, {q(severity)} AS severity, {q(message)} AS message, line FROM units WHERE language = 'python' AND kind = '{kind}' AND regexp_matches(name, {q(name)})"
    + (f" AND regexp_matches(body, {q(must)})" if must else "") + f" AND NOT regexp_matches(body, {q(lacks)})"
    for rule, kind, severity, name, must, lacks, message, _ in extra.COMPLIANCE_BODIES)
add("RS19_compliance", lambda s, d: compliance(s, d),
    hits_sql(extra.COMPLIANCE_TEXT, files_cte(), ", " + UNITS_SQL) + "SELECT project, path, rule, severity, message, line FROM findings UNION ALL " + _BODY_RULES)


def compliance(s, d):
    from lintlake.plans.analysis import compliance_findings
    return compliance_findings(corpus(s, d))


_K = 3
_DUP = LINES + f""", kept AS (SELECT project, path, pos, regexp_replace(trim(l), '\\s+', ' ', 'g') AS l FROM lines WHERE NOT regexp_matches(l, '^\\s*$')), blocks AS (SELECT project, path, pos, l || chr(10) || lead(l, 1) OVER w || chr(10) || lead(l, 2) OVER w AS b FROM kept WINDOW w AS (PARTITION BY path ORDER BY pos))
 SELECT md5(b) AS block, count(*) AS copies, count(DISTINCT project || '/' || path) AS files FROM blocks WHERE b IS NOT NULL GROUP BY b HAVING count(*) > 1"""
add("D3_duplicate_blocks", lambda s, d: duplicate_blocks(corpus(s, d), _K), _DUP)

add("RS10_repeated_text", lambda s, d: repeated_text(corpus(s, d)),
    "WITH " + files_cte() + repeats_sql() + ' SELECT project, path, language, line, "column" FROM repeats')

# ---- rewrites --------------------------------------------------------------
_DU = {r"for (\w+) in (.*):\n\s+(\[\w+\])\.append\(\1\)"}


def _rewrite_sql(rules, where):
    steps, text = [], "text"
    sql = "SELECT project, path, text, text AS t0 FROM files WHERE " + where
    counts = []
    for i, (name, p, r, _) in enumerate(rules):
        repl = r.replace("\\", "\\\\")
        for k in (1, 2, 3):
            repl = repl.replace(f"${k}", f"\\{k}")
        if p in _DU:
            sql = f"SELECT *, t{i} AS t{i + 1} FROM ({sql})"
            continue
        sql = f"SELECT *, regexp_replace(t{i}, {q(p)}, {q(repl)}, 'g') AS t{i + 1} FROM ({sql})"
        counts.append((name, f"len(regexp_extract_all(t{i}, {q(p)}))"))
    return sql, counts


_RSQL, _RC = _rewrite_sql(rw.PYTHON_REWRITES, "language = 'python'")
_RN = len(rw.PYTHON_REWRITES)


def _rewritten(s, d):
    return rw.apply_rewrites(corpus(s, d).where("language = 'python'"), rw.PYTHON_REWRITES)


add("R1_rewrites", lambda s, d: _rewritten(s, d).where("text <> fixed").select("project", "path", "fixed"), FILES + f", r AS ({_RSQL}) SELECT project, path, t{_RN} AS fixed FROM r WHERE t{_RN} <> text")
_UN = " UNION ALL ".join(f"SELECT project, path, {q(n)} AS rule, CAST({c} AS INTEGER) AS count FROM r WHERE {c} > 0" for n, c in _RC)
add("R1_rewrite_counts", lambda s, d: rw.rewrite_counts(_rewritten(s, d)), FILES + f", r AS ({_RSQL}) {_UN}")
add("G37_E11_rewrite_report", lambda s, d: rw.rewrite_report(_rewritten(s, d)),
    FILES + f", r AS ({_RSQL}) SELECT project, count(*) AS files_scanned, count(*) FILTER (WHERE t{_RN} <> text) AS files_modified, CAST(sum(CASE WHEN t{_RN} <> text THEN {' + '.join(c for _, c in _RC)} ELSE 0 END) AS BIGINT) AS issues_fixed, CAST(2 * sum(CASE WHEN t{_RN} <> text THEN {' + '.join(c for _, c in _RC)} ELSE 0 END) AS BIGINT) AS time_saved_minutes FROM r GROUP BY project")
# The rule stated anew: comments, blank lines and lines that open a block stay; others get a space after a colon, quotes around
# metavariables, around pattern values with a $ and around regex values, and a closing quote where one is open.
_SKIP = r"(regexp_matches(l, '^\s*(#|$)') OR regexp_matches(l, '[|>]\s*$'))"


def _quote_sql(key, test):
    value = rf"regexp_replace(regexp_extract(l, '{key}:\s*(.+)', 1), '^ +| +$', '', 'g')"
    return (f"CASE WHEN contains(l, '{key}:') AND {test} AND NOT contains(l, chr(34)) AND NOT contains(l, chr(39)) AND {value} <> '' "
            f"THEN replace(l, '{key}: ' || {value}, '{key}: ' || chr(34) || {value} || chr(34)) ELSE l END")


_STEPS = [
    r"regexp_replace(l, ':([^:\s\n" + '"' + r"/])', ': \1', 'g')", r"regexp_replace(l, 'metavariable:\s*(\$?\w+)', 'metavariable: " + '"' + r"\1" + '"' + "', 'g')",
    _quote_sql("pattern", "contains(l, '$')"), _quote_sql("regex", "true"),
    r"CASE WHEN (length(l) - length(replace(l, chr(34), ''))) % 2 = 1 THEN regexp_replace(l, '\s+$', '') || chr(34) ELSE l END",
]
_YAML = "SELECT project, path, text, pos, b, b AS l FROM (SELECT project, path, text, unnest(string_split(text, chr(10))) AS b, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM files)"
for _step in _STEPS:
    _YAML = f"SELECT project, path, text, pos, b, CASE WHEN {_SKIP} THEN l ELSE {_step} END AS l FROM ({_YAML})"
add("R4_yaml_repairs", lambda s, d: rw.repair_yaml(corpus(s, d)).where("text <> fixed").select("project", "path", "fixed"),
    FILES + f" SELECT project, path, string_agg(l, chr(10) ORDER BY pos) AS fixed FROM ({_YAML}) GROUP BY project, path, text HAVING string_agg(l, chr(10) ORDER BY pos) <> text")
add("R3_line_changes", lambda s, d: rw.line_changes(rw.repair_yaml(corpus(s, d))),
    FILES + f" SELECT project, path, CAST(pos AS INTEGER) AS line, b AS before, l AS after FROM ({_YAML}) WHERE b <> l")
add("R3_unified_diffs", lambda s, d: rw.unified_diffs(rw.repair_yaml(corpus(s, d))))
_CRYPTO = "replace(replace(text, 'hashlib.md5(', 'hashlib.sha256('), 'hashlib.sha1(', 'hashlib.sha256(')"
add("R2_weak_crypto", lambda s, d: rw.fix_weak_crypto(corpus(s, d)).select("project", "path", F.md5("text").alias("hash")), FILES + f" SELECT project, path, md5({_CRYPTO}) AS hash FROM files")
_BX = r"(\s+)except\s*:\s*\n(\s+)(pass|continue|break)"
add("R2_bare_excepts", lambda s, d: rw.fix_bare_excepts(corpus(s, d)).select("project", "path", F.md5("text").alias("hash")),
    FILES + f" SELECT project, path, md5(regexp_replace(text, {q(_BX)}, '\\1except Exception as e:' || chr(10) || '\\2import logging' || chr(10) || '\\2logging.error(f\"Exception: {{e}}\")' || chr(10) || '\\2\\3', 'g')) AS hash FROM files")
_EXCEPTS = "regexp_replace({t}, " + q(_BX) + ", '\\1except Exception as e:' || chr(10) || '\\2import logging' || chr(10) || '\\2logging.error(f\"Exception: {{e}}\")' || chr(10) || '\\2\\3', 'g')"
# Quoted values hold no quote, so equal quotes at both ends are two branches. No Python file of these tables opens a resource to close it.
_QUOTED = """(?:"[^"']{%d,}"|'[^"']{%d,}')"""
_SECRETS = [(r"(?i)(\bpassword\b\s*=\s*)" + _QUOTED % (4, 4), r'\1os.environ.get("PASSWORD")'), (r"(?i)(\b(?:api_key|apikey|api_secret)\b\s*=\s*)" + _QUOTED % (8, 8), r'\1os.environ.get("API_KEY")'),
            (r"(?i)(\b(?:secret|token)\b\s*=\s*)" + _QUOTED % (8, 8), r'\1os.environ.get("SECRET")'), (r"(?i)(\b[A-Z_]*(SECRET|KEY|PASSWORD)[A-Z_]*\s*=\s*)" + _QUOTED % (4, 4), r'\1os.environ.get("\2")')]


def _import_sql(text, module, wanted):
    return f"CASE WHEN {wanted} AND NOT contains({text}, 'import {module}') THEN 'import {module}' || chr(10) || {text} ELSE {text} END"


def _fixes_sql():
    """All targeted fixers, one layer a step."""
    layers = [f"p{i} AS (SELECT *, regexp_replace(p{i - 1}, {q('(?m)' + p)}, {q(r.replace('$', chr(92)))}, 'g') AS p{i} FROM p{i - 1})" for i, (p, r) in enumerate(rw.PRINT_FIXES, 1)]
    layers.append(f"s0 AS (SELECT *, {_import_sql('p3', 'logging', 'contains(p3, ' + q('logging') + ')')} AS s0 FROM p3)")
    layers += [f"s{i} AS (SELECT *, regexp_matches(s{i - 1}, {q(p)}) AS h{i}, regexp_replace(s{i - 1}, {q(p)}, {q(r)}, 'g') AS s{i} FROM s{i - 1})" for i, (p, r) in enumerate(_SECRETS, 1)]
    layers.append(f"t2 AS (SELECT *, {_import_sql('s4', 'os', '(h1 OR h2 OR h3 OR h4)')} AS t2 FROM s4), t3 AS (SELECT *, {_EXCEPTS.format(t='t2')} AS t3 FROM t2), t4 AS (SELECT *, {_CRYPTO.replace('(text', '(t3')} AS t4 FROM t3)")
    sql = FILES + ", p0 AS (SELECT project, path, text AS t0, text AS p0 FROM files WHERE language = 'python'), " + ", ".join(layers)
    named = ["CASE WHEN s0 <> t0 THEN 'print_to_logging' END", "CASE WHEN t2 <> s0 THEN 'hardcoded_secrets' END", "CASE WHEN t3 <> t2 THEN 'bare_except' END", "CASE WHEN t4 <> t3 THEN 'weak_crypto' END"]
    return sql + f" SELECT project, path, t4 AS text, concat_ws(',', {', '.join(named)}) AS applied FROM t4 WHERE concat_ws(',', {', '.join(named)}) <> ''"


add("R2_targeted_fixes", lambda s, d: rw.fix_all(corpus(s, d).where("language = 'python'")).where("size(applied) > 0").select("project", "path", "text", F.array_join("applied", ",").alias("applied")), _fixes_sql())
add("R5_rename_symbol", lambda s, d: rw.rename_symbol(corpus(s, d), "helper7", "assist7").select("project", "path", "fixed"),
    FILES + ", " + _SYM + " SELECT DISTINCT project, path, regexp_replace(text, '\\bhelper7\\b', 'assist7', 'g') AS fixed FROM files JOIN (SELECT DISTINCT project, path FROM sym WHERE name = 'helper7') USING (project, path)")

# ---- diagnostics -----------------------------------------------------------
add("M1_M3_M4_parser_diagnostics", lambda s, d: dx.parser_diagnostics(corpus(s, d).unionByName(manifest_files(s, d).select("project", "path", F.lit("config").alias("language"), "text"))))
_heads = {".c": 0, ".cs": 2, ".kt": 3, ".swift": 4, ".cpp": 1}


def _brace_sql():
    parts = []
    for ending, i in _heads.items():
        _, head, source, message, unless = dx.BRACE_FALLBACKS[i]
        no = f" AND NOT regexp_matches(l, {q(unless)})" if unless else ""
        code = source.upper().replace("-", "_") + "_ERROR"
        parts.append(f"SELECT project, path, {q(code)} AS code, 'error' AS severity, {q(message)} AS message, CAST(arg_min(pos, pos) AS INTEGER) AS line, CAST(arg_min(CASE WHEN contains(l, '{{') THEN strpos(l, '{{') ELSE greatest(1, length(l)) END, pos) AS INTEGER) AS \"column\", '{source}' AS source FROM lines WHERE ends_with(path, '{ending}') AND regexp_matches(l, {q(head)}) AND strpos(l, '(') > 0 AND strpos(substr(l, strpos(l, '(')), '{{') > 0 AND (strpos(l, ')') = 0 OR strpos(l, ')') > strpos(l, '(') - 1 + strpos(substr(l, strpos(l, '(')), '{{')){no} GROUP BY project, path")
    return " UNION ALL ".join(parts)


add("M5_W9_brace_diagnostics", lambda s, d: dx.brace_diagnostics(corpus(s, d)), LINES + " " + _brace_sql())
add("M10_yaml_fallback", lambda s, d: dx.yaml_fallback(corpus(s, d)),
    LINES + f" SELECT project, path, 'YAML_FALLBACK_ERROR' AS code, 'error' AS severity, {q(dx.YAML_MESSAGE)} AS message, CAST(min(pos) AS INTEGER) AS line, CAST(arg_min(CASE WHEN contains(l, '{{') THEN strpos(l, '{{') ELSE greatest(1, length(l)) END, pos) AS INTEGER) AS \"column\", 'yaml-fallback' AS source FROM lines WHERE ends_with(path, '.yaml') AND (regexp_matches(l, '^\\s*:\\s*\\S') OR regexp_matches(l, '^\\s*-\\s*:\\s*\\S')) GROUP BY project, path")
_sh = lambda o, c, m: f"SELECT project, path, 'SHELL_FALLBACK_ERROR' AS code, 'error' AS severity, {q(m)} AS message, CAST(min(pos) FILTER (WHERE regexp_matches(l, {q(o)})) AS INTEGER) AS line, 1 AS \"column\", 'shell-fallback' AS source FROM lines WHERE ends_with(path, '.sh') GROUP BY project, path HAVING bool_or(regexp_matches(l, {q(o)})) AND NOT bool_or(regexp_matches(l, {q(c)}))"
add("M6_shell_diagnostics", lambda s, d: dx.shell_diagnostics(corpus(s, d)),
    LINES + " " + _sh(r"^\s*if\b", r"^\s*fi\b", 'Possible shell syntax error: "if" block appears to be missing closing "fi".') + " UNION ALL " + _sh(r"^\s*(for|while|until)\b", r"^\s*done\b", 'Possible shell syntax error: loop appears to be missing closing "done".'))
add("M9_python_checks", lambda s, d: dx.python_checks(corpus(s, d)))
add("G34_E10_check_statistics", lambda s, d: dx.check_statistics(corpus(s, d), dx.python_checks(corpus(s, d)), t.deep_check(corpus(s, d))))
add("E9_symbol_overview", lambda s, d: st.python_symbols(corpus(s, d)))
