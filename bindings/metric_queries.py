"""File metrics, risk and project-wide counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.corpus import corpus, document_files, files_cte, q, read
from bindings.rule_sql import nesting_sql
from lintlake.functions.brackets import COGNITIVE_HITS, COGNITIVE_OPENERS
from lintlake.operators import metrics as m

FILES = "WITH " + files_cte()
KEYS = "project, path, language"


def count_sql(pattern: str, text: str = "text") -> str:
    return f"len(regexp_extract_all({text}, {q(pattern)}))"


def count_all_sql(patterns, text: str = "text") -> str:
    return "(" + " + ".join(count_sql(p, text) for p in patterns) + ")"


def sub_sql(needle: str, text: str = "text") -> str:
    return f"((length({text}) - length(replace({text}, {q(needle)}, ''))) // {len(needle)})"


LINES_SQL = f""", lines AS (SELECT {KEYS}, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM files)"""

QUERIES, ORACLES = {}, {}

QUERIES["G8_line_metrics"] = lambda s, d: m.line_metrics(corpus(s, d))
ORACLES["G8_line_metrics"] = FILES + LINES_SQL + f"""
SELECT {KEYS}, count(*) AS lines_of_code,
 count(*) FILTER (WHERE regexp_matches(l, '^\\s*(//|#|/\\*|\\*|--)')) AS comment_lines,
 count(*) FILTER (WHERE regexp_matches(l, '^\\s*$')) AS blank_lines,
 count(*) FILTER (WHERE NOT regexp_matches(l, '^\\s*(//|#|/\\*|\\*|--)') AND NOT regexp_matches(l, '^\\s*$')) AS code_lines
FROM lines GROUP BY {KEYS}"""

QUERIES["G9_element_counts"] = lambda s, d: m.element_counts(corpus(s, d))
ORACLES["G9_element_counts"] = FILES + f"""
SELECT {KEYS}, {count_all_sql(m.FUNCTION_PATTERNS)} AS functions, {count_all_sql(m.CLASS_PATTERNS)} AS classes,
 1 + {count_all_sql(m.BRANCH_PATTERNS)} AS estimated_cyclomatic FROM files"""

CYCLOMATIC_SQL = "1 + " + count_all_sql(m.DECISIONS) + " + CASE language " + " ".join(
    f"WHEN '{k}' THEN {count_all_sql(v)}" for k, v in m.LANGUAGE_DECISIONS.items()) + " ELSE 0 END"
QUERIES["G10_cyclomatic"] = lambda s, d: corpus(s, d).select(
    "project", "path", "language", m.cyclomatic_complexity("text", "language").alias("cyclomatic"))
ORACLES["G10_cyclomatic"] = FILES + f" SELECT {KEYS}, {CYCLOMATIC_SQL} AS cyclomatic FROM files"

_H = ["volume", "difficulty", "effort", "time_seconds", "estimated_bugs", "maintainability_index"]


def _rounded(df, names, digits=4):
    for n in names:
        df = df.withColumn(n, F.round(n, digits))
    return df


QUERIES["G11_halstead"] = lambda s, d: _rounded(m.halstead_metrics(corpus(s, d)), _H)
ORACLES["G11_halstead"] = FILES + f""", c AS (SELECT {KEYS},
 len(list_distinct(regexp_extract_all(text, '[+\\-*/%=<>!&|^~?:;,.()\\[\\]{{}}]'))) AS n1,
 len(list_distinct(regexp_extract_all(text, '\\w+'))) AS n2,
 len(regexp_extract_all(text, '[+\\-*/%=<>!&|^~?:;,.()\\[\\]{{}}]')) AS total_operators,
 len(regexp_extract_all(text, '\\w+')) AS total_operands FROM files),
 v AS (SELECT *, n1 + n2 AS vocabulary, total_operators + total_operands AS length,
 (total_operators + total_operands) * log2(greatest(n1 + n2, 1)) AS volume0,
 (n1 / 2.0) * (total_operands / greatest(n2, 1)) AS difficulty0 FROM c)
SELECT {KEYS}, n1, n2, total_operators, total_operands, vocabulary, length, round(CAST(volume0 AS DOUBLE), 4) AS volume, round(difficulty0, 4) AS difficulty,
 round(volume0 * difficulty0, 4) AS effort, round(volume0 * difficulty0 / 18, 4) AS time_seconds, round(volume0 / 3000, 4) AS estimated_bugs,
 round(CASE WHEN volume0 <= 0 THEN 100.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(100.0::DOUBLE, 171 - 5.2 * ln(volume0) - 0.23 * difficulty0 - 16.2 * ln(greatest(length, 1)))) END, 4) AS maintainability_index FROM v"""

_TOKENS = r"""[{(\[\])}\n]"""
QUERIES["W4_nesting_depth"] = lambda s, d: m.nesting_depth(corpus(s, d))
ORACLES["W4_nesting_depth"] = FILES + f""", t AS (SELECT {KEYS}, unnest(list_concat([''], regexp_extract_all(text, {q(_TOKENS)}))) AS tok, generate_subscripts(list_concat([''], regexp_extract_all(text, {q(_TOKENS)})), 1) AS pos FROM files),
 s AS (SELECT *, sum(CASE WHEN tok IN ('{{','(','[') THEN 1 WHEN tok IN ('}}',')',']') THEN -1 ELSE 0 END) OVER w AS run, 1 + sum(CASE WHEN tok = chr(10) THEN 1 ELSE 0 END) OVER w AS line FROM t WINDOW w AS (PARTITION BY path ORDER BY pos)),
 f AS (SELECT *, run - least(0, min(run) OVER (PARTITION BY path ORDER BY pos)) AS level FROM s)
SELECT {KEYS}, CAST(max(level) AS INTEGER) AS max_depth, CAST(CASE WHEN max(level) = 0 THEN 1 ELSE arg_min(line, (-level, pos)) END AS INTEGER) AS max_depth_line, CAST((max(level) + 1) // 2 AS INTEGER) AS average_depth FROM f GROUP BY {KEYS}"""

QUERIES["W1_literal_aware_nesting"] = lambda s, d: m.literal_aware_nesting(corpus(s, d))
ORACLES["W1_literal_aware_nesting"] = FILES + f" SELECT *, depth > 4 AS too_deep FROM ({nesting_sql()})"

_hits = " + ".join(f"CAST(regexp_matches(l, {q(p)}) AS INTEGER)" for p in COGNITIVE_HITS)
_ups = " + ".join(f"CAST(regexp_matches(l, {q(p)}) AS INTEGER)" for p in COGNITIVE_OPENERS)
QUERIES["W5_cognitive"] = lambda s, d: m.complexity_scores(corpus(s, d)).drop("cyclomatic")
ORACLES["W5_cognitive"] = FILES + LINES_SQL + f""", f AS (SELECT {KEYS}, pos, {_hits} AS hits, {_ups} AS up, length(replace(l, '}}', '')) - length(replace(l, '{{', '')) AS net FROM lines),
 s AS (SELECT *, sum(up + least(net, 0)) OVER (PARTITION BY path ORDER BY pos) AS run FROM f),
 g AS (SELECT *, run - least(0, min(run) OVER (PARTITION BY path ORDER BY pos)) AS level FROM s),
 h AS (SELECT *, coalesce(lag(level) OVER (PARTITION BY path ORDER BY pos), 0) AS before FROM g)
SELECT {KEYS}, CAST(sum(hits * (1 + before)) AS BIGINT) AS cognitive FROM h GROUP BY {KEYS}"""

RISK_METRICS_SQL = f"""SELECT {KEYS}, len(ls) AS loc, 1 + {' + '.join(sub_sql(f' {w} ') for w in m.RISK_WORDS)} AS complexity,
 len(list_filter(ls, lambda x: regexp_matches(x, '^\\s*(#|//)'))) / len(ls) AS comments_ratio,
 {sub_sql('import ')} + {sub_sql('from ')} AS imports_count, {sub_sql('def ')} + {sub_sql('function ')} AS functions_count, {sub_sql('class ')} AS classes_count,
 list_max(list_transform(ls, lambda x: length(x))) AS max_line_length, 1.0::DOUBLE - len(list_distinct(ls)) / len(ls) AS duplicate_ratio
 FROM (SELECT *, string_split(text, chr(10)) AS ls FROM files)"""
QUERIES["G21_risk_metrics"] = lambda s, d: _rounded(m.risk_metrics(corpus(s, d)), ["comments_ratio", "duplicate_ratio"], 6)
ORACLES["G21_risk_metrics"] = FILES + f", m AS ({RISK_METRICS_SQL}) SELECT * REPLACE (round(comments_ratio, 6) AS comments_ratio, round(duplicate_ratio, 6) AS duplicate_ratio) FROM m"


def _list_text(tests, values):
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {t} THEN {q(v)} END" for t, v in zip(tests, values)) + "], lambda x: x IS NOT NULL), chr(10))"


_risk_tests = ["complexity > 20", "comments_ratio < 0.1", "loc > 500", "duplicate_ratio > 0.3", "imports_count > 20"]
_PREDICT = f"""SELECT {KEYS}, risk_score, CASE WHEN risk_score >= 75 THEN 'CRITICAL' WHEN risk_score >= 50 THEN 'HIGH' WHEN risk_score >= 25 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
 {_list_text(_risk_tests, [a for a, _ in m.RISK_TEXT])} AS predicted_issues,
 CASE WHEN NOT ({' OR '.join(_risk_tests)}) THEN {q(m.RISK_FINE)} ELSE {_list_text(_risk_tests, [b for _, b in m.RISK_TEXT])} END AS recommendation, 0.85::DOUBLE AS confidence
 FROM (SELECT *, CAST(least(100, CASE WHEN complexity > 20 THEN 30 WHEN complexity > 10 THEN 15 ELSE 0 END + CASE WHEN comments_ratio < 0.1 THEN 20 ELSE 0 END + CASE WHEN loc > 500 THEN 15 ELSE 0 END + CASE WHEN imports_count > 20 THEN 10 ELSE 0 END + CASE WHEN duplicate_ratio > 0.3 THEN 25 ELSE 0 END) AS DOUBLE) AS risk_score FROM m)"""
QUERIES["G22_risk_score"] = lambda s, d: m.risk_prediction(m.risk_metrics(corpus(s, d)))
ORACLES["G22_risk_score"] = FILES + f", m AS ({RISK_METRICS_SQL}) {_PREDICT}"
QUERIES["P8_T8_risky_files"] = lambda s, d: m.risky_files(m.risk_prediction(m.risk_metrics(corpus(s, d)))).select(
    "project", "path", "risk_score", "risk_level")
ORACLES["P8_T8_risky_files"] = FILES + f", m AS ({RISK_METRICS_SQL}), p AS ({_PREDICT}) SELECT project, path, risk_score, risk_level FROM p WHERE risk_level IN ('HIGH', 'CRITICAL') ORDER BY risk_score DESC, path"

_debt_tests = ["complexity > 10", "code_smells > 0", "bugs > 0", "vulnerabilities > 0"]


def _subs(*needles):
    return " + ".join(sub_sql(n) for n in needles)


QUERIES["G23_technical_debt"] = lambda s, d: m.technical_debt(corpus(s, d))
ORACLES["G23_technical_debt"] = FILES + f""", c AS (SELECT {KEYS}, len(string_split(text, chr(10))) AS loc, {_subs('if ', 'for ', 'while ')} AS complexity,
 {_subs('TODO', 'FIXME', 'XXX', 'HACK')} AS code_smells, {_subs('except:', 'eval(', 'exec(')} AS bugs, {_subs('f"SELECT', 'password = "', 'api_key = "')} AS vulnerabilities FROM files),
 h AS (SELECT *, round(CAST(greatest(complexity - 10, 0) * 0.5 + code_smells * 0.25 + bugs + vulnerabilities * 2.0 AS DOUBLE), 2) AS debt_hours FROM c)
SELECT *, round(debt_hours * 100.0::DOUBLE, 2) AS debt_cost_usd, {_list_text(_debt_tests, m.DEBT_PLAN)} AS payback_plan FROM h"""


def _changes(s, d):
    return read(s, d, "conversations").select(
        F.concat(F.lit("conv/"), F.col("conv_id").cast("string")).alias("path"), F.col("text").alias("message"))


QUERIES["G24_change_risk"] = lambda s, d: m.change_risk(_changes(s, d))
_fl = [" OR ".join(f"contains(lower(text), '{w}')" for w in words) for words, *_ in m.CHANGE_FACTORS] + [f"length(text) > {m.LARGE_CHANGE[0]}"]
_pts = [p for _, _, p, _ in m.CHANGE_FACTORS] + [m.LARGE_CHANGE[2]]
_nm = [n for _, n, _, _ in m.CHANGE_FACTORS] + [m.LARGE_CHANGE[1]]
_adv = [a for *_, a in m.CHANGE_FACTORS] + [m.LARGE_CHANGE[3]]
_some = [f"c{i} > 0" for i in range(4)]
ORACLES["G24_change_risk"] = f"""WITH c AS (SELECT 'conv/' || CAST(conv_id AS VARCHAR) AS path, count(*) AS changes, {', '.join(f'count(*) FILTER (WHERE {t}) AS c{i}' for i, t in enumerate(_fl))} FROM conversations GROUP BY conv_id),
 s AS (SELECT *, {' + '.join(f'c{i} * {p}' for i, p in enumerate(_pts))} AS score FROM c)
SELECT path, changes, least(100, score) AS risk_score, CASE WHEN score >= 60 THEN 'HIGH' WHEN score >= 30 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
 replace({_list_text(_some, _nm)}, chr(10), ',') AS risk_factors,
 CASE WHEN NOT ({' OR '.join(_some)}) THEN {q(m.CHANGE_FINE)} ELSE {q(m.CHANGE_HEAD)} || chr(10) || {_list_text(_some, _adv)} END AS recommendation, score >= 30 AS requires_review, score >= 20 AS requires_test FROM s"""

QUERIES["G30_attack_surface"] = lambda s, d: m.attack_surface(corpus(s, d))
ORACLES["G30_attack_surface"] = FILES + f""", c AS (SELECT project, {', '.join(f'CAST(sum({count_sql(p)}) AS BIGINT) AS {n}' for n, p in m.SURFACE.items())} FROM files GROUP BY project)
SELECT *, round(least(10.0::DOUBLE, (public_apis * 0.3::DOUBLE + user_input_points * 0.5::DOUBLE + output_points * 0.2::DOUBLE) / 10), 6) AS attack_surface_score FROM c"""

QUERIES["G31_project_style"] = lambda s, d: m.project_style(corpus(s, d))
ORACLES["G31_project_style"] = FILES + """, n AS (SELECT project, text, regexp_extract_all(text, 'def (\\w+)\\(', 1) AS ns FROM files WHERE language = 'python'),
 c AS (SELECT project, count(*) AS files, CAST(sum(len(list_filter(ns, lambda x: contains(x, '_') AND regexp_matches(x, '[a-z]') AND NOT regexp_matches(x, '[A-Z]')))) AS BIGINT) AS snake_case,
 CAST(sum(len(list_filter(ns, lambda x: regexp_matches(x, '^[a-z]') AND regexp_matches(substr(x, 2), '[A-Z]')))) AS BIGINT) AS camel_case,
 count(*) FILTER (WHERE contains(text, '\"\"\"')) AS with_docstrings, count(*) FILTER (WHERE contains(text, '->')) AS with_type_hints FROM n GROUP BY project)
SELECT *, CASE WHEN snake_case > camel_case THEN 'snake_case' ELSE 'camelCase' END AS naming FROM c"""

QUERIES["G38_project_structure"] = lambda s, d: m.project_structure(corpus(s, d))
ORACLES["G38_project_structure"] = FILES + """, p AS (SELECT project, string_split(path, '/') AS ps, len(string_split(text, chr(10))) AS lines FROM files),
 e AS (SELECT project, lines, ps, unnest(range(1, len(ps))) AS k FROM p)
SELECT project, array_to_string(ps[1:k], '/') AS directory, count(*) AS files, CAST(sum(lines) AS BIGINT) AS lines, CAST(k AS INTEGER) AS level FROM e GROUP BY project, directory, k"""
