"""SQL for the check of rule scans, written from the same fixed patterns.

Each rule becomes one branch with a literal pattern. Where the check engine
lacks a regex feature, the branch states the same hits in another way.
"""

from __future__ import annotations

from bindings.corpus import q
from lintlake.rules.security import REPEAT_RULE

# rule (with engine where needed) -> equivalent pattern without lookaround.
REWRITTEN = {
    r"(?<!\w)(?:[2-9]\d{2,}|\d{4,})(?!\w)": r"\b(?:[2-9]\d{2,}|\d{4,})\b",
    r"(?<!\w)([2-9]\d{2,}|\d{4,})(?!\w)": r"\b(?:[2-9]\d{2,}|\d{4,})\b",
    r"return\s*;[\s\S]*?(?=\n\s*\})": r"return\s*;(?s:.*?)\n\s*\}",
    r"(?:const|let|var)\s+\w+\s*=\s*[^;]+;(?=\W*\z)": r"(?:const|let|var)\s+\w+\s*=\s*[^;]+;\W*\z",
    r"\blet\s+(\w+)\s*=\s*[^;]+;(?:[\s\S]*?)(?!\b\1\s*=)": r"\blet\s+\w+\s*=\s*[^;]+;",
    r"yaml\.load\s*\((?:(?!Loader=)[^)])*+\)": r"yaml\.load\s*\([^)]*\)",
    r"http://(?!localhost|127\.0\.0\.1)": r"http://",
    r"\bundefined\b(?!\s*[=])": r"\bundefined\b",
    r"addEventListener\s*\([^)]*\)(?![\s\S]*removeEventListener)": r"addEventListener\s*\([^)]*\)",
    r"setInterval\s*\([^)]*\)(?![\s\S]*clearInterval)": r"setInterval\s*\([^)]*\)",
    r"requests\.(get|post|put|delete)\s*\([^)]*\)(?![^)]*timeout)": r"requests\.(get|post|put|delete)\s*\([^)]*\)",
    r"yaml\.load\s*\([^)]*\)(?![^)]*Loader)": r"yaml\.load\s*\([^)]*\)",
    r"\bapp\.post\(\s*['\"]/login['\"]\s*,(?!\s*rateLimiter\b)": r"\bapp\.post\(\s*['\"]/login['\"]\s*,",
}
# What must not follow a hit (pattern on the rest of the text), or be inside it.
NOT_AFTER = {
    r"http://(?!localhost|127\.0\.0\.1)": r"(?i)^(localhost|127\.0\.0\.1)",
    r"\bundefined\b(?!\s*[=])": r"^\s*[=]",
    r"addEventListener\s*\([^)]*\)(?![\s\S]*removeEventListener)": r"removeEventListener",
    r"setInterval\s*\([^)]*\)(?![\s\S]*clearInterval)": r"clearInterval",
    r"requests\.(get|post|put|delete)\s*\([^)]*\)(?![^)]*timeout)": r"^[^)]*timeout",
    r"yaml\.load\s*\([^)]*\)(?![^)]*Loader)": r"^[^)]*Loader",
    r"\bapp\.post\(\s*['\"]/login['\"]\s*,(?!\s*rateLimiter\b)": r"^\s*rateLimiter\b",
}
NOT_INSIDE = {r"yaml\.load\s*\((?:(?!Loader=)[^)])*+\)": "Loader="}
ALWAYS_OWN = {"max-line-length"}


_LITERALS = r"""("[^"\\]*(\\[\s\S][^"\\]*)*"?|'[^'\\]*(\\[\s\S][^'\\]*)*'?|`[^`\\]*(\\[\s\S][^`\\]*)*`?|//[^\n]*|/\*([^*]|\*+[^*/])*(\*+/)?|[{(\[\])}\n])"""


def nesting_sql(where: str = "true") -> str:
    """Deepest level outside strings and comments, and the line it is first reached on."""
    tokens = f"list_concat([''], regexp_extract_all(text, {q(_LITERALS)}))"
    return f"""SELECT project, path, language, CAST(greatest(max(level), 0) AS INTEGER) AS depth, CAST(CASE WHEN max(level) <= 0 THEN 1 ELSE arg_min(line, (-level, pos)) END AS INTEGER) AS line FROM (
 SELECT *, sum(CASE WHEN tok IN ('{{','(','[') THEN 1 WHEN tok IN ('}}',')',']') THEN -1 ELSE 0 END) OVER w AS level, 1 + sum(length(plain) - length(replace(plain, chr(10), ''))) OVER w AS line FROM (
  SELECT *, CASE WHEN left(tok, 1) IN ('"', '\'\'', '`') THEN regexp_replace(tok, '\\\\[\\s\\S]', '', 'g') ELSE tok END AS plain FROM (
   SELECT project, path, language, unnest({tokens}) AS tok, generate_subscripts({tokens}, 1) AS pos FROM files WHERE {where})) WINDOW w AS (PARTITION BY path ORDER BY pos)) GROUP BY project, path, language"""


def _languages(rule) -> str:
    wanted = [x for x in rule.languages if not x.startswith("!")]
    unwanted = [x[1:] for x in rule.languages if x.startswith("!")]
    if wanted:
        return "language IN (" + ",".join(q(x) for x in wanted) + ")"
    if unwanted:
        return "language NOT IN (" + ",".join(q(x) for x in unwanted) + ")"
    return "true"


def _pattern(rule) -> str:
    p = REWRITTEN.get(rule.pattern, rule.pattern).replace("++", "+").replace("*+", "*")
    return (f"(?{rule.flags})" if rule.flags else "") + p


def _branch(i, rule) -> str:
    where = _languages(rule)
    if rule.kind == "threshold":
        count = f"len(regexp_extract_all(text, {q(_pattern(rule))}))"
        return f"SELECT project, path, language, {i} AS r, 1 AS line, 1 AS col, '' AS m, {count} AS n FROM files WHERE {where} AND {count} >= {rule.threshold}"
    if rule.kind == "blank_run":
        return f"""SELECT project, path, language, {i}, line, 1, '', NULL FROM (
 SELECT *, b AND lag(b,1,false) OVER w AND lag(b,2,false) OVER w AS third FROM (
  SELECT project, path, language, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS line, regexp_matches(l, '^\\s*$') AS b FROM files WHERE {where}
 ) WINDOW w AS (PARTITION BY path ORDER BY line)) WHERE third"""
    if rule.kind == "nesting":
        return f"SELECT project, path, language, {i}, line, 1, '', depth FROM ({nesting_sql(where)}) WHERE depth >= {rule.threshold}"
    if rule.rule == "max-line-length":
        limit = 120 if "120" in rule.message else 150
        return f"""SELECT project, path, language, {i}, line, {limit + 1}, substr(l, {limit + 1}), NULL FROM (
  SELECT project, path, language, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM files WHERE {where}) WHERE length(l) > {limit}"""
    pattern = q(_pattern(rule))
    keep = "true"
    if rule.pattern in NOT_AFTER:
        keep = f"NOT regexp_matches(rest, {q(NOT_AFTER[rule.pattern])})"
    if rule.pattern in NOT_INSIDE:
        keep = f"NOT contains(m, {q(NOT_INSIDE[rule.pattern])})"
    first = " AND k = 1" if rule.kind == "first" else ""
    return f"""SELECT project, path, language, {i}, line, col, m, NULL FROM (
 SELECT *, length(before) - length(replace(before, chr(10), '')) + 1 AS line, length(list_extract(string_split(before, chr(10)), -1)) + 1 AS col, substr(text, length(before) + length(m) + 1) AS rest FROM (
  SELECT *, list_extract(ms, k) AS m, array_to_string(ss[1:k], '') AS before0, left(text, CAST(list_sum(list_transform(ss[1:k], lambda s: length(s))) + coalesce(list_sum(list_transform(ms[1:k-1], lambda s: length(s))), 0) AS BIGINT)) AS before FROM (
   SELECT *, unnest(range(1, len(ms) + 1)) AS k FROM (
    SELECT project, path, language, text, regexp_extract_all(text, {pattern}) AS ms, string_split_regex(text, {pattern}) AS ss FROM files WHERE {where} AND regexp_matches(text, {pattern})))))
 WHERE {keep}{first}"""


def repeats_sql(where: str = "true") -> str:
    """CTEs up to ``repeats``: (.{50,})\\1 from left to right, without overlaps, the longest at each place.

    Grams of 50 that are equal at a distance n, in a row from lo to last, repeat n characters at the places lo to last - n + 50.
    """
    return f""", wanted AS MATERIALIZED (SELECT project, path, language, text FROM files WHERE {where} AND length(text) >= 100),
grams AS MATERIALIZED (SELECT path, p, hash(substr(text, p, 50)) AS g FROM (SELECT path, text, unnest(range(1, length(text) - 48)) AS p FROM wanted)),
few AS MATERIALIZED (SELECT path, g, p FROM grams SEMI JOIN (SELECT path, g FROM grams GROUP BY ALL HAVING count(*) > 1) USING (path, g)),
apart AS (SELECT a.path, a.p, b.p - a.p AS n FROM few a JOIN few b ON a.path = b.path AND a.g = b.g AND b.p - a.p >= 50),
runs AS (SELECT path, n, min(p) AS lo, max(p) - n + 50 AS hi FROM (SELECT *, p - row_number() OVER (PARTITION BY path, n ORDER BY p) AS i FROM apart) GROUP BY path, n, i),
spans AS MATERIALIZED (SELECT * FROM runs WHERE hi >= lo),
repeats AS (WITH RECURSIVE taken(path, p, n) AS (SELECT path, min(lo), arg_min(n, (lo, -n)) FROM spans GROUP BY path
 UNION ALL SELECT s.path, min(greatest(lo, t.p + 2 * t.n)), arg_min(s.n, (greatest(lo, t.p + 2 * t.n), -s.n)) FROM spans s JOIN taken t ON s.path = t.path AND s.hi >= t.p + 2 * t.n GROUP BY s.path)
 SELECT project, path, language, CAST(len(string_split(left(text, p - 1), chr(10))) AS INTEGER) AS line, CAST(length(string_split(left(text, p - 1), chr(10))[-1]) + 1 AS INTEGER) AS "column" FROM taken JOIN wanted USING (path))"""


def repeats_as_findings(columns: str) -> str:
    """SELECT of ``repeats`` as findings, with the columns listed."""
    r = REPEAT_RULE
    fixed = {"engine": q(r.engine), "rule": q(r.rule), "severity": q(r.severity), "category": q(r.category), "message": q(r.message)}
    return "SELECT " + ", ".join(fixed.get(c, c) for c in columns.split(", ")) + " FROM repeats"


def hits_sql(rules, cte: str, extra: str = "") -> str:
    """``WITH files, hits, findings`` for a list of rules."""
    rules = list(rules)
    branches = "\nUNION ALL\n".join(_branch(i, r) for i, r in enumerate(rules))
    table = ",\n".join(
        "(" + ",".join([str(i), q(r.engine), q(r.rule), q(r.severity), q(r.category), q(r.message),
                        q(r.suggestion) if r.suggestion else "NULL",
                        q(r.sub_category) if r.sub_category else "NULL",
                        "true" if r.auto_fixable else "false",
                        "120" if "120 char" in r.message else "150" if "150 char" in r.message else "0"]) + ")"
        for i, r in enumerate(rules)
    )
    return f"""WITH {cte}, hits(project, path, language, r, line, col, m, n) AS (
{branches}),
rules(r, engine, rule, severity, category, message, suggestion, sub_category, auto_fixable, lim) AS (VALUES {table}),
findings AS (SELECT project, path, language, engine, rule, severity, category,
 replace(replace(replace(message, '{{match}}', m), '{{count}}', coalesce(CAST(n AS VARCHAR), '')), '{{length}}', CAST(length(m) + lim AS VARCHAR)) AS message,
 suggestion, sub_category, auto_fixable, CAST(line AS INTEGER) AS line, CAST(col AS INTEGER) AS "column", r AS rule_order FROM hits JOIN rules USING (r)){extra}
"""
