"""Reports over findings of the corpus, and snapshot comparison over ``lineitem``."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.corpus import WIDE, corpus, document_files, files_cte, q, read, wide_corpus
from bindings.metric_queries import CYCLOMATIC_SQL, count_all_sql
from bindings.rule_sql import hits_sql, repeats_as_findings, repeats_sql
from bindings.unit_sql import LONGS
from lintlake.operators import baseline as b
from lintlake.operators import metrics as m
from lintlake.operators import report as r
from lintlake.operators.scan import dedup_findings, scan_rules
from lintlake.plans.analysis import comprehensive_security, project_findings, quality_findings
from lintlake.rules import quality, review, security
from lintlake.rules.model import rules_table
from lintlake.session import RoundTables
from lintlake.sinks import exports

SCRIPTED = ("javascript", "typescript", "python")
QUERIES, ORACLES = {}, {}


def add(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


SHOWN = ["project", "path", "engine", "rule", "severity", "category", "message", "line", "column"]
SHOWN_SQL = 'project, path, engine, rule, severity, category, message, line, "column"'
_DEDUP = """, firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project, path, rule, line, "column" ORDER BY rule_order) AS k FROM findings) WHERE k = 1)"""

add("RS15_D1_comprehensive_security", lambda s, d: comprehensive_security(corpus(s, d)).select(*SHOWN),
    hits_sql(security.COMPREHENSIVE, files_cte(), _DEDUP + repeats_sql()) + f"SELECT {SHOWN_SQL} FROM firsts UNION ALL " + repeats_as_findings(SHOWN_SQL))
add("RS16_code_review", lambda s, d: scan_rules(corpus(s, d), review.CODE_REVIEW).select(*SHOWN, "suggestion", "auto_fixable"),
    hits_sql(review.CODE_REVIEW, files_cte()) + f"SELECT {SHOWN_SQL}, suggestion, auto_fixable FROM findings")
_BASE = quality.ALL + review.REVIEW + review.LANGUAGE_REVIEW
_ALL = _BASE + security.COMPREHENSIVE
_SCRIPTED = "language IN ('javascript', 'typescript', 'python')"
_PROJECT = repeats_sql(_SCRIPTED) + f""", found AS (SELECT {SHOWN_SQL}, suggestion, auto_fixable FROM findings WHERE rule_order < {len(_BASE)}
 UNION ALL SELECT {SHOWN_SQL}, suggestion, auto_fixable FROM (SELECT *, row_number() OVER (PARTITION BY project, path, rule, line, "column" ORDER BY rule_order) AS k FROM findings WHERE rule_order >= {len(_BASE)} AND {_SCRIPTED}) WHERE k = 1
 UNION ALL {repeats_as_findings(SHOWN_SQL)[:-len(" FROM repeats")]}, NULL, false FROM repeats)"""
PROJECT_SQL = hits_sql(_ALL, files_cte(), _PROJECT)
add("RS17_project_findings", lambda s, d: project_findings(corpus(s, d)).select(*SHOWN), PROJECT_SQL + f"SELECT {SHOWN_SQL} FROM found")

# ---- counts and verdicts ---------------------------------------------------
_BASE_SQL = hits_sql(quality.ALL, files_cte())


def base(s, d):
    return scan_rules(corpus(s, d), quality.ALL)


add("G1_E2_directory_report", lambda s, d: r.directory_report(wide_corpus(s, d), quality_findings(wide_corpus(s, d))),
    hits_sql(quality.ALL, files_cte(*WIDE), ", " + LONGS + """, both_kinds AS (SELECT severity, category, language, rule FROM findings UNION ALL SELECT severity, category, language, rule FROM longs), g AS (SELECT CASE WHEN grouping(severity) = 0 THEN 'severity' WHEN grouping(category) = 0 THEN 'category' WHEN grouping(language) = 0 THEN 'language' WHEN grouping(rule) = 0 THEN 'rule' ELSE 'total' END AS dimension,
 coalesce(severity, category, language, rule, '*') AS key, count(*) AS count FROM both_kinds GROUP BY GROUPING SETS ((severity), (category), (language), (rule), ()))""")
    + "SELECT * FROM g UNION ALL SELECT 'files', 'analyzed', count(*) FROM files")
add("G2_count_by_category", lambda s, d: r.count_by(base(s, d), "category"), _BASE_SQL + "SELECT coalesce(category, 'unknown') AS category, count(*) AS count FROM findings GROUP BY 1")
add("G3_review_summary", lambda s, d: r.review_summary(scan_rules(corpus(s, d), review.CODE_REVIEW)),
    hits_sql(review.CODE_REVIEW, files_cte()) + """SELECT project, path, count(*) AS total_issues, count(*) FILTER (WHERE severity = 'error') AS error_count, count(*) FILTER (WHERE severity = 'warning') AS warning_count,
 count(*) FILTER (WHERE severity = 'info') AS info_count, count(*) FILTER (WHERE severity = 'hint') AS hint_count, count(DISTINCT category) AS categories, count(*) FILTER (WHERE auto_fixable) AS auto_fixable FROM findings GROUP BY project, path""")
# Per-file verdicts: each file stands for a project of its own, so every outcome occurs.
_FACTS = """, facts AS (SELECT project || '/' || path AS project, count(*) AS issues, count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity = 'warning') AS warnings,
 count(*) FILTER (WHERE category = 'security') AS security, count(*) FILTER (WHERE category IN ('complexity', 'maintainability')) AS complexity FROM findings GROUP BY 1)"""


def _facts(s, d):
    found = scan_rules(corpus(s, d), quality.ALL + security.GENERAL)
    return r.project_facts(found.withColumn("project", F.concat("project", F.lit("/"), "path")))


_FACTS_SQL = hits_sql(quality.ALL + security.GENERAL, files_cte(), _FACTS)
_SCORE = "greatest(0, 100 - errors * 8 - warnings * 3)"
add("G4_quality_scores", lambda s, d: r.quality_scores(_facts(s, d)),
    _FACTS_SQL + f"SELECT project, {_SCORE} AS quality_score, CASE WHEN {_SCORE} < 50 THEN 'high' WHEN {_SCORE} < 75 THEN 'medium' ELSE 'low' END AS risk_level FROM facts")
add("G5_quality_gate", lambda s, d: r.quality_gate(_facts(s, d)),
    _FACTS_SQL + "SELECT project, CASE WHEN errors > 0 THEN 'fail' WHEN warnings > 0 THEN 'warn' ELSE 'pass' END AS status, CASE WHEN errors > 0 THEN 'error-level findings: ' || errors ELSE '' END AS blockers, warnings AS warning_count FROM facts")
_ADVICE_SQL = " UNION ALL ".join(
    f"SELECT project, CAST({i} AS INTEGER) AS step_order, '{p}' AS priority, {q(action)} AS action, " + (q(reason.split('{n}')[0]) + f" || {c} || " + q(reason.split('{n}')[1]) if '{n}' in reason else q(reason)) + f" AS reason FROM facts WHERE {c} > 0"
    for i, (c, p, reason, action) in enumerate(r.ADVICE) if c in ("errors", "security", "complexity"))
add("G6_recommendations", lambda s, d: r.recommendations(_facts(s, d)), _FACTS_SQL + _ADVICE_SQL)


def _scores(s, d, found=None):
    files = corpus(s, d)
    h = m.halstead_metrics(files).select("project", "path", "language", "maintainability_index")
    metrics = files.select("project", "path", m.file_complexity("text").alias("cyclomatic")).join(h, ["project", "path"])
    return r.file_scores(base(s, d) if found is None else found, metrics)


_SCORES = f""", scores AS (SELECT f.project, f.path, language, coalesce(n, 0) AS issue_count, 1 + {count_all_sql(m.BRANCH_PATTERNS)} AS cyclomatic_complexity, coalesce(n, 0) + 1 + {count_all_sql(m.BRANCH_PATTERNS)} AS score
 FROM files f LEFT JOIN (SELECT project, path, count(*) AS n FROM findings GROUP BY project, path) USING (project, path))"""
_SC = ["project", "path", "language", "issue_count", "cyclomatic_complexity", "score"]
add("T1_hotspots", lambda s, d: r.hotspots(_scores(s, d)).select(*_SC), hits_sql(quality.ALL, files_cte(), _SCORES) + f"SELECT {', '.join(_SC)} FROM scores ORDER BY score DESC, path LIMIT 10")
add("T1_project_hotspots", lambda s, d: r.project_hotspots(_scores(s, d)).select(*_SC, "rank"),
    hits_sql(quality.ALL, files_cte(), _SCORES) + f"SELECT {', '.join(_SC)}, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY score DESC, path) AS k FROM scores) WHERE k <= 10")
add("T2_top_findings", lambda s, d: r.top_findings(project_findings(corpus(s, d))).select(*SHOWN),
    PROJECT_SQL + f"SELECT {SHOWN_SQL} FROM found ORDER BY CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 WHEN 'info' THEN 2 ELSE 3 END, path, line, \"column\", rule, message LIMIT 20")
add("T10_limited_findings", lambda s, d: r.limit_per_file(base(s, d), 5).select(*SHOWN),
    _BASE_SQL + f"SELECT {SHOWN_SQL} FROM (SELECT *, row_number() OVER (PARTITION BY project, path ORDER BY line, \"column\", rule, message) AS k FROM findings) WHERE k <= 5")


def _plan(s, d):
    # Facts and scores read the same findings: what they need of them is written once, so that files are scanned once.
    tables = RoundTables(s, "action-plan")
    found = tables.table(base(s, d).select("project", "path", "severity", "category"))
    facts = r.project_facts(found)
    return tables.close(r.action_plan(r.recommendations(facts), None, _scores(s, d, found)))


add("G7_action_plan", _plan,
    hits_sql(quality.ALL, files_cte(), _SCORES + _FACTS.replace("project || '/' || path AS project", "project")) + _ADVICE_SQL + f""" UNION ALL SELECT project, CAST({len(r.ADVICE)} + k AS INTEGER), 'medium', 'Refactor hotspot file: ' || path, 'High issue/complexity score (' || issue_count || ' issues, CC=' || cyclomatic_complexity || ').'
 FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY score DESC, path) AS k FROM scores) WHERE k <= 3""")
add("F16_fix_proposals", lambda s, d: r.fix_proposals(scan_rules(corpus(s, d), review.DETECT_ERRORS, around=0)).select("path", "rule", "line", "column", "has_auto_fix", "fix_code", "manual_steps"),
    hits_sql(review.DETECT_ERRORS, files_cte()) + """SELECT path, rule, line, "column", auto_fixable AS has_auto_fix, CASE WHEN auto_fixable THEN CASE rule WHEN 'missingClosing' THEN l || ' }' WHEN 'missingSemicolon' THEN regexp_replace(l, '\\s+$', '') || ';' WHEN 'offByOne' THEN regexp_replace(l, '<=', '<') END END AS fix_code,
 CASE WHEN NOT auto_fixable THEN 'Locate the issue at line ' || line || chr(10) || suggestion || chr(10) || 'Review the change in context' || chr(10) || 'Test the modified code' END AS manual_steps
 FROM (SELECT f.*, string_split(text, chr(10))[line] AS l FROM findings f JOIN files USING (project, path))""")
add("J15_snippets", lambda s, d: scan_rules(document_files(s, d), security.CREDENTIALS, around=2).select("path", "rule", "line", "column", "snippet"),
    hits_sql(security.CREDENTIALS, files_cte("documents")) + """SELECT path, rule, line, "column", array_to_string(string_split(text, chr(10))[greatest(line - 2, 1):line + 2], chr(10)) AS snippet FROM findings JOIN files USING (project, path)""")
add("SK6_alerts", lambda s, d: exports.alerts(scan_rules(corpus(s, d), review.REVIEW)),
    hits_sql(review.REVIEW, files_cte()) + """SELECT CASE severity WHEN 'error' THEN '🔴' WHEN 'warning' THEN '🟡' ELSE '🔵' END || ' ' || rule AS title, CASE severity WHEN 'error' THEN 'critical' WHEN 'warning' THEN 'warning' ELSE 'info' END AS severity,
 path || ':' || line AS place, message, coalesce(suggestion, '') AS fix_suggestion, CASE severity WHEN 'error' THEN 'danger' WHEN 'warning' THEN 'warning' ELSE 'good' END AS color FROM findings""")
add("G33_E14_scan_statistics", lambda s, d: r.scan_statistics(corpus(s, d)),
    "WITH " + files_cte() + """ SELECT count(*) AS total_files, count(*) FILTER (WHERE sup) AS scanned_files, count(*) FILTER (WHERE NOT sup) AS skipped_files, CAST(0 AS BIGINT) AS failed_files,
 CAST(sum(CASE WHEN sup THEN len(string_split(text, chr(10))) ELSE 0 END) AS BIGINT) AS total_lines, CAST(sum(CASE WHEN sup THEN strlen(text) ELSE 0 END) AS BIGINT) AS total_bytes FROM (SELECT *, language <> 'html' AS sup FROM files)""")

# ---- snapshots -------------------------------------------------------------
_MOVED = "CASE WHEN l_partkey % 5 = 0 THEN 1 ELSE 0 END"


def snapshot(s, d, moved: bool, dealt: bool = True):
    shift = f"({_MOVED})" if moved else "0"
    lines = read(s, d, "lineitem") if dealt else s.read.parquet(f"{d}/lineitem.parquet")
    return lines.select(
        F.expr("concat('rule-', cast(l_suppkey % 40 as string))").alias("rule_id"),
        F.expr("concat('src/f', cast(l_orderkey % 3000 as string), '.py')").alias("file"),
        F.expr(f"cast(l_linenumber + {shift} as int)").alias("line"),
        F.expr("cast(l_partkey % 7 as int)").alias("column"),
        F.expr("CASE l_returnflag WHEN 'A' THEN 'ERROR' WHEN 'N' THEN 'WARNING' ELSE 'INFO' END").alias("severity"),
        F.expr("CASE l_linestatus WHEN 'F' THEN 'security' ELSE 'quality' END").alias("category"),
        F.expr("concat('found by ', cast(l_suppkey as string))").alias("message"),
        F.col("l_shipdate").alias("timestamp"),
    )


def _snap_sql(moved: bool) -> str:
    return f"""SELECT 'rule-' || CAST(l_suppkey % 40 AS VARCHAR) AS rule_id, 'src/f' || CAST(l_orderkey % 3000 AS VARCHAR) || '.py' AS file, CAST(l_linenumber + {_MOVED if moved else 0} AS INTEGER) AS line, CAST(l_partkey % 7 AS INTEGER) AS "column",
 CASE l_returnflag WHEN 'A' THEN 'ERROR' WHEN 'N' THEN 'WARNING' ELSE 'INFO' END AS severity, CASE l_linestatus WHEN 'F' THEN 'security' ELSE 'quality' END AS category, 'found by ' || CAST(l_suppkey AS VARCHAR) AS message, l_shipdate AS timestamp FROM lineitem"""


_ID = "md5(rule_id || ':' || file || ':' || line || ':' || \"column\")"
SNAPS = f"""WITH a0 AS (SELECT {_ID} AS id, * FROM ({_snap_sql(False)})), b0 AS (SELECT {_ID} AS id, * FROM ({_snap_sql(True)})),
 a AS (SELECT * EXCLUDE k FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY message DESC, rule_id DESC, severity DESC) AS k FROM a0) WHERE k = 1), b AS (SELECT * EXCLUDE k FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY message DESC, rule_id DESC, severity DESC) AS k FROM b0) WHERE k = 1)"""
add("F1_finding_ids", lambda s, d: b.with_ids(snapshot(s, d, False)).groupBy("id").agg(F.count("*").alias("copies")), SNAPS + " SELECT id, count(*) AS copies FROM a0 GROUP BY id")
add("J7_D4_baseline_compare", lambda s, d: b.compare(snapshot(s, d, False), snapshot(s, d, True)).drop("copies"),
    SNAPS + """ SELECT coalesce(b.id, a.id) AS id, CASE WHEN a.id IS NULL THEN 'new' WHEN b.id IS NULL THEN 'fixed' ELSE 'persistent' END AS state, coalesce(b.rule_id, a.rule_id) AS rule_id, coalesce(b.severity, a.severity) AS severity,
 coalesce(b.file, a.file) AS file, coalesce(b.line, a.line) AS line, coalesce(b."column", a."column") AS "column", coalesce(b.message, a.message) AS message FROM a FULL JOIN b ON a.id = b.id""")
add("D4_new_ids", lambda s, d: b.set_difference(snapshot(s, d, True), snapshot(s, d, False)), SNAPS + " SELECT id FROM b EXCEPT SELECT id FROM a")
add("D4_persistent_ids", lambda s, d: b.set_intersection(snapshot(s, d, True), snapshot(s, d, False)), SNAPS + " SELECT id FROM b INTERSECT SELECT id FROM a")
_TREND = SNAPS + """, t AS (SELECT (SELECT count(*) FROM a) AS baseline_total, (SELECT count(*) FROM b0) AS current_total, (SELECT count(*) FROM b ANTI JOIN a USING (id)) AS new_issues, (SELECT count(*) FROM a ANTI JOIN b USING (id)) AS fixed_issues, (SELECT count(*) FROM a SEMI JOIN b USING (id)) AS persistent_issues)
 SELECT *, CASE WHEN current_total < baseline_total THEN 'improving' WHEN current_total > baseline_total THEN 'worsening' ELSE 'stable' END AS direction, round((current_total - baseline_total) / baseline_total * 100, 2) AS change_percent, current_total - baseline_total AS change_absolute FROM t"""
add("G18_E7_baseline_trend", lambda s, d: b.comparison_summary(snapshot(s, d, False), snapshot(s, d, True)), _TREND)
add("G17_baseline_statistics", lambda s, d: b.statistics(snapshot(s, d, False)),
    SNAPS + """ SELECT CASE WHEN grouping(severity) = 0 THEN 'severity' WHEN grouping(st) = 0 THEN 'status' WHEN grouping(file) = 0 THEN 'file' ELSE 'total' END AS dimension, coalesce(severity, st, file, '*') AS key, count(*) AS count FROM (SELECT *, 'open' AS st FROM a) GROUP BY GROUPING SETS ((severity), (st), (file), ())""")
add("G17_D6_baseline_totals", lambda s, d: b.totals(snapshot(s, d, False)), SNAPS + " SELECT count(*) AS total_findings, count(DISTINCT file) AS total_files FROM a")
add("T4_baseline_top_rules", lambda s, d: b.baseline_top_rules(snapshot(s, d, False)), SNAPS + " SELECT rule_id AS rule, count(*) AS count FROM a GROUP BY rule_id ORDER BY count DESC, rule LIMIT 10")
add("G19_dashboard_statistics", lambda s, d: b.dashboard_statistics(snapshot(s, d, False)),
    SNAPS + " SELECT CASE WHEN grouping(severity) = 0 THEN 'severity' WHEN grouping(category) = 0 THEN 'category' ELSE 'total' END AS dimension, coalesce(severity, category, '*') AS key, count(*) AS count FROM a0 GROUP BY GROUPING SETS ((severity), (category), ())")
add("G20_daily_trend", lambda s, d: b.daily_trend(snapshot(s, d, False)),
    SNAPS + " SELECT CAST(timestamp AS DATE) AS date, count(*) AS total, count(*) FILTER (WHERE severity = 'ERROR') AS error, count(*) FILTER (WHERE severity = 'WARNING') AS warning, count(*) FILTER (WHERE severity = 'INFO') AS info FROM a0 GROUP BY 1")


def _daily(s, d):
    return snapshot(s, d, False).groupBy(F.to_date("timestamp").alias("date")).agg(
        F.count_if(F.col("severity") == "ERROR").alias("new_issues"), F.count_if(F.col("severity") == "INFO").alias("issues_fixed"))


add("G27_quality_trend", lambda s, d: b.quality_trend(_daily(s, d), "1997-01-01", 400),
    SNAPS + """, dd AS (SELECT CAST(timestamp AS DATE) AS date, count(*) FILTER (WHERE severity = 'ERROR') AS new_issues, count(*) FILTER (WHERE severity = 'INFO') AS issues_fixed FROM a0 GROUP BY 1), sp AS (SELECT CAST(unnest(range(DATE '1997-01-01', DATE '1997-01-01' + INTERVAL 400 DAY, INTERVAL 1 DAY)) AS DATE) AS date)
 SELECT date, coalesce(new_issues, 0) AS new_issues, coalesce(issues_fixed, 0) AS issues_fixed, greatest(0, 100 - coalesce(new_issues, 0) * 5) AS quality_score FROM sp LEFT JOIN dd USING (date)""")
QUERIES["T6_findings_page"] = lambda s, d: r.findings_page(snapshot(s, d, False).withColumnRenamed("file", "path").withColumnRenamed("rule_id", "rule"), 3, 50, "error").select("rule", "path", "line", "column", "severity", "message")
ORACLES["T6_findings_page"] = SNAPS + """ SELECT rule_id AS rule, file AS path, line, "column", severity, message FROM a0 WHERE severity = 'ERROR' ORDER BY line, path, "column", rule, message LIMIT 50 OFFSET 100"""
add("W7_sarif_rules", lambda s, d: exports.sarif_rules(snapshot(s, d, False)),
    SNAPS + """ SELECT rule_id, message, CASE severity WHEN 'ERROR' THEN 'error' WHEN 'WARNING' THEN 'warning' ELSE 'note' END AS level, category FROM (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY file, line, "column", message, severity, category) AS k FROM a0) WHERE k = 1""")
add("F9_severity_maps", lambda s, d: snapshot(s, d, False).groupBy("severity").agg(F.count("*").alias("n")).select("severity", r.severity_rank(F.lower("severity")).alias("rank"), r.sarif_level("severity").alias("level"), r.editor_severity("severity").alias("editor"), "n"),
    SNAPS + " SELECT severity, CAST(CASE severity WHEN 'ERROR' THEN 0 WHEN 'WARNING' THEN 1 ELSE 2 END AS INTEGER) AS rank, CASE severity WHEN 'ERROR' THEN 'error' WHEN 'WARNING' THEN 'warning' ELSE 'note' END AS level, CAST(CASE severity WHEN 'ERROR' THEN 1 WHEN 'WARNING' THEN 2 ELSE 3 END AS INTEGER) AS editor, count(*) AS n FROM a0 GROUP BY severity")


def _shown(s, d):
    """Findings with fixes, snippets, confidence and a time, some of each missing; a run per category."""
    # Logs deal findings out by block themselves, so rows are not dealt before.
    return snapshot(s, d, False, dealt=False).withColumns({
        "run": F.col("category"), "timestamp": F.expr("CASE WHEN line > 2 THEN cast(cast(timestamp AS date) AS string) END"),
        "fix": F.expr("""CASE WHEN column = 0 THEN concat('say "', message, '"') END"""), "code_snippet": F.expr("CASE WHEN line = 1 THEN concat('a\\n\\tb ', file) END"),
        "confidence": F.expr("CASE WHEN column < 3 THEN column / 4 END")})


add("SK1_sarif", lambda s, d: exports.sarif_results(exports.sarif_documents(_shown(s, d), max_bytes=500_000, created_at="now")).drop("part"),
    SNAPS + """ SELECT category AS run, rule_id, CASE severity WHEN 'ERROR' THEN 'error' WHEN 'WARNING' THEN 'warning' ELSE 'note' END AS level, message, file, line, "column", CASE WHEN line = 1 THEN 'a' || chr(10) || chr(9) || 'b ' || file END AS snippet,
 CASE WHEN "column" = 0 THEN 'say "' || message || '"' END AS fix, CASE WHEN "column" < 3 THEN "column" / 4 ELSE 0.8 END AS confidence, CASE WHEN line > 2 THEN CAST(CAST(timestamp AS DATE) AS VARCHAR) ELSE 'now' END AS timestamp FROM a0""")
_COMPARED = """, c AS (SELECT coalesce(b.rule_id, a.rule_id) AS rule_id, coalesce(b.severity, a.severity) AS severity, coalesce(b.file, a.file) AS file, coalesce(b.line, a.line) AS line, coalesce(b."column", a."column") AS "column", b.message,
  CASE WHEN a.id IS NULL THEN 'new' ELSE 'fixed' END AS state FROM a FULL JOIN b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL),
 listed AS (SELECT state, string_agg('### ' || rule_id || chr(10) || '- **文件**: `' || file || ':' || line || '`' || chr(10) || '- **严重性**: ' || severity || CASE state WHEN 'new' THEN chr(10) || '- **描述**: ' || message ELSE '' END, chr(10) ORDER BY k) AS items
  FROM (SELECT *, row_number() OVER (PARTITION BY state ORDER BY rule_id, file, line, "column") AS k FROM c) WHERE k <= 20 GROUP BY state)"""
_ROWS = [("基线问题数", "baseline_total"), ("当前问题数", "current_total"), ("新增问题", "new_issues"), ("已修复", "fixed_issues"), ("持续存在", "persistent_issues")]
add("SK3_comparison_markdown", lambda s, d: exports.comparison_markdown(b.compare(snapshot(s, d, False), snapshot(s, d, True)), b.comparison_summary(snapshot(s, d, False), snapshot(s, d, True))),
    _TREND.replace(" SELECT *, CASE WHEN current_total", _COMPARED + ", z AS (SELECT *, CASE WHEN current_total") + ") SELECT array_to_string(['# 基线对比报告', '', '## 摘要', '', '| 指标 | 数量 |', '|------|------|', "
    + ", ".join(f"'| {n} | ' || {c} || ' |'" for n, c in _ROWS) + ", '', '## 趋势', '', '- 方向：' || direction, '- 变化：' || printf('%+.2f', change_percent) || '%', '- 绝对变化：' || printf('%+d', change_absolute)], chr(10))"
    + "".join(f" || coalesce((SELECT chr(10) || chr(10) || '## {title}' || chr(10) || chr(10) || items FROM listed WHERE state = '{state}'), '')" for state, title in (("new", "新增问题"), ("fixed", "已修复问题"))) + " AS markdown FROM z")


def _lengths(s, d):
    docs = document_files(s, d).withColumn("_n", F.length("text") % 10)
    before = docs.where("_n <> 1").select("path", "text")
    after = docs.where("_n <> 2").select("path", F.when(F.col("_n") == 3, F.concat("text", F.lit("\nnew line"))).otherwise(F.col("text")).alias("text"))
    return before, after


_VERS = "WITH " + files_cte("documents") + """, v AS (SELECT path, text, length(text) % 10 AS n FROM files), o AS (SELECT path, md5(text) AS old_hash FROM v WHERE n <> 1), w AS (SELECT path, md5(CASE WHEN n = 3 THEN text || chr(10) || 'new line' ELSE text END) AS new_hash FROM v WHERE n <> 2)"""
add("J6_SC15_F2_file_changes", lambda s, d: b.file_changes(*_lengths(s, d)),
    _VERS + " SELECT coalesce(o.path, w.path) AS path, CASE WHEN old_hash IS NULL THEN 'new' WHEN new_hash IS NULL THEN 'deleted' WHEN old_hash = new_hash THEN 'unchanged' ELSE 'modified' END AS status, old_hash, new_hash FROM o FULL JOIN w ON o.path = w.path")
add("E15_incremental_scan", lambda s, d: scan_rules(b.changed_files(*_lengths(s, d)).select(F.lit("p").alias("project"), "path", F.lit("python").alias("language"), "text"), security.CREDENTIALS).select("path", "rule", "line", "column"),
    hits_sql(security.CREDENTIALS, files_cte("documents").replace("files AS", "docs AS") + ", files AS (SELECT 'p' AS project, path, 'python' AS language, CASE WHEN length(text) % 10 = 3 THEN text || chr(10) || 'new line' ELSE text END AS text FROM docs WHERE length(text) % 10 IN (1, 3))") + 'SELECT path, rule, line, "column" FROM findings')

# ---- rules against the corpus ----------------------------------------------
_CAT = quality.ALL + security.COMPREHENSIVE
add("P11_rule_coverage", lambda s, d: r.rule_coverage(rules_table(s, _CAT), scan_rules(corpus(s, d), _CAT)),
    hits_sql(_CAT, files_cte()) + "SELECT engine, rule, patterns, coalesce(findings, 0) AS findings, coalesce(files, 0) AS files FROM (SELECT engine, rule, count(*) AS patterns FROM rules GROUP BY 1, 2) LEFT JOIN (SELECT engine, rule, count(*) AS findings, count(DISTINCT path) AS files FROM findings GROUP BY 1, 2) USING (engine, rule)")
_L = "langs(engine, lang, kind) AS (VALUES " + ",".join(f"({q(x.engine)},{q(y.lstrip('!'))},{q('not' if y.startswith('!') else 'only')},{i})" for i, x in enumerate(_CAT) for y in (x.languages or ('*',))) + ")"
_L = _L.replace("langs(engine, lang, kind)", "langs(engine, lang, kind, i)")
add("P9_P12_engine_selection", lambda s, d: r.engine_selection(corpus(s, d), _CAT),
    "WITH " + files_cte() + f", {_L}, c AS (SELECT language, count(*) AS files FROM files GROUP BY language) SELECT language, files, engine, count(DISTINCT i) AS patterns FROM c, langs l WHERE (kind = 'only' AND lang IN ('*', language)) OR (kind = 'not' AND NOT EXISTS (SELECT 1 FROM langs x WHERE x.i = l.i AND x.lang = c.language)) GROUP BY language, files, engine")
add("J13_rule_suggestions", lambda s, d: r.rule_suggestions(scan_rules(corpus(s, d), quality.PYTHON + security.GENERAL + security.PYTHON)).select("path", "rule", "line", "column", "advice", "quick_fix_title", "quick_fix_text"),
    hits_sql(quality.PYTHON + security.GENERAL + security.PYTHON, files_cte()) + "SELECT path, rule, line, \"column\", CASE " + " ".join(f"WHEN contains(rule, '{p}') THEN {q(v)}" for p, v in r.RULE_ADVICE) + f" ELSE {q(r.OTHER_ADVICE)} END AS advice, CASE " + " ".join(f"WHEN contains(rule, '{p}') THEN {q(t)}" for p, t, _ in r.QUICK_FIXES) + " END AS quick_fix_title, CASE " + " ".join(f"WHEN contains(rule, '{p}') THEN {q(n)}" for p, _, n in r.QUICK_FIXES) + " END AS quick_fix_text FROM findings")

add("F20_json_rows", lambda s, d: exports.json_rows(snapshot(s, d, False).select("rule_id", "file", "line", "severity")),
    SNAPS + " SELECT CAST(to_json({'rule_id': rule_id, 'file': file, 'line': line, 'severity': severity}) AS VARCHAR) AS json FROM a0")
