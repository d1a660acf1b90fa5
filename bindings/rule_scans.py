"""Rule packs over the whole corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.corpus import WIDE, corpus, document_files, files_cte, wide_corpus
from bindings.rule_sql import hits_sql, repeats_as_findings, repeats_sql
from bindings.unit_sql import LONGS
from lintlake.operators.scan import dedup_findings, scan_rules
from lintlake.plans.analysis import quality_findings, sonar_style
from lintlake.plans.sql_functions import register_scan_code
from lintlake.rules import extra, quality, review, security

SHOWN = ["project", "path", "language", "engine", "rule", "severity", "category", "message", "line", "column"]
SHOWN_SQL = 'project, path, language, engine, rule, severity, category, message, line, "column"'


def _pack(rules):
    return lambda spark, d: scan_rules(corpus(spark, d), rules).select(*SHOWN)


def _pack_sql(rules):
    return hits_sql(rules, files_cte()) + f"SELECT {SHOWN_SQL} FROM findings"


PACKS = {
    "RS1_javascript_quality": quality.JAVASCRIPT,
    "RS2_python_quality": quality.PYTHON,
    "RS3_java_quality": quality.JAVA_PACK,
    "RS4_generic_quality": quality.GENERIC,
    "RS5_general_security": security.GENERAL,
    "RS6_python_security": security.PYTHON,
    "RS7_javascript_security": security.JAVASCRIPT,
    "RS8_bandit_style": security.BANDIT,
    "RS9_eslint_security": security.ESLINT,
    "RS10_sonar_style": security.SONAR,
    "RS11_semgrep_style": security.SEMGREP,
    "RS12_error_patterns": review.ERRORS,
    "RS13_review_rules": review.REVIEW,
    "RS14_language_rules": review.LANGUAGE_SPECIFIC,
    "RS18_framework_rules": extra.FRAMEWORK,
    "RS20_language_extensions": extra.LANGUAGE_EXTENSIONS,
}


def credentials_by_rule(spark, d):
    """Where are secrets in this corpus, by rule."""
    hits = dedup_findings(scan_rules(document_files(spark, d), security.CREDENTIALS))
    return hits.groupBy("rule", "severity").agg(
        F.count("*").alias("findings"), F.countDistinct("path").alias("files")
    )


QUERIES = {name: _pack(rules) for name, rules in PACKS.items()}
ORACLES = {name: _pack_sql(rules) for name, rules in PACKS.items()}
_LONG_UNION = f"SELECT {SHOWN_SQL} FROM findings UNION ALL SELECT {SHOWN_SQL} FROM longs WHERE language "
for _name, _test, _rules in (("RS1_javascript_quality", "<> 'python'", quality.JAVASCRIPT), ("RS2_python_quality", "= 'python'", quality.PYTHON)):
    QUERIES[_name] = lambda spark, d, test=_test, rules=_rules: quality_findings(wide_corpus(spark, d).where(f"language {test}"), rules).select(*SHOWN)
    ORACLES[_name] = hits_sql(_rules, files_cte(*WIDE), ", " + LONGS) + _LONG_UNION + _test
QUERIES["RS10_sonar_style"] = lambda spark, d: sonar_style(corpus(spark, d)).select(*SHOWN)
ORACLES["RS10_sonar_style"] = hits_sql(security.SONAR, files_cte(), repeats_sql()) + f"SELECT {SHOWN_SQL} FROM findings UNION ALL " + repeats_as_findings(SHOWN_SQL)
QUERIES["RS0_credentials_by_rule"] = credentials_by_rule
ORACLES["RS0_credentials_by_rule"] = hits_sql(
    security.CREDENTIALS, files_cte("documents")
) + """SELECT rule, severity, count(*) AS findings, count(DISTINCT path) AS files
FROM (SELECT DISTINCT project, path, rule, severity, line, "column" FROM findings) GROUP BY ALL"""


def scan_in_sql(spark, d):
    """Secrets of the corpus as an SQL user asks for them."""
    register_scan_code(spark, security.CREDENTIALS)
    return spark.sql(
        "SELECT f.project, f.path, f.language, h.engine, h.rule, h.severity, h.category, h.message, h.line, h.column "
        "FROM {files} f, LATERAL scan_code(f.text, f.language) h", files=corpus(spark, d)
    )


QUERIES["RS0_scan_code_sql"] = scan_in_sql
ORACLES["RS0_scan_code_sql"] = _pack_sql(security.CREDENTIALS)
