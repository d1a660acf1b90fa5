"""Composite scans: comprehensive security, code review, project pipeline."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.functions.language import normalize_language
from lintlake.operators.duplicates import repeat_findings
from lintlake.operators.scan import scan_first, scan_rules
from lintlake.operators.structure import long_functions
from lintlake.rules import quality, review, security

SECURITY_LANGUAGES = ["javascript", "typescript", "python"]


def comprehensive_security(files: DataFrame) -> DataFrame:
    """All security and smell packs in one pass, and repeats; first engine keeps a spot."""
    names = [r.rule for r in security.COMPREHENSIVE]
    return scan_first(files, security.COMPREHENSIVE, names).unionByName(repeat_findings(files))


def quality_findings(files: DataFrame, rules=quality.ALL) -> DataFrame:
    """Findings of the base packs, with functions that are too long."""
    return scan_rules(files, rules).unionByName(long_functions(files))


def sonar_style(files: DataFrame) -> DataFrame:
    return scan_rules(files, security.SONAR).unionByName(repeat_findings(files))


def code_review(files: DataFrame, include_suggestions: bool = True) -> DataFrame:
    found = scan_rules(files, review.CODE_REVIEW)
    return found if include_suggestions else found.drop("suggestion")


def detect_errors(files: DataFrame) -> DataFrame:
    return scan_rules(files, review.DETECT_ERRORS)


# Languages that count as another one outside the base packs.
VARIANTS = {
    "javascript": ("javascript-test", "javascript-config"),
    "typescript": ("typescript-test", "typescript-declaration"),
    "python": ("python-test",),
}


def _widened(rules, only=None):
    """Rules that also see variants such as ``-test``, held to some languages."""
    result = []
    for rule in rules:
        names = [x for x in (rule.languages or only or ()) if only is None or x in only]
        wide = tuple(y for x in names for y in (x, *VARIANTS.get(x, ())))
        if names or not (rule.languages or only):
            result.append(replace(rule, languages=wide))
    return result


_PLAIN = quality.ALL + _widened(review.REVIEW + review.LANGUAGE_REVIEW)
_PROJECT = _PLAIN + _widened(security.COMPREHENSIVE, SECURITY_LANGUAGES)


def project_findings(files: DataFrame, python_jobs: bool = True) -> DataFrame:
    """Base, review and (for scripted languages) security findings of a project.

    All packs run in one pass over the files. The base packs see the language
    as detected, the others without variants such as ``-test``. Only security
    findings are merged per spot, inside the row of their file, so findings
    leave the pass without a shuffle. ``python_jobs`` adds functions that are
    too long (every scripted file) and repeats (where security runs).
    """
    labels = [i if i < len(_PLAIN) else r.rule for i, r in enumerate(_PROJECT)]
    merged = scan_first(files, _PROJECT, labels)
    if python_jobs:
        scripted = [y for x in SECURITY_LANGUAGES for y in (x, *VARIANTS[x])]
        repeats = repeat_findings(files.where(F.col("language").isin(scripted)))
        merged = merged.unionByName(long_functions(files)).unionByName(repeats)
    return merged.withColumn("language", normalize_language("language"))


def compliance_findings(files: DataFrame) -> DataFrame:
    """Compliance rules by text pattern, and by what a named function or class lacks."""
    from lintlake.operators.structure import code_units
    from lintlake.rules.extra import COMPLIANCE_BODIES, COMPLIANCE_TEXT

    texts = scan_rules(files, COMPLIANCE_TEXT).select("project", "path", "rule", "severity", "message", "line")
    units = code_units(files.where(F.col("language") == "python"))
    tests = []
    for rule, kind, severity, name, must, lacks, message, _ in COMPLIANCE_BODIES:
        test = (F.col("kind") == kind) & F.col("name").rlike(name) & ~F.col("body").rlike(lacks)
        if must:
            test = test & F.col("body").rlike(must)
        tests.append(
            F.when(test, F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.lit(message).alias("message")))
        )
    bodies = units.select("project", "path", "line", F.explode(F.array_compact(F.array(*tests))).alias("_f")).select(
        "project", "path", "_f.rule", "_f.severity", "_f.message", "line"
    )
    return texts.unionByName(bodies)
