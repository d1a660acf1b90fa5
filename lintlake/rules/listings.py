"""What the packs and tables offer, as small DataFrames for lookups."""

from __future__ import annotations

from lintlake.functions.language import LANGUAGE_AREAS
from lintlake.operators.dependencies import LANGUAGE_OF
from lintlake.operators.logs import ERROR_CLASSES, FORMATS, LEVELS, PERFORMANCE_EVENTS, SECURITY_EVENTS
from lintlake.rules import extra, quality, review, security
from lintlake.rules.advisories import MANAGER_SCHEMA, PACKAGE_MANAGERS
from lintlake.rules.model import rules_table


def all_rules() -> list:
    return (
        quality.ALL + security.COMPREHENSIVE + [security.REPEAT_RULE] + review.CODE_REVIEW + extra.FRAMEWORK
        + extra.COMPLIANCE_TEXT + extra.LANGUAGE_EXTENSIONS + extra.DEEP_CHECK
    )


def supported_rules(spark, language: str | None = None):
    """The catalogue, or what of it applies to a language."""
    rules = all_rules()
    if language:
        rules = [
            r for r in rules
            if (not r.languages or language in r.languages or all(x.startswith("!") for x in r.languages))
            and f"!{language}" not in r.languages
        ]
    return rules_table(spark, rules)


def languages_by_area(spark):
    return spark.createDataFrame([(a, n) for a, names in LANGUAGE_AREAS.items() for n in names], "area string, language string")


def package_managers(spark):
    return spark.createDataFrame(PACKAGE_MANAGERS, MANAGER_SCHEMA)


def dependency_checks(spark):
    rows = [("vulnerability", "Check for known security vulnerabilities", sorted(set(LANGUAGE_OF.values()))),
            ("outdated", "Check for outdated dependencies", ["javascript", "python", "java", "go", "rust"]),
            ("license", "Check for license risks", ["all"])]
    return spark.createDataFrame(rows, "check string, description string, languages array<string>")


def log_patterns(spark):
    """(kind, name) of formats, levels, events and error classes."""
    rows = [("format", n) for n in (*FORMATS, "json")] + [("level", n) for n in LEVELS]
    rows += [("security", n) for n in SECURITY_EVENTS] + [("performance", n) for n in PERFORMANCE_EVENTS]
    rows += [("error_class", n) for n in ERROR_CLASSES]
    return spark.createDataFrame(rows, "kind string, name string")
