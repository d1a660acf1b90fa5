"""Scans from SQL and detectors beside the rules."""

import pandas as pd
import pytest

from lintlake.operators.scan import scan_rules
from lintlake.plans.sql_functions import COLUMNS, Detector, register_scan_code, scan_with
from lintlake.rules import quality, security
from lintlake.rules.model import Rule

TEXT = "password = 'abcdef'\né token = 'abcdefghij' password = 'ghijkl'\n\n\n\n\nx"
SHOWN = [c.split()[0] for c in COLUMNS.split(", ")]


def test_scan_code_equals_the_scan(spark, make_files):
    files = make_files([("a.py", "python", TEXT), ("b.js", "javascript", "console.log(1); el.innerHTML = x; eval(y)"), ("c", "go", ""), ("d", None, TEXT), ("e.js", "javascript", None)])
    rules = [r for r in quality.ALL + security.COMPREHENSIVE if r.kind != "nesting"]
    register_scan_code(spark, rules)
    found = spark.sql("SELECT path, h.* FROM {files}, LATERAL scan_code(text, language) h", files=files)
    want = scan_rules(files, rules).select("path", *SHOWN)
    assert found.columns == want.columns
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_scan_code_refuses_rules_about_nesting(spark):
    with pytest.raises(ValueError, match="nesting"):
        register_scan_code(spark, [r for r in quality.ALL if r.kind == "nesting"], "scan_nesting")


def _rule(name, languages=()):
    return Rule("custom", name, "", "", "warning", "style", "found {match}", languages=languages)


def test_detectors_join_the_rules(make_files):
    def tabs(texts: pd.Series):
        return texts.map(lambda t: [(t.count("\n", 0, i) + 1, 1, "tab") for i, c in enumerate(t) if c == "\t"])

    files = make_files([("a.py", "python", "\tx\n\ty"), ("b.go", "go", "\tz"), ("c.py", "python", ""), ("d.py", "python", None), ("e.py", "python", TEXT)])
    found = scan_with(files, security.CREDENTIALS, [Detector(_rule("tabs", ("python",)), tabs), Detector(_rule("length"), lambda t: t.map(lambda x: [(1, 1, str(len(x)))] if x else []))])
    own = sorted((r.path, r.rule, r.line, r.message) for r in found.where("engine = 'custom'").collect())
    assert own == [("a.py", "length", 1, "found 5"), ("a.py", "tabs", 1, "found tab"), ("a.py", "tabs", 2, "found tab"), ("b.go", "length", 1, "found 2"), ("e.py", "length", 1, f"found {len(TEXT)}")]
    assert found.where("engine <> 'custom'").count() == scan_rules(files, security.CREDENTIALS).count() > 0
    assert {r.rule_order for r in found.where("rule = 'length'").collect()} == {len(security.CREDENTIALS) + 1}
    assert scan_with(files, security.CREDENTIALS, []).columns == found.columns


def test_errors_of_a_detector_are_raised(make_files):
    def broken(texts):
        raise KeyError("no such thing")

    with pytest.raises(Exception, match="no such thing"):
        scan_with(make_files([("a.py", "python", "x")]), [], [Detector(_rule("broken"), broken)]).collect()
