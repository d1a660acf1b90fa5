"""Logs, dependencies, snapshots, exports, rewrites, team reports."""

import json

import pytest
from pyspark.sql import functions as F

from lintlake.operators import baseline, dependencies, diagnostics, logs, report, rewrite, taint, team
from lintlake.plans import entry_points
from lintlake.sinks import exports
from lintlake.sources import files as sources
from lintlake.sources import manifests
from lintlake.sources.rules_file import parse_rules


def lines(spark, rows):
    return spark.createDataFrame([("f.log", i, r) for i, r in enumerate(rows, 1)], "path string, line int, raw string")


def test_log_formats_and_fields(spark):
    rows = {
        '{"time":"2024-01-01","severity":"error","msg":"boom","k":"v"}': ("unknown", None),
        "[2024-01-01 10:00:00] [error] failed login": ("generic", "ERROR"),
        "2024-01-01T10:00:00Z WARN slow query": ("generic", "WARN"),
        "2024-01-01 10:00:00,123 - INFO - fine": ("python", "INFO"),
        "2024-01-01 10:00:00 [DEBUG] fine": ("java", "DEBUG"),
        "Jan 12 10:00:00 host proc: disk full": ("syslog", None),
        '1.2.3.4 - - [10/Oct/2000:13:55:36] "GET / HTTP/1.0" 200 23': ("apache", None),
        "nothing here": ("unknown", None),
    }
    got = logs.parse_lines(lines(spark, rows).withColumn("format", logs.detect_line_format("raw"))).collect()
    assert {r.raw: (r.format, r.level) for r in got} == rows
    syslog = [r for r in got if r.format == "syslog"][0]
    assert syslog.message == "disk full" and syslog.metadata == {"host": "host", "process": "proc"}


def test_json_lines_that_do_not_parse_are_not_counted(spark):
    df = lines(spark, ['{"level":"ERROR","message":"x","extra":"1"}', '{"level":"INFO","message":'])
    entries = logs.parse_lines(logs.with_formats(df))
    summary = {r.path: r for r in logs.summarize(entries).collect()}
    assert (summary["f.log"].total_lines, summary["f.log"].parsed_lines, summary["*"].errors) == (2, 1, 1)
    assert [r.metadata for r in entries.where("parsed").collect()] == [{"extra": "1"}]


def test_events_and_error_classes(spark):
    messages = ["failed login", "union select 1", "<script>", "../x", "access denied", "rate limit",
                "syntax error", "exception", "connection refused", "deadlock", "file not found", "module not found"]
    df = lines(spark, [f"[2024-01-01 00:00:00] [ERROR] {m}" for m in messages]).withColumn("format", F.lit("generic"))
    found = logs.classify(logs.parse_lines(df)).orderBy("line").collect()
    assert [r.security[:1] for r in found[:6]] == [["Failed Login"], ["SQL Injection"], ["XSS Attempt"], ["Path Traversal"], ["Access Denied"], ["Rate Limit"]]
    assert [r.error_class for r in found[6:]] == ["SYNTAX", "RUNTIME", "NETWORK", "DATABASE", "FILESYSTEM", "DEPENDENCY"]


def test_dependency_edges(spark):
    rows = [("npm", "lodash", "^4.17.15"), ("npm", "lodash", "*"), ("PyPI", "flask", ">=2.0,<3"), ("npm", "@scope/qs", "1.0.0"),
            ("maven", "org.apache:log4j", "2.14.1"), ("maven", "com.x:jackson-databind", "2.13.4.2"), ("npm", "QS", "6.5.2")]
    deps = spark.createDataFrame([("p", e, n, s, False, "prod") for e, n, s in rows], "project string, ecosystem string, name string, spec string, dev boolean, kind string")
    found = sorted((r.name, r.spec, r.cve) for r in dependencies.vulnerable(deps).collect())
    assert found == [("QS", "6.5.2", "CVE-2022-24999"), ("flask", ">=2.0,<3", "CVE-2023-30861"), ("lodash", "^4.17.15", "CVE-2020-8203"),
                     ("lodash", "^4.17.15", "CVE-2021-23337"), ("org.apache:log4j", "2.14.1", "CVE-2021-44228")]
    star = dependencies.vulnerable(deps, legacy_star=True).where("spec = '*'").count()
    assert star == 2


def test_advisory_table(spark):
    rows = {(r.package, r.cve): r for r in dependencies.advisories_table(spark).collect()}
    assert len(rows) == 27
    assert rows[("requests", "CVE-2023-32681")].description == "Requests versions prior to 2.31.0 may leak Proxy-Authorization headers."
    assert rows[("axios", "CVE-2021-3749")].fix == "Upgrade to axios@0.21.1 or later"


def test_manifest_files_end_to_end(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "package.json").write_text('{"dependencies":{"lodash":"4.17.1"},"devDependencies":{"lodash":"^4.17.21"}}')
    (tmp_path / "a" / "requirements.txt").write_text("flask==1.0\n")
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "requirements.txt").write_text("# c\nFlask==1.0\n\nnumpy\n")
    (tmp_path / "b" / "Cargo.toml").write_text('[dependencies]\nserde = "1.0.1"\n[x]\ny = 1\n')
    table = sources.manifest_tree(spark, str(tmp_path))
    cargo = manifests.cargo_dependencies(table.where("path LIKE '%Cargo.toml'")).collect()
    assert [(r.project, r.name, r.spec) for r in cargo] == [("b", "serde", "1.0.1")]
    result = entry_points.check_dependencies(table)
    assert {(r.project, r.name, r.type) for r in result["issues"].collect()} == {("a", "lodash", "outdated"), ("b", "flask", "vulnerability")}


def finding(i, column=0):
    return (f"rule{i % 3}", f"f{i}.py", i, column, "ERROR", "security", f"text {i}")


SCHEMA = "rule_id string, file string, line int, column int, severity string, category string, message string"


def test_baseline_round_trip_and_compare(spark, tmp_path):
    before = spark.createDataFrame([finding(i) for i in range(6)], SCHEMA)
    after = spark.createDataFrame([finding(i) for i in range(2, 8)] + [finding(7)], SCHEMA)
    path = str(tmp_path / "baselines")
    exports.save_baseline(before, path, "one", "2024-01-01 00:00:00")
    exports.save_baseline(after, path, "two", "2024-02-01 00:00:00")
    assert [r.baseline_name for r in sources.list_baselines(spark, path).collect()] == ["two", "one"]
    stored = sources.read_baseline(spark, path, "one")
    states = baseline.compare(stored, after)
    assert {r.state: r["count"] for r in states.groupBy("state").count().collect()} == {"new": 2, "fixed": 2, "persistent": 4}
    total = baseline.comparison_summary(stored, after).collect()[0]
    assert (total.baseline_total, total.current_total, total.direction, total.change_percent) == (6, 7, "worsening", 16.67)
    text = exports.comparison_markdown(states, baseline.comparison_summary(stored, after)).collect()[0].markdown
    assert "+16.67%" in text and "新增问题" in text and text.count("### rule") == 4
    exports.delete_baseline(spark, path, "one")
    assert [r.baseline_name for r in sources.list_baselines(spark, path).collect()] == ["two"]


def test_trend_of_an_empty_baseline(spark):
    rows = spark.createDataFrame([(0, 3), (0, 0)], "baseline_total int, current_total int")
    assert [(r.direction, r.change_percent) for r in baseline.trend(rows).collect()] == [("worsening", 100.0), ("stable", 0.0)]


def test_sarif_parts_hold_every_finding(spark, tmp_path):
    found = spark.createDataFrame([finding(i, c) for i in range(20) for c in range(5)], SCHEMA).withColumn("run", F.lit("r1"))
    documents = exports.sarif_documents(found, max_bytes=8_000, created_at="t")
    texts = [r.sarif for r in documents.collect()]
    docs = [json.loads(t) for t in texts]
    assert len(docs) > 2 and sum(len(d["runs"][0]["results"]) for d in docs) == 100
    assert all(sum(len(json.dumps(r)) for r in d["runs"][0]["results"]) < 12_000 for d in docs)
    run = docs[0]["runs"][0]
    assert docs[0]["version"] == "2.1.0" and run["tool"]["driver"]["rules"][0]["defaultConfiguration"]["level"] == "error"
    assert run["results"][0]["locations"][0]["physicalLocation"]["artifactLocation"]["uri"].endswith(".py")
    exports.write_sarif(documents, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == len(docs)


def test_sarif_fields(spark):
    """Given fields appear, missing ones take their defaults or stay out; artifacts come once a run; a null run is a run."""
    rows = [
        ("r", "a", "x.py", 3, 4, "CRITICAL", "quality", "m", 0.25, "2024-01-01", 'f "1"', "s\n", ["t"]), ("r", "a", "x.py", 1, 1, "low", None, "first", None, None, None, None, None),
        (None, None, None, None, None, None, None, None, None, None, None, None, None), ("q", "b", "none.py", 2, 2, "odd", "c", "m", None, None, None, None, None),
    ]
    schema = "run string, rule_id string, file string, line int, column int, severity string, category string, message string, confidence double, timestamp string, fix string, code_snippet string, tags array<string>"
    files = spark.createDataFrame([("x.py", "x = 'é'\n"), ("y.py", "unused")], "path string, text string")
    logs = {r.run: json.loads(r.sarif)["runs"][0] for r in exports.sarif_documents(spark.createDataFrame(rows, schema), files, created_at="now").collect()}
    assert set(logs) == {"r", "q", None}
    first, second = logs["r"]["results"]
    assert first["properties"] == {"timestamp": "now", "confidence": 0.8} and first["level"] == "note" and "fixes" not in first
    assert second["fixes"] == [{"description": {"text": exports.FIX_HEADLINE}, "appliedFixes": [{"description": {"text": 'f "1"'}}]}]
    assert second["locations"][0]["physicalLocation"]["region"] == {"startLine": 3, "startColumn": 4, "snippet": {"text": "s\n"}} and second["level"] == "error"
    assert logs["r"]["artifacts"] == [{"location": {"uri": "x.py"}, "contents": {"text": "x = 'é'\n"}, "sourceLanguage": "python"}] and logs["q"]["artifacts"] == []
    rule = logs["r"]["tool"]["driver"]["rules"]
    assert len(rule) == 1 and rule[0]["shortDescription"]["text"] == "first" and rule[0]["properties"] == {"category": "security", "cwe": "", "owasp": "", "tags": []}
    empty = logs[None]["results"][0]
    assert empty["ruleId"] == "unknown-rule" and empty["level"] == "warning" and empty["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] == "unknown"


def test_hot_sarif_run_is_cut_by_many_tasks(spark):
    """A third of all findings in one run: the running totals lie in as many ranges as asked for, and parts stay bounded."""
    found = spark.range(6000).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('r', id % 200) END AS run", "'rule' AS rule_id", "concat('f', id % 500) AS file", "cast(id AS int) AS line",
                                         "1 AS column", "'INFO' AS severity", "'c' AS category", "'m' AS message")
    documents = exports.sarif_documents(found, max_bytes=20_000, created_at="t", ranges=16)
    rows = exports.sarif_results(documents).groupBy("run", "part").count().collect()
    assert sum(r["count"] for r in rows) == 6000 and sum(r.run == "hot" for r in rows) > 15
    assert max(r["count"] for r in rows) < 130


def test_sarif_findings_are_shuffled_once(spark):
    """Findings travel as their columns, once; blocks end parts, whose numbers stay apart; totals of many ranges are joined instead."""
    found = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN null ELSE concat('r', id % 2) END AS run", "concat('rule', id % 7) AS rule_id", "concat('f', id % 50) AS file", "cast(id % 40 AS int) AS line",
                                         "1 AS column", "'INFO' AS severity", "'c' AS category", "concat('m', id) AS message")
    seen = []
    for known in (100_000, 5):
        exports.KNOWN_RANGES, before = known, exports.KNOWN_RANGES
        try:
            documents = exports.sarif_documents(found, max_bytes=6_000, created_at="t", ranges=16)
            plan = documents._jdf.queryExecution().executedPlan().toString()
            rows = documents.collect()
        finally:
            exports.KNOWN_RANGES = before
        shuffled = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "block" in x]
        assert len(shuffled) == 1 and not any("Exchange hashpartitioning(run" in x and "part" in x.split("hashpartitioning(")[1].split(")")[0] for x in plan.splitlines())
        assert len({(r.run, r.part) for r in rows}) == len(rows) > 100
        logs = {(r.run, r.part): json.loads(r.sarif)["runs"][0] for r in rows}
        messages = sorted(x["message"]["text"] for log in logs.values() for x in log["results"])
        assert messages == sorted(f"m{i}" for i in range(3000))
        for log in logs.values():
            results = [x for x in log["results"]]
            assert sum(len(json.dumps(x, separators=(",", ":"))) + 1 for x in results[:-1]) <= 6_000 + 400
            rules = log["tool"]["driver"]["rules"]
            assert [x["id"] for x in rules] == sorted({x["ruleId"] for x in results})
            place = lambda x: (x["locations"][0]["physicalLocation"]["artifactLocation"]["uri"], x["locations"][0]["physicalLocation"]["region"]["startLine"], x["message"]["text"])
            for rule in rules:
                assert rule["shortDescription"]["text"] == min(place(x) for x in results if x["ruleId"] == rule["id"])[2]
        seen.append(sorted((str(r.run), r.part, r.sarif) for r in rows))
    assert seen[0] == seen[1]


def test_snapshots_of_both_shapes(spark, tmp_path):
    one = {"timestamp": "2024-01-02T00:00:00", "findings": [{"rule_id": "a", "file": "x", "line": 1, "column": 2, "severity": "ERROR"}]}
    (tmp_path / "one.json").write_text(json.dumps(one))
    (tmp_path / "two.json").write_text(json.dumps([one, {**one, "findings": []}]))
    rows = sources.finding_snapshots(spark, str(tmp_path)).collect()
    assert sorted((r.source_file, r.rule_id) for r in rows if r.rule_id) == [("one.json", "a"), ("two.json", "a")]


def test_directory_sources(spark, tmp_path):
    for name, text in {"src/a.py": "x = 1", "node_modules/m/b.js": "y", "about/c.ts": "z", "d.bin": "q", "Dockerfile": "FROM x"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "src" / "bad enc.py").write_bytes(b"a = '\xff'")
    paths = lambda df: sorted(r.path for r in df.collect())
    assert paths(sources.directory_files(spark, str(tmp_path))) == ["Dockerfile", "about/c.ts", "src/a.py", "src/bad enc.py"]
    assert paths(sources.project_files(spark, str(tmp_path), 2)) == ["about/c.ts", "src/a.py"]
    assert "about/c.ts" in paths(sources.corpus_files(spark, str(tmp_path)))
    asked = spark.createDataFrame([("src/a.py",), ("none.py",)], "path string")
    assert {r.path: r.error for r in sources.listed_files(spark, str(tmp_path), asked).collect()} == {"src/a.py": None, "none.py": "File not found: none.py"}
    assert sources.snippet_files(spark, [("s1", "python", "eval(x)")]).count() == 1
    stats = report.scan_statistics(sources.corpus_files(spark, str(tmp_path))).collect()[0]
    assert (stats.total_files, stats.scanned_files) == (4, 4)


def test_custom_rule_file(spark, make_files):
    text = "rules:\n  - id: no-foo\n    pattern-regex: 'foo\\('\n    message: no foo\n    severity: ERROR\n    languages: [python]\n"
    from lintlake.operators.scan import scan_rules

    rows = scan_rules(make_files([("a.py", "python", "x\nfoo(1)"), ("b.js", "javascript", "foo(1)")]), parse_rules(text)).collect()
    assert [(r.path, r.rule, r.line, r.severity) for r in rows] == [("a.py", "no-foo", 2, "error")]


def test_rules_without_a_regex_are_named():
    regex = "  - id: a\n    pattern-regex: x\n"
    assert [r.rule for r in parse_rules("rules:\n" + regex)] == ["a"] and parse_rules("") == []
    for other in ("    pattern: foo($X)\n", "    patterns:\n      - pattern-regex: y\n      - pattern-not: z\n", "    pattern-either:\n      - pattern: y\n"):
        with pytest.raises(ValueError, match="b, c"):
            parse_rules("rules:\n  - id: b\n" + other + regex + "  - id: c\n" + other)


def test_broken_files(spark, make_files):
    broken = [("a.py", "python", "def f()\n  pass"), ("a.json", "json", '{"a": [1,, 2}'), ("a.toml", "toml", "a = [1,,2]"), ("a.xml", "xml", "<a><b></a>"),
              ("a.yaml", "yaml", ": x: y: ["), ("a.sh", "shell", "if x; then\n echo"), ("a.c", "c", "int main( {"), ("a.cpp", "cpp", "int f( {"),
              ("a.cs", "csharp", "void F( {"), ("a.kt", "kotlin", "fun f( {"), ("a.swift", "swift", "func f( {")]
    fine = [("b.py", "python", "x = 1"), ("b.json", "json", '{"a": [1, 2,], // note\n "u": "http://x"}'), ("b.toml", "toml", "a = 1"), ("b.sh", "shell", "if x; then\n  y\nfi"), ("b.c", "c", "int main() {")]
    rows = diagnostics.all_diagnostics(make_files(broken + fine)).collect()
    assert sorted(r.path for r in rows) == sorted(p for p, *_ in broken) and all(r.severity == "error" for r in rows)
    assert [r.line for r in rows if r.path == "a.py"] == [1]


def test_lenient_json():
    assert diagnostics.parse_lenient_json('{"a": "// no", /* c */ "b": [1, 2,],}') == {"a": "// no", "b": [1, 2]}


def test_python_checks(make_files):
    text = "def f(a, b: int):\n    return a\n\nclass K:\n    '''Doc.'''\n"
    rows = diagnostics.python_checks(make_files([("a.py", "python", text), ("b.py", "python", "def (")])).collect()
    issues = {(r.path, r.level, r.issue) for r in rows if r.kind == "issue"}
    assert ("a.py", "minor", "FunctionDef 'f' 缺少文档字符串") in issues and ("a.py", "minor", "参数 'a' 缺少类型提示") in issues
    assert [r.level for r in rows if r.path == "b.py"] == ["critical"]


def test_secrets_near_the_environment_are_left_out(make_files):
    text = "token = 'abc'\n" + "x" * 80 + "\nsecret = 'abc'  # os.environ\n"
    rows = taint.hardcoded_secrets(make_files([("a.py", "python", text)])).collect()
    assert [r.line for r in rows] == [1]


def test_taint_needs_a_source_in_the_file(make_files):
    files = make_files([("a.py", "python", "v = request.args\nx = 1\ncursor.execute(v)"), ("b.py", "python", "eval(x)")])
    rows = taint.taint_findings(files).collect()
    assert [(r.path, r.line, r.cwe, r.trace) for r in rows] == [("a.py", 3, "CWE-89", "Line 1: v = request.args")]


def test_targeted_fixers(make_files):
    text = "def f():\n    print('x')\npassword = 'hunter2'\ntry:\n    a()\n  except:\n    pass\nh = hashlib.md5(b)\n"
    row = rewrite.fix_all(make_files([("a.py", "python", text)])).collect()[0]
    assert "    logging.info('x')" in row.text and 'password = os.environ.get("PASSWORD")' in row.text
    assert "except Exception as e:" in row.text and "hashlib.sha256(b)" in row.text
    assert row.text.startswith("import os\nimport logging\n") and row.original == text
    assert row.applied == ["print_to_logging", "hardcoded_secrets", "bare_except", "weak_crypto"]


def test_resource_leak_and_diff(make_files):
    files = make_files([("a.py", "python", "f = open(p)\ndata = f.read()\nf.close()\n")])
    fixed = rewrite.fix_resource_leaks(files).collect()[0].text
    assert fixed.startswith("with open(p) as f:\n")
    diff = rewrite.unified_diffs(rewrite.apply_rewrites(make_files([("a.py", "python", "except:\n")]), rewrite.PYTHON_REWRITES)).collect()[0].diff
    assert diff.startswith("--- a/a.py\n+++ b/a.py\n") and "+except Exception as e:" in diff


def test_project_verdicts(spark, make_files):
    files = make_files([("a.py", "python", "print(1)\neval(x)\nx = 12345\n"), ("b.py", "python", "def f(:")])
    result = entry_points.analyze_project(files)
    gate = result["quality_gate"].collect()[0]
    assert gate.status == "fail" and "compiler diagnostics: 1" in gate.blockers
    assert result["scores"].collect()[0].quality_score < 100
    reasons = [r.reason for r in result["recommendations"].orderBy("step_order").collect()]
    assert reasons[0].startswith("Found ") and any(r.startswith("Compiler/type diagnostics reported 1") for r in reasons)
    assert result["hotspots"].count() == 2 and result["action_plan"].where("action LIKE 'Refactor hotspot%'").count() == 2


def test_clean_project_passes(spark):
    facts = spark.createDataFrame([("p", 0, 0, 0, 0, 0, 0, 0, 0, None)], "project string, issues long, errors long, warnings long, security long, complexity long, diagnostics long, toolchain_issues long, toolchain_warnings long, toolchain_action string")
    assert report.quality_gate(facts).collect()[0].status == "pass"
    assert report.quality_scores(facts).collect()[0].quality_score == 100


def test_kpi_and_votes(spark):
    kpi = spark.createDataFrame([("a", 0.0, -60.0, -80.0, "lower_better"), ("b", 0.0, 40.0, 30.0, "higher_better"), ("c", 1.0, 5.0, 1.0, "higher_better")],
                                "metric string, baseline double, current double, target double, direction string")
    assert [r.progress for r in team.kpi_progress(kpi).orderBy("metric").collect()] == [75.0, 100.0, 100.0]
    rows = [(1, 10, "gpt-4", 0.9, ["a", "b"], ["c"], 20), (1, 11, "other", 1.0, ["a"], [], 90)]
    votes = spark.createDataFrame(rows, "issue_id long, suggestion_id long, model string, confidence double, pros array<string>, cons array<string>, estimated_time int")
    best = team.best_fix(votes).collect()[0]
    assert (best.suggestion_id, best.model) == (10, "gpt-4") and abs(best.score - (45 + 10 - 3 + 10) * 1.2) < 1e-9


def test_listings(spark):
    from lintlake.rules import listings

    assert listings.package_managers(spark).count() == 11 and listings.dependency_checks(spark).count() == 3
    kinds = {r.kind: r["count"] for r in listings.log_patterns(spark).groupBy("kind").count().collect()}
    assert (kinds["security"], kinds["performance"], kinds["error_class"], kinds["format"]) == (8, 6, 7, 7)
    names = {r.rule for r in listings.supported_rules(spark, "rust").collect()}
    assert "unwrap" in names and "no-todo" in names and "no-print" not in names
    assert listings.languages_by_area(spark).where("area = 'jvm'").count() == 4


def test_yaml_repairs_per_line(make_files):
    text = "# note a:b\nkey:value\n\nrun: |\npattern: $X == $X\nregex: a+b\nmetavariable: $X\nname: \"open\nurl: http://x\n  - a::b >"
    want = "# note a:b\nkey: value\n\nrun: |\npattern: \"$X == $X\"\nregex: \"a+b\"\nmetavariable: \"$X\"\nname: \"open\"\nurl: http://x\n  - a::b >"
    row = rewrite.repair_yaml(make_files([("a.yaml", "yaml", text)])).collect()[0]
    assert row.fixed == want
    assert {f["rule"]: f["count"] for f in row.fixes} == {"Space After Colon": 1, "Quote Pattern": 1, "Quote Regex": 1, "Quote Metavariable": 1, "Close Quote": 1}
