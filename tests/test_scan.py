"""Positions of hits against brute force, and golden findings of small snippets."""

import re
import time
from dataclasses import replace

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lintlake.operators.scan import _test, dedup_findings, glob_regex, scan_first, scan_rules, search_pattern
from lintlake.operators.duplicates import repeated_text
from lintlake.plans.analysis import comprehensive_security, project_findings, quality_findings, sonar_style
from lintlake.rules import extra, quality, review, security
from lintlake.rules.model import Rule, rules_table


def rule(pattern, flags="", **kw):
    return Rule("t", "r", pattern, flags, "error", "c", "{match}", **kw)


def brute(text, pattern, flags=0):
    out = []
    for m in re.finditer(pattern, text, flags | re.ASCII):
        line = text.count("\n", 0, m.start()) + 1
        out.append((line, m.start() - text.rfind("\n", 0, m.start()), m.group()))
    return out


def scan(files, rules):
    rows = scan_rules(files, rules).select("line", "column", "match").collect()
    return sorted((r.line, r.column, r.match) for r in rows)


def test_positions_at_edges(make_files):
    texts = ["ab ab\nab", "\nab", "xab\r\nab\r\n", "éß ab 😀 ab", "none", "", "ab" * 700 + "\nab", "\u0001ab\u0002 ab"]
    for text in texts:
        assert scan(make_files([("f", "python", text)]), [rule("ab")]) == sorted(brute(text, "ab")), text[:20]


def test_hits_across_lines_are_reported_whole(make_files):
    text = "except:\n    pass\n\n\nexcept ValueError:\n  pass"
    pattern = r"except\s*[^:]*:\s*\n\s*pass"
    assert scan(make_files([("f", "python", text)]), [rule(pattern)]) == sorted(brute(text, pattern))


def test_leading_blank_lines_belong_to_the_hit(make_files):
    text = "\n\n   assert x\nassert y"
    assert scan(make_files([("f", "python", text)]), [rule(r"^\s*assert\s+", "m")]) == sorted(
        brute(text, r"^\s*assert\s+", re.M)
    )


def test_no_character_is_special(make_files):
    text = "x\u0001y \u0002\u0001< x\u0001y\nbegin\nmid\nend x\u0001y"
    for pattern in ("x\u0001y", r"begin[\s\S]*?end", "\u0002"):
        assert scan(make_files([("f", "python", text)]), [rule(pattern)]) == sorted(brute(text, pattern))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab\n\r é=\"'\u0001", max_size=40), min_size=1, max_size=6), st.sampled_from(["a", "a+b", r"\bab\b", r"a\s*=", r"^\s*b"]))
def test_positions_property(make_files, texts, pattern):
    flags = re.M if pattern.startswith("^") else 0
    files = make_files([(f"f{i}", "python", t) for i, t in enumerate(texts)])
    found = scan_rules(files, [rule(pattern, "m" if flags else "")]).select("path", "line", "column").collect()
    want = [(f"f{i}", ln, c) for i, t in enumerate(texts) for ln, c, _ in brute(t, pattern, flags)]
    assert sorted(map(tuple, found)) == sorted(want)


def test_kinds_first_threshold_blank_run_nesting(make_files):
    text = "a {\nb {\n" + "if (x) y();\n" * 12
    first = scan_rules(make_files([("f", "javascript", text)]), [rule(r"\{[^}]*$", "m", kind="first")]).collect()
    assert [(r.line, r.column) for r in first] == [(1, 3)]
    branches = [r for r in security.SONAR if r.kind == "threshold"]
    row = scan_rules(make_files([("f", "go", text)]), branches).collect()
    assert [(r.line, r.column, r.number) for r in row] == [(1, 1, 12)] and row[0].message.endswith("(Count: 12)")
    blank = [r for r in quality.GENERIC if r.kind == "blank_run"]
    rows = scan_rules(make_files([("f", "go", "a\n\n \n\n\nb\n\nc")]), blank).collect()
    assert sorted(r.line for r in rows) == [4, 5]
    deep = [r for r in quality.JAVASCRIPT if r.kind == "nesting"]
    rows = scan_rules(make_files([("f", "javascript", "x = '(((((';\n((((\n(1)))))")]), deep).collect()
    assert [(r.line, r.number) for r in rows] == [(3, 5)]


def test_every_anchor_is_implied_by_its_pattern(make_files):
    """Rules find the same with and without their literal prefilter."""
    from dataclasses import replace

    from bindings.corpus import STATEMENTS

    rows = [(f"{lang}{i}", lang, s) for lang in ("python", "javascript", "java", "go", "rust", "php") for i, s in enumerate(STATEMENTS)]
    files = make_files(rows).cache()
    rules = quality.ALL + security.COMPREHENSIVE + review.CODE_REVIEW
    key = ["path", "engine", "rule", "line", "column", "rule_order"]
    with_anchor = scan_rules(files, rules).select(*key)
    without = scan_rules(files, [replace(r, anchors=()) for r in rules]).select(*key)
    assert with_anchor.count() > 500
    assert without.exceptAll(with_anchor).isEmpty() and with_anchor.exceptAll(without).isEmpty()


def rules_found(files, rules):
    return {r.rule for r in scan_rules(files, rules).select("rule").distinct().collect()}


def test_python_security_snippet(make_files):
    text = "\n".join([
        "assert user", "exec(code)", 'password = "secret123"', "yaml.load(f)", "os.system(cmd)",
        "app.run(debug=True)", "requests.get(u, verify=False)", "jinja2.Environment(autoescape=False)",
    ])
    found = rules_found(make_files([("a.py", "python", text)]), security.BANDIT)
    assert {"B101-assert_used", "B102-exec_used", "B105-hardcoded_password_string", "B506-yaml_load",
            "B604-any_function_with_shell_equals_true", "B201-flask_debug_true", "B501-request_with_no_cert_validation",
            "B701-jinja2_autoescape_false"} <= found


def test_javascript_security_snippet(make_files):
    text = "child_process.exec(c);\nfs.readFile(d + x);\neval(y);\nnew Buffer(3);\no[k] = 1;\nvar r = /(a+b+c*)/;"
    found = rules_found(make_files([("a.js", "javascript", text)]), security.ESLINT)
    assert {"security/detect-child-process", "security/detect-non-literal-fs-filename", "security/detect-eval-with-expression",
            "security/detect-new-buffer", "security/detect-object-injection", "security/detect-unsafe-regex"} <= found


def test_error_and_review_snippets(make_files):
    js = "for (let i <= a.length; i++) {}\nif (a = 1) {}\nif (p !== null) { p.x }\nwhile (true) {}\nvar a;\n// TODO x\n"
    assert {"offByOne", "assignmentInCondition", "nullDereference", "alwaysTrue"} <= rules_found(
        make_files([("a.js", "javascript", js)]), review.ERRORS)
    py = "def f(a=[]):\n  global b\n  try:\n    x\n  except:\n    pass"
    assert {"mutableDefault", "globalStatement", "bareExcept"} == rules_found(
        make_files([("a.py", "python", py)]), review.LANGUAGE_SPECIFIC)


def test_rule_counts(spark):
    assert [len(x) for x in (security.GENERAL, security.PYTHON, security.JAVASCRIPT, security.BANDIT, security.ESLINT)] == [41, 5, 3, 20, 15]
    assert len(security.SONAR) + 1 == 10 and len(security.SEMGREP) == 10
    assert [len(x) for x in (review.ERRORS, review.REVIEW, review.LANGUAGE_SPECIFIC)] == [12, 12, 9]
    assert [len(extra.FRAMEWORK), len(extra.COMPLIANCE_TEXT) + len(extra.COMPLIANCE_BODIES), len(extra.LANGUAGE_EXTENSIONS)] == [18, 18, 17]
    table = rules_table(spark, quality.ALL + security.COMPREHENSIVE)
    assert table.where(F.array_contains("languages", "python")).count() > 20


def test_dedup_keeps_the_first_engine_and_is_idempotent(make_files):
    files = make_files([("a.py", "python", "password = 'abcdefghij'\npasswd = 'abcdefghij'")])
    once = comprehensive_security(files)
    assert once.count() == dedup_findings(once).count()
    assert once.groupBy("path", "rule", "line", "column").count().where("count > 1").isEmpty()


def test_project_findings_treats_test_files_like_their_language(make_files):
    rows = project_findings(make_files([("a.test.ts", "typescript-test", "console.log(1);\neval(x)\n// TODO a")]), python_jobs=True)
    found = {(r.engine, r.rule) for r in rows.collect()}
    assert ("quality-generic", "no-todo") in found and ("security", "security-xss") in found
    assert ("quality-javascript", "no-console") not in found and {r.language for r in rows.collect()} == {"typescript"}


def test_search_and_globs(make_files):
    files = make_files([("src/a.py", "python", "x = 1\ny = token"), ("src/b.js", "javascript", "token")])
    assert [r.path for r in search_pattern(files, "token", "*.py").collect()] == ["src/a.py"]
    assert re.search(glob_regex("src/**/*.js"), "src/x/y.js") and not re.search(glob_regex("src/*.js"), "src/x/y.js")


def test_long_functions_and_repeats_are_findings(make_files):
    unit = "0123456789" * 5 + "xyz"
    py = "def big():\n" + "    a()\n" * 60 + "x = '" + unit + unit + "'\n"
    files = make_files([("b.py", "python", py), ("c.go", "go", unit + unit)])
    rules = lambda frame: sorted((r.path, r.line, r.column) for r in frame.collect() if r.rule == "sonar-duplicate-code")
    lines = [(r.path, r.line, r.column) for r in repeated_text(files).collect()]
    assert ("b.py", 62, 6) in lines and ("c.go", 1, 1) in lines
    assert rules(comprehensive_security(files)) == rules(sonar_style(files)) == sorted(lines)
    project = project_findings(files).collect()
    assert sorted((r.path, r.line, r.column) for r in project if r.rule == "sonar-duplicate-code") == sorted(x for x in lines if x[0] == "b.py")
    assert [(r.path, r.line) for r in project if r.rule == "max-lines-per-function"] == [("b.py", 1)]
    assert [r.path for r in quality_findings(files).collect() if r.rule == "max-lines-per-function"] == ["b.py"]


def test_first_rule_keeps_a_place_inside_the_row(make_files):
    """Rules that share a name: the same findings as the shuffled form, without an exchange."""
    texts = ["el.innerHTML = a; document.write(b);\neval(x); password = 'abcdef'\nh = md5(d)", "", "sha1(x) md5(y)\n\n" * 300, "x = 1", "é eval(é)\npickle.loads(b)"]
    files = make_files([(f"f{i}.js", "javascript" if i % 2 else "python", t) for i, t in enumerate(texts)])
    # The same rules again under another engine: all their places are taken already.
    rules = security.COMPREHENSIVE + [replace(r, engine="later") for r in security.GENERAL]
    labels = [r.rule for r in rules]
    merged, every = scan_first(files, rules, labels), scan_rules(files, rules)
    wanted = dedup_findings(every)
    assert sorted(map(tuple, merged.collect()), key=repr) == sorted(map(tuple, wanted.collect()), key=repr)
    assert 0 < merged.count() < every.count() and merged.where("engine = 'later'").isEmpty()
    apart = scan_first(files, rules, range(len(rules)))
    assert sorted(map(tuple, apart.collect()), key=repr) == sorted(map(tuple, every.collect()), key=repr)
    for scan in (merged, comprehensive_security(files), project_findings(files)):
        assert "Exchange" not in scan._jdf.queryExecution().executedPlan().toString()


def test_probes_decide_as_their_patterns_do(spark):
    """A rule's probe and least length hit the very texts that its pattern hits, and a probe does not read the text anew from every line."""
    import random

    from lintlake.functions.text import java_regex

    rng = random.Random(4)
    words = ["const", "let a = 1", "xlet b", "return x", "import y;", "export", "#", "# c", ";", "\n", "\n", "\r\n", " ", "é", "function f(a) {", "}", "function g(){" + "x" * 500, "_var q", "var\n\n"]
    texts = ["".join(rng.choice(words) for _ in range(rng.randint(0, 9))) for _ in range(3000)]
    texts += ["function a(){" + "y" * n + "}" for n in (499, 500, 501)] + [None, ""]
    rules = [r for r in review.CODE_REVIEW if r.probe or r.shortest]
    assert {r.rule for r in rules} == {"missingSemicolon", "clarity-longFunction"}
    docs = spark.createDataFrame([(t,) for t in texts], "text string").selectExpr("text", "lower(text) AS _lower", "'go' AS language")
    for r in rules:
        plain = F.coalesce(F.col("text").rlike(java_regex(r.pattern, r.flags)), F.lit(False))
        got = docs.select(plain.alias("want"), F.coalesce(F.expr(_test(r)), F.lit(False)).alias("got")).collect()
        assert [x.got for x in got] == [x.want for x in got]
        assert 0 < sum(x.want for x in got) < len(got)
    # 12,000 lines without a hit: the pattern alone would try every line start against the rest of the text.
    long = spark.createDataFrame([("const;\n" * 12000,)], "text string").selectExpr("text", "lower(text) AS _lower", "'go' AS language")
    start = time.monotonic()
    assert not long.select(F.expr(_test(next(r for r in rules if r.probe)))).first()[0]
    assert time.monotonic() - start < 10


def test_probes_of_security_and_quality_packs(spark):
    """Probes hit the very texts that their patterns hit; a long word is not read anew from each of its characters."""
    import random

    from lintlake.functions.text import java_regex

    rng = random.Random(7)
    words = ["go", "public ", "f(a)", "(", ")", "{", "}", " ", "\n", "é", "_", "if", "else if", "case", "iff", " if ", "case\n", "const x = 1;", "let y=", "var  z =", ";", "=", "a;b", "()",
             "PASSWORD", "token = '", "api_key=\"", "apikey", "credential", "12345678", "'", '"', "md5", "SHA1 ", "des(", "MD2", "x200", "1999", "2.5", "300", "12", " 4", "٣٤٥٦"]
    texts = ["".join(rng.choice(words) for _ in range(rng.randint(0, 14))) for _ in range(6000)] + [" if case " * n for n in range(9)] + [None, ""]
    rules = [r for r in security.COMPREHENSIVE + quality.ALL if r.probe]
    assert len({r.rule for r in rules}) == 6
    docs = spark.createDataFrame([(t,) for t in texts], "text string").selectExpr("text", "lower(text) AS _lower", "'javascript' AS language").repartition(4).cache()
    for r in rules:
        pattern = F.lit(java_regex(r.pattern, r.flags))
        plain = F.regexp_count("text", pattern) >= r.threshold if r.kind == "threshold" else F.regexp_like("text", pattern)
        got = docs.select(F.coalesce(plain, F.lit(False)).alias("want"), F.coalesce(F.expr(_test(r)), F.lit(False)).alias("got")).collect()
        assert [x.got for x in got] == [x.want for x in got], r.rule
        assert 0 < sum(x.want for x in got) < len(got), r.rule
    long = spark.createDataFrame([("{" + "word_" * 60_000,)], "text string").selectExpr("text", "lower(text) AS _lower", "'go' AS language")
    start = time.monotonic()
    assert not long.select(F.expr(_test(next(r for r in rules if r.rule == "sonar-empty-method")))).first()[0]
    assert time.monotonic() - start < 10


def test_files_whose_brackets_stay_flat_pay_no_fold(make_files):
    from lintlake.operators.scan import _prepared

    flat, deep = "go(a[1]); " * 30 + "{ f(g(1)) }", "{ ( [ { (\nx) } ] ) }"
    quoted = 'f("((((((");'
    files = make_files([("a.js", "javascript", flat), ("b.js", "javascript", deep), ("c.js", "javascript", quoted)])
    prepared, _ = _prepared(files, quality.ALL)
    assert [r.path for r in prepared.where("_nesting is not null").collect()] == ["b.js"]
    hits = scan_rules(files, quality.ALL).where("rule = 'max-nesting-depth'").collect()
    assert [(r.path, r.line, r.number) for r in hits] == [("b.js", 1, 5)]


def test_the_action_plan_scans_once(spark, tmp_path, monkeypatch):
    from bindings import report_queries

    files = spark.createDataFrame([("p", "a.py", "python", "print(1)"), ("q", "b.js", "javascript", "debugger;")], "project string, path string, language string, text string")
    files.write.parquet(f"{tmp_path}/files")
    calls = []
    monkeypatch.setattr(report_queries, "corpus", lambda s, d: s.read.parquet(f"{d}/files"))
    monkeypatch.setattr(report_queries, "scan_rules", lambda f, rules: calls.append(1) or scan_rules(f, rules))
    plan = report_queries.QUERIES["G7_action_plan"](spark, str(tmp_path)).collect()
    assert len(calls) == 1
    assert sorted(r.reason for r in plan if r.step_order > 4) == ["High issue/complexity score (1 issues, CC=1)."] * 2
