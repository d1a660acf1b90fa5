"""Bodies, metrics, graphs and duplicates."""

import random
from collections import Counter
import re

from pyspark.sql import functions as F

from lintlake.functions.brackets import may_nest, nesting_depth, nesting_profile
from lintlake.operators import graph, metrics, structure
from lintlake.operators.duplicates import duplicate_blocks, immediate_repeats, repeated_text
from lintlake.plans.analysis import compliance_findings


def test_balanced_bodies(make_files):
    js = "function f(a) { if (a) { g(); } return 1; }\nconst h = (x) => { y(); };\nclass C extends D { m() { } }"
    units = {(r.kind, r.name): r.body for r in structure.code_units(make_files([("a.js", "javascript", js)])).collect()}
    assert units[("function", "f")] == " if (a) { g(); } return 1; " and units[("function", "h")] == " y(); "
    assert units[("class", "C")] == " m() { } "
    py = "class A:\n    def f(self):\n        return 1\n\n    def g(self):\n        pass\nx = 1\n"
    units = {(r.kind, r.name): (r.line, r.body) for r in structure.code_units(make_files([("a.py", "python", py)])).collect()}
    assert units[("function", "f")][0] == 2 and "return 1" in units[("function", "f")][1] and "pass" not in units[("function", "f")][1]
    assert "def g" in units[("class", "A")][1] and "x = 1" not in units[("class", "A")][1]


def test_long_functions(make_files):
    js = "function big() {\n" + "a();\n" * 60 + "}\nfunction small() { }\n"
    py = "def big():\n" + "    a()\n" * 60 + "def small():\n    pass\n"
    rows = structure.long_functions(make_files([("a.js", "javascript", js), ("b.py", "python", py)])).collect()
    # Two start patterns meet "function big() {" at different offsets, so it counts twice.
    assert sorted((r.path, r.line) for r in rows) == [("a.js", 1), ("a.js", 1), ("b.py", 1)]
    assert all("Function is too long (6" in r.message for r in rows)


def test_function_and_class_metrics(make_files):
    js = "function f(a) {\n  if (a && b) { for (;;) { if (c) { } } }\n}\nclass K { m() { this.x = 1; } }"
    units = structure.code_units(make_files([("a.js", "javascript", js)]))
    f = [r for r in structure.function_metrics(units).collect() if r.name == "f"][0]
    assert (f.cyclomatic, f.nesting_depth, f.risk_level) == (5, 3, "medium") and 0 <= f.maintainability_index <= 100
    k = structure.class_metrics(units).collect()[0]
    assert (k.name, k.methods, k.fields, k.cohesion, k.risk_level) == ("K", 1, 1, 80, "low")


def test_complexity_report_and_missing_file(spark, make_files):
    report = structure.complexity_report(make_files([("a.js", "javascript", "function f() { }\n"), ("b.py", "python", "x = 1")]))
    rows = {r.path: r for r in report.collect()}
    assert rows["a.js"].total_functions == 1 and rows["b.py"].average_maintainability_index == 100
    asked = spark.createDataFrame([("a.js",), ("zz.js",)], "path string")
    errors = {r.path: r.error for r in structure.compare_complexity(report, asked).collect()}
    assert errors == {"a.js": None, "zz.js": "File not found: zz.js"}


def test_compliance_bodies(make_files):
    bad = "def save_card(n):\n    db.save(n)\n"
    good = "def save_card(n):\n    masked = mask_card(n)\n    db.save(masked)\n"
    rows = compliance_findings(make_files([("bad.py", "python", bad), ("good.py", "python", good)])).collect()
    assert [(r.path, r.rule) for r in rows] == [("bad.py", "pci-plaintext-card-storage")]


def test_empty_text_metrics(make_files):
    files = make_files([("a.py", "python", "")])
    row = metrics.line_metrics(files).collect()[0]
    assert (row.lines_of_code, row.blank_lines, row.code_lines) == (1, 1, 0)
    assert metrics.halstead_metrics(files).collect()[0].maintainability_index == 100.0


def test_inheritance_cycles_end(make_files):
    js = "class A extends B { }\nclass B extends A { }\nclass C extends A { }\nclass D extends Object { }\nclass E extends Gone { }"
    depths = graph.inheritance_depth(structure.inheritance_edges(make_files([("a.js", "javascript", js)])))
    assert {r.class_name: r.depth for r in depths.collect()} == {"A": 1, "B": 1, "C": 2, "D": 0, "E": 1}


def _components(edges):
    nodes = {x for e in edges for x in e}
    reach = {n: {b for a, b in edges if a == n} for n in nodes}
    for _ in nodes:
        for n in nodes:
            reach[n] |= {y for x in reach[n] for y in reach[x]}
    return {n: min(x for x in nodes if x in reach[n] and n in reach[x]) for n in nodes if n in reach[n]}


def test_circular_modules_against_brute_force(spark):
    rng = random.Random(3)
    names = [f"m{i}" for i in range(12)]
    edges = sorted({(rng.choice(names), rng.choice(names)) for _ in range(16)} - {(n, n) for n in names})
    df = spark.createDataFrame([("p", a, b) for a, b in edges], "project string, module string, imported string")
    assert {r.module: r.cycle for r in graph.circular_modules(df).collect()} == _components(edges)
    chain = spark.createDataFrame([("p", "a", "b"), ("p", "b", "c")], "project string, module string, imported string")
    assert graph.circular_modules(chain).isEmpty()


def test_circular_modules_of_many_shapes(spark):
    """Sparse graphs fold along and against their edges; dense ones go round by round."""
    rng = random.Random(11)
    rows, want = [], {}
    for g in range(40):
        names = [f"m{i:02d}" for i in range(rng.randint(2, 10))]
        edges = {(rng.choice(names), rng.choice(names)) for _ in range(int(len(names) * rng.choice([1, 1.5, 4])))} - {(n, n) for n in names}
        rows += [(f"p{g}", a, b) for a, b in edges]
        want.update({(f"p{g}", n): c for n, c in _components(edges).items()})
    df = spark.createDataFrame(rows, "project string, module string, imported string")
    found = graph.circular_modules(df).collect()
    assert {(r.project, r.module): r.cycle for r in found} == want
    sizes = Counter((r.project, r.cycle) for r in found)
    assert all(r["size"] == sizes[r.project, r.cycle] for r in found)


def test_long_chains_take_few_jobs(spark):
    """A chain of 2,000 modules into a cycle: jobs grow with the logarithm of its length."""
    chain = [("p", f"n{i:04d}", f"n{i + 1:04d}") for i in range(2000)] + [("p", "n2000", "n1995")]
    spark.sparkContext.setJobGroup("chain", "a long chain")
    found = graph.circular_modules(spark.createDataFrame(chain, "project string, module string, imported string")).collect()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("chain"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {(r.cycle, r["size"]) for r in found} == {("n1995", 6)} and len(found) == 6
    assert jobs < 80


def test_call_neighbourhood(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "a"), ("b", "a")], "caller string, callee string")
    rows = {tuple(r) for r in graph.neighbourhood(edges, "a", 2).collect()}
    assert rows == {("callees", "b", 1), ("callees", "c", 2), ("callers", "x", 1), ("callers", "b", 1)}


def test_repeats_match_the_backreference(make_files):
    rng = random.Random(5)
    for i in range(30):
        text = "".join(rng.choice("ab\n") for _ in range(rng.choice([80, 200, 400])))
        if i % 2:
            unit = "".join(rng.choice("abcdef") for _ in range(rng.choice([50, 63])))
            text += unit * 2 + unit[:i]
        assert immediate_repeats(text) == [m.start() for m in re.finditer(r"(.{50,})\1", text, re.S)]
    unit = "0123456789" * 5 + "xyz"
    row = repeated_text(make_files([("a.go", "go", "head\n" + unit + unit)])).collect()
    assert [(r.line, r.column) for r in row] == [(2, 1)]


def test_duplicate_blocks(make_files):
    block = "one\n  two\nthree\n"
    rows = duplicate_blocks(make_files([("a", "go", block + "x\n" + block), ("b", "go", "\n\n" + block)]), 3).collect()
    assert [(r.copies, r.files) for r in rows] == [(3, 2)]


def test_repeats_in_periodic_text_grow_linearly():
    import time

    from lintlake.operators.duplicates import immediate_repeats

    spent = []
    for n in (100_000, 200_000):
        start = time.perf_counter()
        assert immediate_repeats("a" * n) == [0]
        spent.append(time.perf_counter() - start)
    assert spent[1] < 3 * spent[0]


def test_repeats_equal_brute_force_on_mixed_periods():
    import random

    from lintlake.operators.duplicates import immediate_repeats

    def brute(text, shortest):
        out, i = [], 0
        while i < len(text):
            half = next((h for h in range((len(text) - i) // 2, shortest - 1, -1) if text[i : i + h] == text[i + h : i + 2 * h]), 0)
            out += [i] * bool(half)
            i += 2 * half or 1
        return out

    rng = random.Random(1)
    for _ in range(400):
        words = ("".join(rng.choices("ab" if rng.random() < 0.5 else "abcdefgh", k=rng.choice([rng.randint(1, 9), rng.randint(20, 40)]))) * rng.randint(1, 7) for _ in range(rng.randint(1, 5)))
        text = "".join(words)[:260]
        assert immediate_repeats(text, 20) == brute(text, 20), text


def test_texts_without_repeats_stay_out_of_the_search():
    import random

    import pyarrow as pa

    from lintlake.operators import duplicates

    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdé√") for _ in range(n))
    plain = [word(rng.randint(0, 400)) for _ in range(300)] + [word(60_000), "", "x" * 99]
    repeated = [word(rng.randint(0, 90)) + word(rng.randint(50, 90)) * 2 + word(9) for _ in range(50)] + ["ab" * 50, "a" * 100]
    texts = plain + repeated
    rng.shuffle(texts)
    chosen = [texts[i] for i in duplicates.rows_that_may_repeat(pa.array(texts))]
    assert set(repeated) <= set(chosen) and len(chosen) <= len(repeated) + 3
    assert not len(duplicates.rows_that_may_repeat(pa.array([], pa.string()))) and not len(duplicates.rows_that_may_repeat(pa.array([""])))
    # A long text is searched at the distances of recurring stretches only.
    tail = word(70)
    codes = duplicates._gram_hashes(duplicates.np.frombuffer((plain[0] + word(20_000) + tail * 2).encode("utf-32-le"), dtype="u4"))
    assert len(duplicates._periods(codes, 50, len(codes) + 15)) < 5


def test_rows_of_one_row_group_are_dealt_out(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    from bindings.corpus import long_files, read
    from lintlake.sources.files import spread

    keys = list(range(20_000))
    pq.write_table(pa.table({"doc_id": keys, "text": [f"text {k} {k * k}" for k in keys]}), f"{tmp_path}/documents.parquet")
    pq.write_table(pa.table({"c_custkey": keys[:2000]}), f"{tmp_path}/customer.parquet")
    held = lambda df: [n for n in df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    cores, before = spark.sparkContext.defaultParallelism, spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        # Many splits, but the rows of one row group lie in one of them.
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        table = spark.read.parquet(f"{tmp_path}/documents.parquet")
        assert table.rdd.getNumPartitions() > cores and held(table) == [20_000]
        dealt = held(spread(table, "doc_id"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sum(dealt) == 20_000 and max(dealt) < 20_000 / cores
    assert max(held(long_files(spark, str(tmp_path)))) < 2000 / cores
    assert read(spark, str(tmp_path), "customer").count() == 2000


def test_words_are_counted_in_their_row_unless_a_path_stands_in_several(spark, monkeypatch):
    """Totals equal those of (project, path, name) groups, with paths and projects repeated or null, and no path travels with the words."""
    rng = random.Random(2)
    texts = [None, "", "  ", "a", "é a_b 1 a"] + [" ".join(rng.choice("a b c def x1 é") for _ in range(rng.randint(1, 60))) for _ in range(60)]
    keys = [("p", "one"), ("p", "two"), ("q", "one"), (None, "one"), ("p", None), (None, None)]
    rows = [(*rng.choice(keys), t) for t in texts * 2] + [("r", f"own{i}", t) for i, t in enumerate(texts)]
    for some, limit in ((rows, structure.SHARED_PATHS), (rows, 2), ([x for x in rows if x[0] == "r"], structure.SHARED_PATHS)):
        monkeypatch.setattr(structure, "SHARED_PATHS", limit)
        files = spark.createDataFrame(some, "project string, path string, text string")
        groups = structure.word_uses(files).groupBy("name").agg(F.count("*").alias("used_in"), F.sum("uses").alias("uses"))
        got = structure.word_totals(files)
        assert got.dtypes == groups.dtypes
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, groups.collect()))
    # The last files share no path.
    assert "hashpartitioning(project" not in got._jdf.queryExecution().executedPlan().toString()


def test_symbols_of_texts_without_a_keyword(spark):
    """Texts skip the patterns whose keyword they lack; the others give all their names."""
    texts = ["def f(): pass", "function g() {}\nfunc h() {}", "fn i()", "class J: pass", "import k\nfrom l.m import n", "import x from 'y'; const z = require('w')", "define functional", "", None]
    files = spark.createDataFrame([("p", str(i), "python", t) for i, t in enumerate(texts)], "project string, path string, language string, text string")
    got = sorted((r.path, r.kind, r.name) for r in structure.symbols(files).collect())
    assert got == [("0", "function", "f"), ("1", "function", "g"), ("1", "function", "h"), ("2", "function", "i"), ("3", "class", "J"),
                   ("4", "import", "k"), ("4", "import", "l.m"), ("5", "import", "w"), ("5", "import", "x"), ("5", "import", "y")]


def test_depth_by_runs_and_its_bound_agree_with_the_fold(spark):
    pick = random.Random(5)
    marks = ["{", "}", "(", ")", "[", "]", "\n", "a", '"', "'", "`", "\\", "/", "//", "/*", "*/", "({[", "])}"]
    texts = ["".join(pick.choice(marks) for _ in range(pick.randint(0, 40))) for _ in range(3000)] + ["((((([a]))))", None]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(
        nesting_profile("text", False)["depth"].alias("every"), nesting_depth("text").alias("runs"),
        nesting_profile("text", True)["depth"].alias("depth"), *[may_nest("text", n).alias(f"may{n}") for n in (3, 5)]).collect()
    assert [r.every for r in rows] == [r.runs for r in rows]
    for n in (3, 5):
        assert any(r.depth is not None and r.depth >= n for r in rows) and any(r[f"may{n}"] is False for r in rows)
        assert not [r for r in rows if r.depth is not None and r.depth >= n and not r[f"may{n}"]]


def test_heads_hold_their_words():
    """Units by heads whose words stand in the text are those by all heads."""
    pick = random.Random(6)
    marks = ["function ", "const ", "let ", "var ", "class ", "def ", "func ", "fn ", "public ", "async ", "extends B ", "f", "x", "(", ")", "{", "}", "=", "=>", ":", " ", "\n", "() {", "(a):", " = (b) => {", ": function (c) {"]
    some = 0
    for language, heads in structure.FUNCTION_HEADS.items():
        assert len(heads) == len(structure.HEAD_WORDS[language])
        for _ in range(3000):
            text = "".join(pick.choice(marks) for _ in range(pick.randint(1, 12)))
            for head, words in [*zip(heads, structure.HEAD_WORDS[language]), *[(c, structure.CLASS_WORDS) for c in structure.CLASS_HEADS.values()]]:
                if re.search(head, text, re.ASCII | re.MULTILINE):
                    some += 1
                    assert structure._may_hold(text, words), (head, text)
    assert some > 500


def test_texts_are_derived_once_for_units(spark):
    """The test for heads does not repeat the expression that makes the text."""
    files = spark.range(3).selectExpr("'p' AS project", "cast(id AS string) AS path", "'go' AS language", "concat('func f', sha1(cast(id AS string)), '() { }') AS text")
    plan = structure.code_units(files)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sha1(") == 1
    assert structure.code_units(files).count() == 3
