"""Functions, classes, symbols and edges of source files.

Starts of functions and classes are found by regex; their bodies need balanced
braces or indentation, which no built-in expression gives. That one step runs
over Arrow batches; all metrics of the bodies are native expressions again.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from functools import reduce
from operator import and_, or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.functions.brackets import cognitive_complexity, nesting_depth
from lintlake.functions.text import computed_once, count_matches, java_regex, line_count
from lintlake.operators.metrics import (
    cyclomatic_complexity,
    function_risk,
    halstead,
    halstead_numbers,
    risk_band,
)
from lintlake.rules.quality import (
    JS_FUNCTION_STARTS,
    LONG_FUNCTION_LINES,
    LONG_FUNCTION_MESSAGE,
    PY_FUNCTION_START,
)

KEYS = ["project", "path", "language"]
# Heads of functions and classes by language; group 1 is the name.
FUNCTION_HEADS = {
    "javascript": [
        r"(?:async\s+)?function\s+(\w+)\s*\([^)]*\)\s*\{",
        r"(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?\([^)]*\)\s*(?:=>|\{)",
        r"(\w+)\s*:\s*(?:async\s+)?function\s*\([^)]*\)\s*\{",
    ],
    "typescript": [
        r"(?:async\s+)?function\s+(\w+)\s*\([^)]*\)\s*(?::\s*\w+)?\s*\{",
        r"(?:const|let|var)\s+(\w+)\s*:\s*(?:[^=]+)?\s*=\s*(?:async\s+)?\([^)]*\)\s*(?:=>|\{)",
    ],
    "python": [r"^[ \t]*(?:async\s+)?def\s+(\w+)\s*\([^)]*\)\s*(?:->\s*[^:\n]+)?:"],
    "java": [r"(?:public|private|protected)?\s*(?:static)?\s*\w+\s+(\w+)\s*\([^)]*\)\s*(?:throws\s+\w+)?\s*\{"],
    "go": [r"func\s+(?:\([^)]+\)\s*)?(\w+)\s*\([^)]*\)\s*(?:\([^)]+\))?\s*\{"],
    "rust": [r"fn\s+(\w+)\s*\([^)]*\)\s*(?:->\s*[^{]+)?\s*\{"],
}
CLASS_HEADS = {
    "javascript": r"class\s+(\w+)(?:\s+extends\s+\w+)?\s*\{",
    "typescript": r"class\s+(\w+)(?:\s+extends\s+\w+)?(?:\s+implements\s+[\w,\s]+)?\s*\{",
    "python": r"^[ \t]*class\s+(\w+)(?:\s*\([^)]*\))?\s*:",
    "java": r"class\s+(\w+)(?:\s+extends\s+\w+)?(?:\s+implements\s+[\w,\s]+)?\s*\{",
}
# Per head, groups of literals: a text that lacks all of a group holds no such head.
_NAMED, _ASSIGNED = (("function",),), (("const", "let", "var"), ("=",), ("(",))
HEAD_WORDS = {
    "javascript": [_NAMED, _ASSIGNED, (("function",), (":",))], "typescript": [_NAMED, _ASSIGNED], "python": [(("def",),)],
    "java": [(("{",), ("(",))], "go": [(("func",),)], "rust": [(("fn",),)],
}
CLASS_WORDS = (("class",),)


def _may_hold(text: str, groups) -> bool:
    return all(any(word in text for word in group) for group in groups)


def closing_braces(text: str) -> dict[int, int]:
    """Place of the closing brace for each opening one, in one pass."""
    stack, pairs = [], {}
    for m in re.finditer(r"[{}]", text):
        if m.group() == "{":
            stack.append(m.start())
        elif stack:
            pairs[stack.pop()] = m.start()
    return pairs


def _indent_end(text: str, start: int, head_end: int, starts: list[int]) -> int:
    """End of an indented block: the last line deeper than its head."""
    line = bisect_right(starts, start) - 1
    base = len(text[starts[line] :]) - len(text[starts[line] :].lstrip(" \t")) if line < len(starts) else 0
    end = text.find("\n", head_end)
    end = len(text) if end < 0 else end
    at = bisect_right(starts, head_end)
    for i in range(at, len(starts)):
        stop = starts[i + 1] - 1 if i + 1 < len(starts) else len(text)
        content = text[starts[i] : stop]
        bare = content.lstrip(" \t")
        if bare.strip() and not bare.startswith("#"):
            if len(content) - len(bare) <= base:
                break
            end = stop
    return end


def bodies(text: str, patterns, indented: bool):
    """(start, name, body) of every unit whose head a pattern finds."""
    pairs = starts = None
    for pattern in patterns:
        for m in re.finditer(pattern, text, re.ASCII | re.MULTILINE):
            # Only texts with a head pay for the places of braces or lines.
            if indented:
                starts = [0] + [n.end() for n in re.finditer("\n", text)] if starts is None else starts
                end = _indent_end(text, m.start(), m.end(), starts)
                yield m.start(), m.group(1), text[m.end() : end].lstrip(" \t")
                continue
            opening = m.end() - 1 if text[m.end() - 1] == "{" else None
            if opening is None:
                rest = re.compile(r"\s*\{").match(text, m.end())
                opening = rest.end() - 1 if rest else None
            if opening is None:
                stop = text.find("\n", m.end())
                yield m.start(), m.group(1), text[m.end() : len(text) if stop < 0 else stop]
            else:
                pairs = closing_braces(text) if pairs is None else pairs
                yield m.start(), m.group(1), text[opening + 1 : pairs.get(opening, len(text))]


_UNIT = "project string, path string, language string, kind string, name string, line int, body string"


def _extract(batches):
    for batch in batches:
        out = {n: [] for n in ("project", "path", "language", "kind", "name", "line", "body")}
        for project, path, language, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
            of = language if language in FUNCTION_HEADS else "javascript"
            heads = [p for p, words in zip(FUNCTION_HEADS[of], HEAD_WORDS[of]) if _may_hold(text, words)]
            classes = [CLASS_HEADS.get(language, CLASS_HEADS["javascript"])] if _may_hold(text, CLASS_WORDS) else []
            for kind, patterns in (("function", heads), ("class", classes)):
                for start, name, body in bodies(text, patterns, language == "python"):
                    row = (project, path, language, kind, name, text.count("\n", 0, start) + 1, body)
                    for key, value in zip(out, row):
                        out[key].append(value)
        yield pa.RecordBatch.from_pydict(out, schema=_ARROW_UNIT)


_ARROW_UNIT = pa.schema(
    [(n, pa.int32() if n == "line" else pa.string()) for n in ("project", "path", "language", "kind", "name", "line", "body")]
)


def _may_have_units() -> Column:
    """Whether the literals of some head of the file's language stand in its text."""

    def held(heads):
        tests = [reduce(and_, (reduce(or_, (F.contains("text", F.lit(w)) for w in group)) for group in groups)) for groups in heads]
        return reduce(or_, tests)

    functions = None
    for language, heads in HEAD_WORDS.items():
        if language != "javascript":
            test = F.col("language") == language
            functions = F.when(test, held(heads)) if functions is None else functions.when(test, held(heads))
    return held([CLASS_WORDS]) | functions.otherwise(held(HEAD_WORDS["javascript"]))


def code_units(files: DataFrame) -> DataFrame:
    """Functions and classes with balanced bodies; files without the words of any head stay in the JVM."""
    # A generator, not a filter: a filter is pushed down to where the text comes from and derives it anew for each word.
    held = files.select(*KEYS, F.explode(F.when(_may_have_units(), F.array("text"))).alias("text"))
    return held.mapInArrow(_extract, _UNIT)


def function_metrics(units: DataFrame) -> DataFrame:
    """Complexity, Halstead and risk of each function body."""
    functions = computed_once(units.where(F.col("kind") == "function"), KEYS, [
        F.coalesce("name", F.lit("anonymous")).alias("name"),
        F.col("line"),
        line_count("body").cast("bigint").alias("lines"),
        cyclomatic_complexity("body", "language").alias("cyclomatic"),
        cognitive_complexity("body").cast("bigint").alias("cognitive"),
        halstead("body").alias("_h"),
        nesting_depth("body").alias("nesting_depth"),
    ])
    derived = {c: i for i, c in enumerate(("n1", "n2"))}
    numbers = halstead_numbers("_h")
    return functions.select(
        *KEYS, "name", "line", "lines", "cyclomatic", "cognitive", "nesting_depth",
        numbers[derived["n1"]], numbers[6], numbers[-1],
        function_risk("cyclomatic", "cognitive", "lines").alias("risk_level"),
    )


# Methods and fields by language, and references to other modules.
METHODS = {
    "javascript": r"(?:async\s+)?\w+\s*\([^)]*\)\s*\{", "python": r"def\s+\w+\s*\(",
    "java": r"(?:public|private|protected)\s+\w+\s+\w+\s*\(",
}
FIELDS = {
    "javascript": r"(?:this\.)?\w+\s*=", "python": r"self\.\w+\s*=",
    "java": r"(?:public|private|protected)\s+\w+\s+\w+\s*;",
}
COUPLING = [r"import\s+.*\s+from\s+['\"]([^'\"]+)['\"]", r"require\s*\(['\"]([^'\"]+)['\"]\)", r"use\s+([^;]+);"]


def _by_language(table: dict, text: str) -> Column:
    return (
        F.when(F.col("language") == "python", count_matches(text, table["python"]))
        .when(F.col("language") == "java", count_matches(text, table["java"]))
        .otherwise(count_matches(text, table["javascript"]))
    )


def class_metrics(units: DataFrame) -> DataFrame:
    """Methods, fields, coupling, cohesion (lower bound of its band) and risk."""
    classes = units.where(F.col("kind") == "class").select(
        *KEYS,
        "name",
        "line",
        line_count("body").cast("bigint").alias("lines"),
        F.length("body").alias("_size"),
        _by_language(METHODS, "body").alias("methods"),
        _by_language(FIELDS, "body").alias("fields"),
        sum((count_matches("body", p) for p in COUPLING), F.lit(0)).alias("coupling"),
    )
    ratio = F.col("fields") / F.col("methods")
    cohesion = (
        F.when((F.col("methods") == 0) | (F.col("fields") == 0), 100)
        .when(ratio.between(0.5, 3), 80)
        .when(ratio.between(0.2, 5), 60)
        .otherwise(40)
    )
    return classes.select(
        *KEYS, "name", "line", "lines", "methods", "fields", "coupling", cohesion.alias("cohesion"),
        risk_band(F.col("methods") * 2 + F.floor(F.col("_size") / 100)).alias("risk_level"),
    )


def complexity_report(files: DataFrame, units: DataFrame | None = None) -> DataFrame:
    """One summary row per file; functions and classes are measured in one pass over the units."""
    units = code_units(files) if units is None else units
    function, cls = F.col("kind") == "function", F.col("kind") == "class"
    measured = computed_once(
        units,
        [*KEYS, "kind"],
        [
            F.when(function, cyclomatic_complexity("body", "language")).alias("_cyclomatic"),
            F.when(function, halstead("body")).alias("_h"),
            F.when(cls, _by_language(METHODS, "body")).alias("_methods"),
        ],
    )
    facts = measured.select("project", "path", "kind", "_cyclomatic", "_methods", halstead_numbers("_h")[-1].alias("_index"))
    parts = facts.groupBy("project", "path").agg(
        F.count_if(function).alias("total_functions"),
        F.avg(F.when(function, F.col("_index"))).alias("_mi"),
        F.count_if(function & (F.col("_cyclomatic") > 10)).alias("complex_functions"),
        F.count_if(function & (F.col("_index") < 50)).alias("low_index_functions"),
        F.count_if(cls).alias("total_classes"),
        F.count_if(cls & (F.col("_methods") > 10)).alias("large_classes"),
    )
    whole = files.select(
        *KEYS,
        line_count("text").cast("bigint").alias("total_lines"),
        cyclomatic_complexity("text", "language").alias("cyclomatic"),
        cognitive_complexity("text").cast("bigint").alias("cognitive"),
        nesting_depth("text").alias("max_nesting_depth"),
    )
    zero = F.lit(0)
    return whole.join(parts, ["project", "path"], "left").select(
        *KEYS,
        "total_lines",
        *[F.coalesce(c, zero).alias(c) for c in ("total_functions", "total_classes", "complex_functions", "low_index_functions", "large_classes")],
        "cyclomatic",
        "cognitive",
        F.floor(F.coalesce("_mi", F.lit(100.0)) + 0.5).cast("bigint").alias("average_maintainability_index"),
        "max_nesting_depth",
    )


def compare_complexity(report: DataFrame, paths: DataFrame) -> DataFrame:
    """Report rows of the asked paths; a missing file gives an error row."""
    return paths.select("path").join(report, "path", "left").withColumn(
        "error", F.when(F.col("language").isNull(), F.concat(F.lit("File not found: "), "path"))
    )


def complex_functions(functions: DataFrame, limit: int = 10) -> DataFrame:
    risky = functions.where(F.col("risk_level").isin("high", "critical"))
    return risky.orderBy(F.desc("cyclomatic"), "path", "line", "name").limit(limit)


def complexity_recommendations(report: DataFrame) -> DataFrame:
    def item(test, priority, category, *parts):
        text = F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
        return F.when(
            test, F.struct(F.lit(priority).alias("priority"), F.lit(category).alias("category"), text.alias("message"))
        )

    items = F.array_compact(
        F.array(
            item(F.col("cyclomatic") > 20, "high", "complexity",
                 "Overall code complexity is high. Consider refactoring complex functions."),
            item(F.col("complex_functions") > 0, "high", "refactoring", F.col("complex_functions"),
                 " function(s) have high cyclomatic complexity. Consider breaking them into smaller functions."),
            item(F.col("max_nesting_depth") > 5, "medium", "readability",
                 "Deep nesting detected. Consider using early returns or extracting methods."),
            item(F.col("large_classes") > 0, "medium", "design", F.col("large_classes"),
                 " class(es) have too many methods. Consider applying Single Responsibility Principle."),
            item(F.col("low_index_functions") > 0, "high", "maintainability", F.col("low_index_functions"),
                 " function(s) have low maintainability index. Refactoring recommended."),
        )
    )
    return report.select("project", "path", F.explode(items).alias("_i")).select(
        "project", "path", "_i.priority", "_i.category", "_i.message"
    )


# ---- long functions --------------------------------------------------------


def _long(batches):
    for batch in batches:
        out = {n: [] for n in ("project", "path", "language", "line", "number")}
        for project, path, language, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
            found = {}
            if language.startswith("python"):
                starts = [0] + [m.end() for m in re.finditer("\n", text)]
                for m in re.finditer(PY_FUNCTION_START, text, re.ASCII | re.MULTILINE):
                    found[m.start()] = _indent_end(text, m.start(), m.end(), starts)
            else:
                pairs = closing_braces(text)
                opens = sorted(pairs)
                for pattern in JS_FUNCTION_STARTS:
                    for m in re.finditer(pattern, text, re.ASCII):
                        i = bisect_right(opens, m.start() - 1)
                        if i < len(opens):
                            found[m.start()] = pairs[opens[i]]
            for start, end in found.items():
                count = text.count("\n", start, end) + 1
                if count > LONG_FUNCTION_LINES:
                    row = (project, path, language, text.count("\n", 0, start) + 1, count)
                    for key, value in zip(out, row):
                        out[key].append(value)
        yield pa.RecordBatch.from_pydict(
            out,
            schema=pa.schema([(n, pa.int32() if n in ("line", "number") else pa.string()) for n in out]),
        )


def long_functions(files: DataFrame) -> DataFrame:
    """Functions over 50 lines as findings; shorter files never leave the JVM."""
    wanted = files.where(
        F.col("language").isin("javascript", "typescript", "python") & (line_count("text") > LONG_FUNCTION_LINES)
    ).select(*KEYS, "text")
    found = wanted.mapInArrow(_long, "project string, path string, language string, line int, number int")
    nothing = F.lit(None).cast("string")
    engine = F.when(F.col("language") == "python", "quality-python").otherwise("quality-javascript")
    return found.select(
        *KEYS,
        engine.alias("engine"),
        F.lit("max-lines-per-function").alias("rule"),
        F.lit("complexity").alias("category"),
        nothing.alias("sub_category"),
        F.lit("warning").alias("severity"),
        F.replace(F.lit(LONG_FUNCTION_MESSAGE), F.lit("{count}"), F.col("number").cast("string")).alias("message"),
        nothing.alias("suggestion"),
        "line",
        F.lit(1).alias("column"),
        F.lit("").alias("match"),
        F.lit(False).alias("auto_fixable"),
        "number",
        F.lit(-1).alias("rule_order"),
    )


# ---- symbols and edges -----------------------------------------------------


def _words(pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all("text", F.lit(java_regex(pattern, "m")), F.lit(group))


_DEF = r"def (\w+)\([^)]*\):"


def call_edges(files: DataFrame) -> DataFrame:
    """Distinct (path, caller, callee): calls between a ``def`` and the next one.

    A caller meets only the calls of its own stretch of text, so the edges of a
    file grow with its length and not with functions times calls.
    """
    pattern = java_regex(_DEF)
    stretches = F.arrays_zip(
        F.regexp_extract_all("text", F.lit(pattern), F.lit(1)).alias("caller"),
        F.slice(F.split("text", pattern, -1), 2, 2147483647).alias("body"),
    )
    calls = F.array_distinct(F.regexp_extract_all(F.col("_s.body"), F.lit(java_regex(r"(\w+)\([^)]*\)")), F.lit(1)))
    return (
        files.where((F.col("language") == "python") & F.contains("text", F.lit("def ")))
        .select("project", "path", F.explode(stretches).alias("_s"))
        .select("project", "path", F.col("_s.caller").alias("caller"), F.explode(calls).alias("callee"))
        .where(F.col("caller") != F.col("callee"))
        .distinct()
    )


def inheritance_edges(files: DataFrame) -> DataFrame:
    """(path, child, parent); the last definition of a child in a file counts."""
    brace, indent = r"class\s+(\w+)(?:\s+extends\s+(\w+))?", r"class\s+(\w+)(?:\s*\(\s*(\w+)(?:\.[^(]*)?\s*\))?"
    python = F.col("language") == "python"

    def pick(group):
        return F.when(python, _words(indent, group)).otherwise(_words(brace, group))

    pairs = files.select(*KEYS, F.posexplode(F.arrays_zip(pick(1).alias("child"), pick(2).alias("parent"))).alias("_at", "_p"))
    last = pairs.groupBy(*KEYS, F.col("_p.child").alias("child")).agg(F.max(F.struct("_at", "_p.parent")).alias("_l"))
    return last.select(*KEYS, "child", F.nullif(F.col("_l.parent"), F.lit("")).alias("parent"))


IMPORT_PATTERNS = [
    r"^\s*from\s+([\w.]+)\s+import\b", r"^\s*import\s+([\w.]+)", r"\bfrom\s+['\"]([^'\"]+)['\"]",
    r"\brequire\s*\(\s*['\"]([^'\"]+)['\"]\s*\)",
]


def module_name(text) -> Column:
    """Last part of a module path, without folders and extension."""
    bare = F.regexp_replace(text, r"\.(?:js|ts|py)$", "")
    return F.element_at(F.split(bare, r"[/.]"), -1)


def import_edges(files: DataFrame) -> DataFrame:
    """Distinct (module, imported) within a project; a module is a file's base name."""
    found = F.array_distinct(F.concat(*[_words(p) for p in IMPORT_PATTERNS]))
    own = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    return (
        files.select("project", own.alias("module"), F.explode(found).alias("_raw"))
        .select("project", "module", module_name(F.col("_raw")).alias("imported"))
        .where((F.col("imported") != "") & (F.col("imported") != F.col("module")))
        .distinct()
    )


def _words_after(literal: str, pattern: str) -> Column:
    """Like :func:`_words`, for a pattern that needs the literal: texts without it meet no regex."""
    return F.when(F.contains("text", F.lit(literal)), _words(pattern)).otherwise(F.array().cast("array<string>"))


def _symbol_names() -> dict[str, Column]:
    """Per kind, the names a text declares or imports."""
    return {
        "function": F.concat(*[_words_after(word, rf"\b{word}\s+(\w+)") for word in ("def", "function", "func", "fn")]),
        "class": _words_after("class", r"\bclass\s+(\w+)"),
        "import": F.concat(*[_words_after(word, p) for word, p in zip(("import", "import", "from", "require"), IMPORT_PATTERNS)]),
    }


def symbols(files: DataFrame) -> DataFrame:
    """Functions, classes and imports per file as (path, kind, name), by patterns."""

    def named(kind):
        return lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("name"))

    entries = F.concat(*[F.transform(F.array_distinct(v), named(k)) for k, v in _symbol_names().items()])
    return files.select(*KEYS, F.explode(entries).alias("_s")).select(*KEYS, "_s.kind", "_s.name")


def holds_symbol(name: str) -> Column:
    """Whether a file's text declares or imports the name: a test of the row, no join."""
    return F.contains("text", F.lit(name)) & F.exists(F.concat(*_symbol_names().values()), lambda n: n == F.lit(name))


def _python_symbols(batches):
    fields = ("project", "path", "kind", "name", "line", "end_line", "container", "docstring")
    schema = pa.schema([(n, pa.int32() if n.endswith("line") else pa.string()) for n in fields])
    for batch in batches:
        rows = []
        for project, path, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            try:
                tree = ast.parse(text)
            except (SyntaxError, ValueError, RecursionError, MemoryError):
                continue
            stack = [(tree, None)]
            while stack:
                node, owner = stack.pop()
                for child in ast.iter_child_nodes(node):
                    inner = owner
                    if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                        kind = "class" if isinstance(child, ast.ClassDef) else "function"
                        rows.append((project, path, kind, child.name, child.lineno, child.end_lineno, owner, ast.get_docstring(child)))
                        inner = child.name
                    elif isinstance(child, ast.Import):
                        rows += [(project, path, "import", a.name, child.lineno, child.end_lineno, owner, None) for a in child.names]
                    elif isinstance(child, ast.ImportFrom) and child.module:
                        rows.append((project, path, "import", child.module, child.lineno, child.end_lineno, owner, None))
                    stack.append((child, inner))
        columns = list(zip(*rows)) if rows else [[]] * len(fields)
        yield pa.RecordBatch.from_pydict(dict(zip(fields, map(list, columns))), schema=schema)


def python_symbols(files: DataFrame) -> DataFrame:
    """Symbol table of Python files that parse, with lines and owners."""
    wanted = files.where((F.col("language") == "python") & F.col("text").rlike(r"\b(?:def|class|import)\b"))
    return wanted.select("project", "path", "text").mapInArrow(
        _python_symbols,
        "project string, path string, kind string, name string, line int, end_line int, container string, docstring string",
    )


#: Paths in several rows, up to which they are sent to the texts.
SHARED_PATHS = 100_000


def word_uses(files: DataFrame) -> DataFrame:
    """(project, path, name, uses) of every word."""
    words = files.select("project", "path", F.explode(F.regexp_extract_all("text", F.lit(r"\w+"), F.lit(0))).alias("name"))
    return words.groupBy("project", "path", "name").agg(F.count("*").alias("uses"))


def _row_words(files: DataFrame) -> DataFrame:
    """(name, uses): each word of each row's text, counted inside the row."""
    # Sorted, the uses of a word are neighbours; the arrays are bound to variables, so each is made once.
    firsts = "filter(transform(s, (x, i) -> if(i = 0 OR x <> get(s, i - 1), i, null)), i -> i IS NOT NULL)"
    counted = f"transform(array({firsts}), f -> transform(f, (b, j) -> named_struct('name', get(s, b), 'uses', coalesce(get(f, j + 1), size(s)) - b)))[0]"
    words = "sort_array(regexp_extract_all(text, '\\\\w+', 0))"
    return files.select(F.inline(F.expr(f"transform(array({words}), s -> {counted})[0]")))


def word_totals(files: DataFrame) -> DataFrame:
    """(name, used_in, uses) of every word: files that use it, and its uses.

    Words are counted inside the row of their file, so a word travels without
    its path. Only files whose path stands in several rows, looked for first by
    paths alone, are counted by (project, path, name).
    """
    again = files.groupBy("project", "path").agg(F.count("*").alias("_rows")).where("_rows > 1").select(F.col("project").alias("_project"), F.col("path").alias("_path"))
    shared = again.limit(SHARED_PATHS + 1).count()
    rows = _row_words(files)
    if shared:
        sent = F.broadcast(again) if shared <= SHARED_PATHS else again
        same = files["project"].eqNullSafe(sent["_project"]) & files["path"].eqNullSafe(sent["_path"])
        rows = _row_words(files.join(sent, same, "left_anti")).unionByName(word_uses(files.join(sent, same, "left_semi")).select("name", "uses"))
    return rows.groupBy("name").agg(F.count("*").alias("used_in"), F.sum("uses").alias("uses"))


def references(files: DataFrame, names: DataFrame) -> DataFrame:
    """Uses of the given names, one equi join on the word."""
    return word_uses(files).join(names.select("name").distinct(), "name").select("project", "path", "name", "uses")
