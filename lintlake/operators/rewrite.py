"""Ordered regex rewrites over a corpus, with counts and diffs.

Rewritten text is a new column or table version; nothing is changed in place.
"""

from __future__ import annotations

import difflib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.functions.text import computed_once, java_regex, lines_of
from lintlake.operators.structure import holds_symbol

# Name, pattern, replacement (with $1 groups), severity.
PYTHON_REWRITES = [
    ("Add Type Hints", r"def (\w+)\(([^)]*)\):", r"def $1($2) -> None:", "INFO"),
    ("Fix Bare Except", r"except:", r"except Exception as e:", "ERROR"),
    ("Fix Print Statement", r"print\((.*?)\)", r"logging.info($1)", "WARNING"),
    ("Fix String Format", r"\"%s\" % (.*?)", r'f"{$1}"', "INFO"),
    ("Fix Old Style Class", r"class (\w+):", r"class $1(object):", "INFO"),
    ("Fix Hardcoded Password", r"password\s*=\s*\"[^\"]+\"", r'password = os.environ.get("PASSWORD")', "ERROR"),
    ("Fix Hardcoded API Key", r"api_key\s*=\s*\"[^\"]+\"", r'api_key = os.environ.get("API_KEY")', "ERROR"),
    ("Add Import OS", r"(import logging)", "$1\nimport os", "INFO"),
    ("Fix List Comprehension", r"for (\w+) in (.*):\n\s+(\[\w+\])\.append\(\1\)", r"[$1 for $1 in $2]", "INFO"),
    ("Fix String Concatenation", r"(\w+) \+= (\w+) \+ (\w+)", r'$1 = "".join([$1, $2, $3])', "WARNING"),
    ("Add Docstring Template", r"(def \w+\([^)]*\):)\n(\s+)", "$1\n$2\"\"\"TODO: Add docstring.\"\"\"\n$2", "INFO"),
]
MINUTES_PER_FIX = 2


def apply_rewrites(files: DataFrame, rules) -> DataFrame:
    """``files`` plus ``fixed`` and ``fixes``, the hits of each rule before its own step."""
    rules = list(rules)
    df = files.withColumn("_t0", F.col("text"))
    for i, (_, pattern, replacement, _) in enumerate(rules):
        df = df.withColumn(f"_t{i + 1}", F.regexp_replace(f"_t{i}", java_regex(pattern), replacement))
    counts = F.array(
        *[
            F.struct(
                F.lit(name).alias("rule"), F.regexp_count(f"_t{i}", F.lit(java_regex(pattern))).alias("count")
            )
            for i, (name, pattern, _, _) in enumerate(rules)
        ]
    )
    return df.select(
        *files.columns,
        F.col(f"_t{len(rules)}").alias("fixed"),
        F.filter(counts, lambda c: c["count"] > 0).alias("fixes"),
    )


def _quoted_value(line, key: str, when):
    """``key: value`` with its value in double quotes, on lines without quotes that pass ``when``."""
    value = F.trim(F.regexp_extract(line, java_regex(key + r":\s*(.+)"), 1))
    plain = F.contains(line, F.lit(key + ":")) & ~F.contains(line, F.lit('"')) & ~F.contains(line, F.lit("'"))
    found = F.concat(F.lit(key + ": "), value)
    return F.when(plain & when & (value != ""), F.replace(line, found, F.concat(F.lit(key + ': "'), value, F.lit('"')))).otherwise(line)


def _open_quote(line):
    odd = (F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))) % 2 == 1
    return F.when(odd, F.concat(F.regexp_replace(line, r"\s+\z", ""), F.lit('"'))).otherwise(line)


# Name and repair of one line, in order.
YAML_REPAIRS = [
    ("Space After Colon", lambda line: F.regexp_replace(line, java_regex(r':([^:\s\n"/])'), ": $1")),
    ("Quote Metavariable", lambda line: F.when(
        F.contains(line, F.lit("metavariable:")), F.regexp_replace(line, java_regex(r"metavariable:\s*(\$?\w+)"), 'metavariable: "$1"')
    ).otherwise(line)),
    ("Quote Pattern", lambda line: _quoted_value(line, "pattern", F.contains(line, F.lit("$")))),
    ("Quote Regex", lambda line: _quoted_value(line, "regex", F.lit(True))),
    ("Close Quote", _open_quote),
]


def repair_yaml(files: DataFrame) -> DataFrame:
    """``files`` plus ``fixed`` and ``fixes``, the lines that each repair changed.

    Repairs work line by line. Comments, blank lines and lines that open a
    block (they end in ``|`` or ``>``) stay as they are. Every repair needs a
    colon or a double quote, so lines without them meet no regex.
    """
    plain = lambda line: ~F.contains(line, F.lit(":")) & ~F.contains(line, F.lit('"'))
    kept = lambda line: plain(line) | line.rlike(r"\A\s*(?:#|\z)") | line.rlike(r"[|>]\s*\z")
    steps = files.withColumn("_l0", F.split("text", "\n", -1))
    for i, (_, repair) in enumerate(YAML_REPAIRS):
        step = F.transform(f"_l{i}", lambda line: F.when(kept(line), line).otherwise(repair(line)))
        # A generator per step: else a step is worked out again for every use of its lines.
        steps = steps.withColumn(f"_l{i + 1}", F.explode(F.array(step)))
    changed = lambda i: F.size(F.filter(F.arrays_zip(F.col(f"_l{i}").alias("a"), F.col(f"_l{i + 1}").alias("b")), lambda x: x["a"] != x["b"]))
    counts = F.array(*[F.struct(F.lit(name).alias("rule"), changed(i).alias("count")) for i, (name, _) in enumerate(YAML_REPAIRS)])
    return steps.select(*files.columns, F.array_join(f"_l{len(YAML_REPAIRS)}", "\n").alias("fixed"), F.filter(counts, lambda c: c["count"] > 0).alias("fixes"))


def rewrite_counts(rewritten: DataFrame) -> DataFrame:
    """One row per (file, rule) with hits."""
    return rewritten.select("project", "path", F.explode("fixes").alias("_f")).select(
        "project", "path", "_f.rule", "_f.count"
    )


def rewrite_report(rewritten: DataFrame) -> DataFrame:
    """Files scanned and changed, fixes and minutes saved, per project."""
    total = F.aggregate("fixes", F.lit(0), lambda a, x: a + x["count"])
    changed = F.col("fixed") != F.col("text")
    return (
        rewritten.select("project", changed.alias("changed"), F.when(changed, total).otherwise(0).alias("n"))
        .groupBy("project")
        .agg(
            F.count("*").alias("files_scanned"),
            F.count_if("changed").alias("files_modified"),
            F.sum("n").cast("bigint").alias("issues_fixed"),
        )
        .withColumn("time_saved_minutes", F.col("issues_fixed") * MINUTES_PER_FIX)
    )


# ---- targeted fixers -------------------------------------------------------

# Fixed values: (pattern, replacement) by fixer.
PRINT_FIXES = [
    (r"^(\s*)print\(([\"'].*?[\"'])\)\s*$", "$1logging.info($2)"),
    (r"^(\s*)print\(f([\"'].*?[\"'])\)\s*$", "$1logging.info(f$2)"),
    (r"^(\s*)print\(([^\"'][^)]*[^\"'])\)\s*$", "$1logging.info($2)"),
]
SECRET_FIXES = [
    (r"(\bpassword\b\s*=\s*)([\"'])([^\"']{4,})\2", '$1os.environ.get("PASSWORD")'),
    (r"(\b(api_key|apikey|api_secret)\b\s*=\s*)([\"'])([^\"']{8,})\3", '$1os.environ.get("API_KEY")'),
    (r"(\b(secret|token)\b\s*=\s*)([\"'])([^\"']{8,})\3", '$1os.environ.get("SECRET")'),
    (r"(\b[A-Z_]*(SECRET|KEY|PASSWORD)[A-Z_]*\s*=\s*)([\"'])([^\"']{4,})\3", '$1os.environ.get("$2")'),
]
BARE_EXCEPT = (
    r"(\s+)except\s*:\s*\n(\s+)(pass|continue|break)",
    "$1except Exception as e:\n$2import logging\n$2logging.error(f\"Exception: {e}\")\n$2$3",
)
RESOURCE_LEAK = (r"(\w+)\s*=\s*open\(([^)]+)\)\s*\n(.*?)(?=\1\.close\(\))", "with open($2) as $1:\n$3")


def _with_import(text, module: str, wanted):
    missing = ~F.contains(text, F.lit(f"import {module}"))
    return F.when(wanted & missing, F.concat(F.lit(f"import {module}\n"), text)).otherwise(text)


def fix_prints(files: DataFrame) -> DataFrame:
    """Print statements to logging calls, with the import where it is missing."""
    text = F.col("text")
    for pattern, replacement in PRINT_FIXES:
        text = F.regexp_replace(text, java_regex(pattern, "m"), replacement)
    return files.withColumn("_t", text).withColumn(
        "text", _with_import(F.col("_t"), "logging", F.contains("_t", F.lit("logging")))
    ).drop("_t")


def fix_secrets(files: DataFrame) -> DataFrame:
    """Quoted secrets to environment lookups."""
    df = files.withColumn("_s0", F.col("text"))
    hit = F.lit(False)
    for i, (pattern, replacement) in enumerate(SECRET_FIXES):
        hit = hit | F.col(f"_s{i}").rlike(java_regex(pattern, "i"))
        df = df.withColumn(f"_s{i + 1}", F.regexp_replace(f"_s{i}", java_regex(pattern, "i"), replacement))
    last = F.col(f"_s{len(SECRET_FIXES)}")
    return df.withColumn("text", _with_import(last, "os", hit)).drop(*[f"_s{i}" for i in range(len(SECRET_FIXES) + 1)])


def fix_bare_excepts(files: DataFrame) -> DataFrame:
    return files.withColumn("text", F.regexp_replace("text", java_regex(BARE_EXCEPT[0]), BARE_EXCEPT[1]))


def fix_weak_crypto(files: DataFrame) -> DataFrame:
    text = F.replace(F.col("text"), F.lit("hashlib.md5("), F.lit("hashlib.sha256("))
    return files.withColumn("text", F.replace(text, F.lit("hashlib.sha1("), F.lit("hashlib.sha256(")))


def fix_resource_leaks(files: DataFrame) -> DataFrame:
    return files.withColumn("text", F.regexp_replace("text", java_regex(RESOURCE_LEAK[0], "s"), RESOURCE_LEAK[1]))


FIXERS = {
    "print_to_logging": fix_prints, "hardcoded_secrets": fix_secrets, "bare_except": fix_bare_excepts,
    "weak_crypto": fix_weak_crypto, "resource_leak": fix_resource_leaks,
}


def fix_all(files: DataFrame) -> DataFrame:
    """All fixers in order: ``text`` is the new text, ``applied`` names what changed it."""
    df = files.withColumn("original", F.col("text"))
    names = []
    for name, fixer in FIXERS.items():
        df = fixer(df.withColumn("_before", F.col("text")))
        # Each step's text is made once, or a filter on what was applied would repeat all steps before it.
        df = computed_once(df, [c for c in df.columns if c != "text"], [F.col("text").alias("text")])
        df = df.withColumn(f"_c_{name}", F.when(F.col("text") != F.col("_before"), F.lit(name))).drop("_before")
        names.append(f"_c_{name}")
    return df.withColumn("applied", F.array_compact(F.array(*names))).drop(*names)


def rename_symbol(files: DataFrame, old: str, new: str) -> DataFrame:
    """Whole-word rename in the files whose symbols include the name; a narrow pass over the texts."""
    pattern = java_regex(r"\b" + old + r"\b")
    return files.where(holds_symbol(old)).withColumn("fixed", F.regexp_replace("text", pattern, new.replace("$", r"\$")))


def line_changes(rewritten: DataFrame) -> DataFrame:
    """Lines that differ at the same place, compared inside the row."""
    pairs = F.arrays_zip(lines_of("text").alias("before"), lines_of("fixed").alias("after"))
    return (
        rewritten.where(F.col("text") != F.col("fixed"))
        .select("project", "path", F.posexplode(pairs).alias("_at", "_p"))
        .where(~F.equal_null(F.col("_p.before"), F.col("_p.after")))
        .select("project", "path", (F.col("_at") + 1).alias("line"), "_p.before", "_p.after")
    )


def _diff(batches):
    schema = pa.schema([("project", pa.string()), ("path", pa.string()), ("diff", pa.string())])
    for batch in batches:
        rows = {"project": [], "path": [], "diff": []}
        for project, path, before, after in zip(*(batch.column(i).to_pylist() for i in range(4))):
            lines = difflib.unified_diff(
                before.splitlines(keepends=True), after.splitlines(keepends=True), f"a/{path}", f"b/{path}", n=3
            )
            for key, value in zip(rows, (project, path, "".join(lines))):
                rows[key].append(value)
        yield pa.RecordBatch.from_pydict(rows, schema=schema)


def unified_diffs(rewritten: DataFrame) -> DataFrame:
    """Unified diff text of each changed file."""
    changed = rewritten.where(F.col("text") != F.col("fixed")).select("project", "path", "text", "fixed")
    return changed.mapInArrow(_diff, "project string, path string, diff string")
