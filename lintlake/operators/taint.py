"""Taint sources and sinks, endpoints, sensitive terms and line checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lintlake.functions.text import col_of, java_regex, lines_of, sql_string
from lintlake.operators.scan import file_lines, scan_lines
from lintlake.rules.extra import (
    DEEP_CHECK,
    DEEP_SECRET_NAMES,
    LINE_SECURITY,
    SENSITIVE_TERMS,
    SINK_ADVICE,
    TAINT_SINKS,
    TAINT_SOURCES,
)

KEYS = ["project", "path", "language"]


def _hits(patterns) -> str:
    """SQL text: (line, pattern_no, content) of every line a pattern finds."""
    flags = ", ".join(f"if(rlike(l, {sql_string(java_regex(p))}), {i}, null)" for i, p in enumerate(patterns))
    return (
        "flatten(transform(split(text, '\\n', -1), (l, i) -> transform(array_compact(array(" + flags + ")), "
        "p -> named_struct('line', i + 1, 'pattern_no', p, 'content', l))))"
    )


def taint_findings(files: DataFrame) -> DataFrame:
    """Sinks in files that also hold a source, with the first three sources as trace.

    Sources and sinks of a file lie in one row, so the "same file" join is a
    test inside the row and nothing is shuffled.
    """
    sources = F.expr(_hits(TAINT_SOURCES))
    trace = F.transform(
        F.slice(F.col("_sources"), 1, 3),
        lambda s: F.concat(F.lit("Line "), s["line"].cast("string"), F.lit(": "), F.regexp_replace(s["content"], r"^\s+|\s+$", "")),
    )
    sinks = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(c).alias("cwe"), F.lit(SINK_ADVICE[n]).alias("advice")) for _, n, c in TAINT_SINKS])
    marked = files.where(F.col("language") == "python").select(*KEYS, "text", sources.alias("_sources")).where(F.size("_sources") > 0)
    return (
        marked.select(*KEYS, F.array_join(trace, "\n").alias("trace"), F.explode(F.expr(_hits([p for p, *_ in TAINT_SINKS]))).alias("_h"))
        .withColumn("_sink", F.element_at(sinks, F.col("_h.pattern_no") + 1))
        .select(
            "project",
            "path",
            F.col("_h.line").alias("line"),
            F.concat(F.lit("🔴 "), "_sink.name", F.lit("风险 - 可能使用用户输入")).alias("message"),
            F.lit("HIGH").alias("risk_level"),
            "_sink.cwe",
            "trace",
            F.col("_sink.advice").alias("recommendation"),
        )
    )


def api_endpoints(files: DataFrame) -> DataFrame:
    """Routes with method and risk by path parameters."""
    grab = lambda p, k: F.regexp_extract_all("text", F.lit(java_regex(p)), F.lit(k))
    flask, fast = r"@app\.route\(['\"]([^'\"]+)['\"]", r"@router\.(get|post|put|delete)\(['\"]([^'\"]+)['\"]"
    risky = lambda r, *marks: F.when(sum((F.contains(r, F.lit(m)).cast("int") for m in marks), F.lit(0)) > 0, "MEDIUM").otherwise("LOW")
    first = F.transform(
        grab(flask, 1),
        lambda r: F.struct(r.alias("route"), F.lit("GET/POST").alias("method"), risky(r, "<id>", "<path:").alias("risk_level")),
    )
    second = F.transform(
        F.arrays_zip(grab(fast, 1).alias("m"), grab(fast, 2).alias("r")),
        lambda x: F.struct(x["r"].alias("route"), F.upper(x["m"]).alias("method"), risky(x["r"], "{").alias("risk_level")),
    )
    found = files.where(F.col("language") == "python").select("project", "path", F.explode(F.concat(first, second)).alias("_e"))
    return found.select("project", "path", "_e.route", "_e.method", "_e.risk_level")


def deep_scan_report(findings: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Findings and endpoints per risk level."""
    a = findings.groupBy("risk_level").agg(F.count("*").alias("count")).select(F.lit("finding").alias("kind"), "risk_level", "count")
    b = endpoints.groupBy("risk_level").agg(F.count("*").alias("count")).select(F.lit("endpoint").alias("kind"), "risk_level", "count")
    return a.unionByName(b)


def sensitive_terms(files: DataFrame) -> DataFrame:
    """Lines that hold a sensitive term, one row per term."""
    terms = [(t, s) for s, names in SENSITIVE_TERMS.items() for t in names]
    hits = F.array_compact(
        F.array(
            *[
                F.when(F.contains("content", F.lit(t)), F.struct(F.lit(t).alias("term"), F.lit(s).alias("severity")))
                for t, s in terms
            ]
        )
    )
    return file_lines(files).select(
        "project", "path", "line", F.regexp_replace("content", r"^\s+|\s+$", "").alias("context"), F.explode(hits).alias("_t")
    ).select("project", "path", "line", "_t.term", "_t.severity", "context")


def line_security(files: DataFrame) -> DataFrame:
    """Four line patterns of a review, with suggestion and end column."""
    messages = F.array(*[F.lit(m) for _, m, _ in LINE_SECURITY])
    advice = F.array(*[F.lit(s) for *_, s in LINE_SECURITY])
    return scan_lines(files, [p for p, *_ in LINE_SECURITY]).select(
        "project",
        "path",
        "line",
        F.element_at(messages, F.col("pattern_no") + 1).alias("message"),
        F.lit("ERROR").alias("severity"),
        F.element_at(advice, F.col("pattern_no") + 1).alias("suggestion"),
        F.length("content").alias("end_column"),
    )


def _def_lines(files: DataFrame) -> DataFrame:
    """Lines that start a ``def``, with the number of the next one and the next line."""
    wanted = files.where(F.contains("text", F.lit("def "))).select("project", "path", F.explode(F.array(lines_of("text"))).alias("_lines"))
    # The lines are a column here, so they are cut once; neighbours come from the list moved by one.
    after = F.concat(F.slice("_lines", 2, F.greatest(F.size("_lines") - 1, F.lit(0))), F.array(F.lit("")))
    numbered = F.arrays_zip(F.sequence(F.lit(1), F.size("_lines")).alias("line"), F.col("_lines").alias("content"), after.alias("after"))
    defs = wanted.select("project", "path", F.size("_lines").alias("lines"), numbered.alias("_n")).select(
        "project", "path", "lines", F.filter("_n", lambda x: x["content"].rlike(r"^\s*def ")).alias("_defs"))
    following = F.concat(F.transform(F.slice("_defs", 2, F.greatest(F.size("_defs") - 1, F.lit(0))), lambda x: x["line"]), F.array(F.lit(None).cast("int")))
    paired = F.arrays_zip(F.col("_defs").alias("d"), following.alias("next_def"))
    return defs.where(F.size("_defs") > 0).select("project", "path", "lines", F.explode(paired).alias("_p")).select(
        "project",
        "path",
        "lines",
        "_p.d.line",
        F.split_part(F.split_part(F.col("_p.d.content"), F.lit("def "), F.lit(2)), F.lit("("), F.lit(1)).alias("name"),
        F.regexp_replace(F.col("_p.d.after"), r"^\s+", "").alias("next_line"),
        "_p.next_def",
    )


def long_definitions(files: DataFrame, limit: int = 50) -> DataFrame:
    """Functions whose next ``def`` is more than ``limit`` lines away."""
    n = (F.col("next_def") - F.col("line")).cast("string")
    return _def_lines(files).where(F.col("next_def") - F.col("line") > limit).select(
        "project",
        "path",
        "line",
        F.concat(F.lit("⚠️ 函数 `"), "name", F.lit("` 过长 ("), n, F.lit(" 行)，建议拆分")).alias("message"),
        F.lit("WARNING").alias("severity"),
        F.lit("将函数拆分为多个小函数，每个函数不超过 20 行").alias("suggestion"),
    )


def missing_docstrings(files: DataFrame) -> DataFrame:
    """``def`` lines (other than the last line) not followed by a docstring."""
    bare = ~(F.col("next_line").startswith('"""') | F.col("next_line").startswith("'''"))
    return _def_lines(files).where((F.col("line") < F.col("lines")) & bare).select(
        "project",
        "path",
        "line",
        F.lit("📝 函数缺少文档字符串").alias("message"),
        F.lit("INFO").alias("severity"),
        F.lit("添加文档字符串说明函数功能、参数和返回值").alias("suggestion"),
    )


def review_diagnostics(files: DataFrame) -> DataFrame:
    """All checks of a change review."""
    return (
        line_security(files).drop("end_column")
        .unionByName(long_definitions(files))
        .unionByName(missing_docstrings(files))
    )


REVIEW_ADVICE = [
    ("critical", 0, "- ⚠️ **立即修复**所有严重安全问题"),
    ("warning", 5, "- 📝 建议重构长函数和复杂代码"),
    ("info", 10, "- 📚 添加更多文档字符串和类型提示"),
]
REVIEW_FINE = "- ✅ 代码质量良好，继续保持！"


def review_summary(files: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """Per project: files, lines, issues by severity and the advice they call for."""
    sized = files.groupBy("project").agg(
        F.count("*").alias("total_files"), F.sum(F.size(lines_of("text"))).cast("bigint").alias("total_changes")
    )
    counted = diagnostics.groupBy("project").agg(
        F.count("*").alias("issues_found"),
        F.count_if(F.col("severity") == "ERROR").alias("critical"),
        F.count_if(F.col("severity") == "WARNING").alias("warning"),
        F.count_if(~F.col("severity").isin("ERROR", "WARNING")).alias("info"),
    )
    names = ["issues_found", "critical", "warning", "info"]
    joined = sized.join(counted, "project", "left").select(
        "project", "total_files", "total_changes", *[F.coalesce(c, F.lit(0)).alias(c) for c in names]
    )
    lines = F.array_compact(F.array(*[F.when(F.col(c) > n, t) for c, n, t in REVIEW_ADVICE]))
    return joined.withColumn("recommendation", F.when(F.size(lines) == 0, REVIEW_FINE).otherwise(F.array_join(lines, "\n")))


def deep_check_lines(files: DataFrame) -> DataFrame:
    """Bare excepts and prints of the deep check (minor), by line."""
    lines = file_lines(files)
    name = F.lower("path")
    quiet = F.contains(name, F.lit("debug")) | F.contains(name, F.lit("test"))
    bare = F.col("content").rlike(java_regex(r"\bexcept\s*:")) & ~F.col("content").rlike(r"except\s+Exception")
    prints = F.col("content").rlike(java_regex(r"\bprint\s*\(")) & ~F.col("content").rlike(r"^\s*#") & ~quiet
    found = F.array_compact(
        F.array(
            F.when(bare, F.lit("使用裸 except，建议指定具体异常类型")),
            F.when(prints, F.lit("使用 print 语句，生产环境建议使用 logging")),
        )
    )
    return lines.select("project", "path", "line", F.explode(found).alias("issue")).withColumn("level", F.lit("minor"))


def hardcoded_secrets(files: DataFrame, around: int = 50) -> DataFrame:
    """Quoted values of secret names, unless ``os.environ`` is within 50 characters."""
    # All names are looked for in one pass; a fold finds the place of each hit in order.
    patterns = [sql_string(java_regex(name + r"\s*=\s*[\"'][^\"']+[\"']")) for name in DEEP_SECRET_NAMES]
    spots = ", ".join(
        f"aggregate(regexp_extract_all(text, {p}, 0), named_struct('at', 1, 'out', "
        "cast(array() as array<struct<h:string,at:int>>)), (a, h) -> named_struct("
        "'at', locate(h, text, a.at) + length(h), "
        "'out', concat(a.out, array(named_struct('h', h, 'at', locate(h, text, a.at)))))).out"
        for p in patterns
    )
    near = " OR ".join(f"contains(text, '{name}')" for name in DEEP_SECRET_NAMES)
    found = files.where(near).select("project", "path", "text", F.explode(F.expr(f"concat({spots})")).alias("_s"))
    begin = F.greatest(F.col("_s.at") - around, F.lit(1))
    window = F.substring("text", begin, F.col("_s.at") + F.length("_s.h") + around - begin)
    before = F.substring("text", F.lit(1), F.col("_s.at") - 1)
    return found.where(~F.contains(window, F.lit("os.environ"))).select(
        "project",
        "path",
        (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).alias("line"),
        F.lit("发现硬编码的敏感信息").alias("issue"),
        F.lit("major").alias("level"),
    )


def deep_check(files: DataFrame) -> DataFrame:
    """Issues of the deep check by patterns: security, secrets, excepts, prints."""
    from lintlake.operators.scan import scan_rules

    python = files.where(F.col("language") == "python")
    security = scan_rules(python, DEEP_CHECK).select(
        "project", "path", "line", F.col("message").alias("issue"), F.lit("major").alias("level")
    )
    return security.unionByName(hardcoded_secrets(python)).unionByName(deep_check_lines(python))
