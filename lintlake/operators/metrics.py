"""Per-file size, complexity and risk metrics. All narrow: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.functions.brackets import cognitive_complexity, nesting_profile
from lintlake.functions.text import (
    col_of,
    computed_once,
    count_all,
    count_matches,
    count_substring,
    line_count,
    lines_of,
)

# What counts as a function, a class and a branch in a whole file.
FUNCTION_PATTERNS = [
    r"function\s+\w+", r"const\s+\w+\s*=\s*(async\s+)?\(", r"def\s+\w+",
    r"public|private|protected\s+\w+\s*\(", r"func\s+\w+", r"fn\s+\w+",
]
CLASS_PATTERNS = [r"class\s+\w+", r"interface\s+\w+", r"struct\s+\w+", r"enum\s+\w+"]
BRANCH_PATTERNS = [
    r"\bif\b", r"\belse\b", r"\bfor\b", r"\bwhile\b", r"\bcase\b", r"\bcatch\b", r"\?\s*[^:]",
    r"\band\b", r"\bor\b", r"&&", r"\|\|",
]
COMMENT_START = r"\A\s*(?://|#|/\*|\*|--)"
# Decision points of cyclomatic complexity, common and per language.
DECISIONS = [
    r"\bif\b", r"\belse\s+if\b", r"\bfor\b", r"\bwhile\b", r"\bcase\b", r"\bcatch\b", r"\bexcept\b",
    r"\?\s*[^:]", r"&&", r"\|\|", r"\band\b", r"\bor\b",
]
LANGUAGE_DECISIONS = {
    "javascript": [r"\bswitch\b", r"\?\."], "typescript": [r"\bswitch\b", r"\?\."],
    "python": [r"\belif\b", r"\bwith\b"], "java": [r"\bswitch\b", r"\b\?\s*:"],
    "go": [r"\bselect\b", r"\bdefer\b"], "rust": [r"\bmatch\b", r"\bif\s+let\b"],
    "ruby": [r"\bunless\b", r"\brescue\b"], "php": [r"\bmatch\b", r"\bforeach\b"],
    "swift": [r"\bguard\b", r"\bif\s+let\b"], "kotlin": [r"\bwhen\b", r"\?.\b"],
}
OPERATORS = "+-*/%=<>!&|^~?:;,.()[]{}"
OPERATOR_CLASS = r"[+\-*/%=<>!&|^~?:;,.()\[\]{}]"

KEYS = ["project", "path", "language"]


def line_metrics(files: DataFrame) -> DataFrame:
    """Total, comment, blank and code lines of each file."""
    lines = lines_of("text")
    blank = F.size(F.filter(lines, lambda x: x.rlike(r"\A\s*\z")))
    comment = F.size(F.filter(lines, lambda x: x.rlike(COMMENT_START)))
    return files.select(
        *KEYS,
        line_count("text").cast("bigint").alias("lines_of_code"),
        comment.cast("bigint").alias("comment_lines"),
        blank.cast("bigint").alias("blank_lines"),
    ).withColumn("code_lines", F.col("lines_of_code") - F.col("comment_lines") - F.col("blank_lines"))


def file_complexity(text) -> Column:
    """Estimated cyclomatic complexity of a whole file."""
    return (1 + count_all(text, BRANCH_PATTERNS)).cast("bigint")


def element_counts(files: DataFrame) -> DataFrame:
    """Functions, classes and estimated complexity by pattern counts."""
    return files.select(
        *KEYS,
        count_all("text", FUNCTION_PATTERNS).cast("bigint").alias("functions"),
        count_all("text", CLASS_PATTERNS).cast("bigint").alias("classes"),
        file_complexity("text").alias("estimated_cyclomatic"),
    )


def cyclomatic_complexity(text, language) -> Column:
    """One plus the decision points, with those of the file's language."""
    special = None
    for name, patterns in LANGUAGE_DECISIONS.items():
        test = col_of(language) == name
        value = count_all(text, patterns)
        special = F.when(test, value) if special is None else special.when(test, value)
    return (1 + count_all(text, DECISIONS) + special.otherwise(F.lit(0))).cast("bigint")


def halstead(text) -> Column:
    """Struct of counts and derived Halstead numbers; the index is held to 0..100."""
    t = col_of(text)
    n1 = F.lit(0)
    for symbol in OPERATORS:
        n1 = n1 + F.contains(t, F.lit(symbol)).cast("int")
    distinct_words = F.size(F.array_distinct(F.regexp_extract_all(t, F.lit(r"\w+"), F.lit(0))))
    counts = F.struct(
        n1.cast("bigint").alias("n1"),
        distinct_words.cast("bigint").alias("n2"),
        F.regexp_count(t, F.lit(OPERATOR_CLASS)).cast("bigint").alias("total_operators"),
        F.regexp_count(t, F.lit(r"\w+")).cast("bigint").alias("total_operands"),
    )
    return counts


def halstead_numbers(c) -> list[Column]:
    """Named columns derived from a :func:`halstead` struct column."""
    c = col_of(c)
    vocabulary = c["n1"] + c["n2"]
    length = c["total_operators"] + c["total_operands"]
    volume = length * F.log2(F.greatest(vocabulary, F.lit(1)).cast("double"))
    difficulty = (c["n1"] / 2.0) * (c["total_operands"] / F.greatest(c["n2"], F.lit(1)))
    index = 171 - 5.2 * F.log(volume) - 0.23 * difficulty - 16.2 * F.log(F.greatest(length, F.lit(1)).cast("double"))
    clamped = F.when(volume <= 0, F.lit(100.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), index)))
    return [
        c["n1"].alias("n1"),
        c["n2"].alias("n2"),
        c["total_operators"].alias("total_operators"),
        c["total_operands"].alias("total_operands"),
        vocabulary.alias("vocabulary"),
        length.alias("length"),
        volume.alias("volume"),
        difficulty.alias("difficulty"),
        (volume * difficulty).alias("effort"),
        (volume * difficulty / 18).alias("time_seconds"),
        (volume / 3000).alias("estimated_bugs"),
        clamped.alias("maintainability_index"),
    ]


def halstead_metrics(files: DataFrame) -> DataFrame:
    counted = files.select(*KEYS, halstead("text").alias("_h"))
    return counted.select(*KEYS, *halstead_numbers("_h"))


def nesting_depth(files: DataFrame) -> DataFrame:
    """Deepest bracket level, its line, and half of it rounded up."""
    at = files.select(*KEYS, nesting_profile("text", skip_literals=False).alias("_n"))
    return at.select(
        *KEYS,
        F.col("_n.depth").alias("max_depth"),
        F.col("_n.line").alias("max_depth_line"),
        F.floor((F.col("_n.depth") + 1) / 2).cast("int").alias("average_depth"),
    )


def literal_aware_nesting(files: DataFrame, limit: int = 4) -> DataFrame:
    """Deepest level outside strings and comments, flagged above the limit."""
    at = files.select(*KEYS, nesting_profile("text", skip_literals=True).alias("_n"))
    return at.select(
        *KEYS,
        F.col("_n.depth").alias("depth"),
        F.col("_n.line").alias("line"),
        (F.col("_n.depth") > limit).alias("too_deep"),
    )


def complexity_scores(files: DataFrame) -> DataFrame:
    return files.select(
        *KEYS,
        cyclomatic_complexity("text", "language").alias("cyclomatic"),
        cognitive_complexity("text").cast("bigint").alias("cognitive"),
    )


def function_risk(cyclomatic, cognitive, lines) -> Column:
    """low / medium / high / critical at 10, 20 and 30 points."""
    points = col_of(cyclomatic) * 2 + col_of(cognitive) + F.floor(col_of(lines) / 20)
    return risk_band(points)


def risk_band(points: Column) -> Column:
    return (
        F.when(points >= 30, "critical").when(points >= 20, "high").when(points >= 10, "medium").otherwise("low")
    )


# ---- file risk -------------------------------------------------------------

RISK_WORDS = ["if", "elif", "else", "for", "while", "try", "except", "with"]
# Predicted issues and advice, in order of the tests below.
RISK_TEXT = [
    ("高复杂度可能导致难以维护", "• 将大函数拆分为小函数"),
    ("注释不足可能导致理解困难", "• 添加文档字符串和注释"),
    ("文件过长建议拆分", "• 拆分为多个模块"),
    ("代码重复率高建议重构", "• 提取公共逻辑"),
    ("依赖过多可能增加耦合", "• 减少不必要的导入"),
]
RISK_FINE = "代码质量良好，继续保持"


def risk_metrics(files: DataFrame) -> DataFrame:
    lines = lines_of("text")
    complexity = F.lit(1)
    for word in RISK_WORDS:
        complexity = complexity + count_substring("text", f" {word} ")
    n = F.size(lines)
    return computed_once(files, KEYS, [
        n.cast("bigint").alias("loc"),
        complexity.cast("bigint").alias("complexity"),
        (F.size(F.filter(lines, lambda x: x.rlike(r"\A\s*(?:#|//)"))) / n).alias("comments_ratio"),
        (count_substring("text", "import ") + count_substring("text", "from ")).cast("bigint").alias("imports_count"),
        (count_substring("text", "def ") + count_substring("text", "function ")).cast("bigint").alias("functions_count"),
        count_substring("text", "class ").cast("bigint").alias("classes_count"),
        F.array_max(F.transform(lines, F.length)).cast("bigint").alias("max_line_length"),
        (1.0 - F.size(F.array_distinct(lines)) / n).alias("duplicate_ratio"),
    ])


def risk_prediction(metrics: DataFrame) -> DataFrame:
    """Score (at most 100), level, predicted issues and advice per file."""
    c, r, d = F.col("complexity"), F.col("comments_ratio"), F.col("duplicate_ratio")
    tests = [c > 20, r < 0.1, F.col("loc") > 500, d > 0.3, F.col("imports_count") > 20]
    score = (
        F.when(c > 20, 30).when(c > 10, 15).otherwise(0)
        + F.when(r < 0.1, 20).otherwise(0)
        + F.when(F.col("loc") > 500, 15).otherwise(0)
        + F.when(F.col("imports_count") > 20, 10).otherwise(0)
        + F.when(d > 0.3, 25).otherwise(0)
    )
    issues = F.array_compact(F.array(*[F.when(t, text) for t, (text, _) in zip(tests, RISK_TEXT)]))
    advice = F.array_compact(F.array(*[F.when(t, text) for t, (_, text) in zip(tests, RISK_TEXT)]))
    scored = metrics.withColumn("risk_score", F.least(F.lit(100), score).cast("double"))
    s = F.col("risk_score")
    return scored.select(
        *KEYS,
        "risk_score",
        F.when(s >= 75, "CRITICAL").when(s >= 50, "HIGH").when(s >= 25, "MEDIUM").otherwise("LOW").alias("risk_level"),
        F.array_join(issues, "\n").alias("predicted_issues"),
        F.when(F.size(advice) == 0, RISK_FINE).otherwise(F.array_join(advice, "\n")).alias("recommendation"),
        F.lit(0.85).alias("confidence"),
    )


def risky_files(predictions: DataFrame) -> DataFrame:
    """HIGH and CRITICAL files, highest score first.

    The few kept rows are shuffled once before the sort: a global sort samples
    its input first, and without a stage in between it would read and measure
    all texts twice.
    """
    kept = predictions.where(F.col("risk_level").isin("HIGH", "CRITICAL")).repartition("path")
    return kept.orderBy(F.desc("risk_score"), "path")


DEBT_PLAN = [
    "1. 重构高复杂度函数 (优先级：高)", "2. 清理 TODO/FIXME 注释 (优先级：中)",
    "3. 修复潜在 bug (优先级：高)", "4. 修复安全漏洞 (优先级：紧急)",
]


def technical_debt(files: DataFrame, hourly_rate: float = 100.0) -> DataFrame:
    """Hours and cost of paying back what simple text counts point at."""

    def total(*needles):
        result = F.lit(0)
        for needle in needles:
            result = result + count_substring("text", needle)
        return result.cast("bigint")

    counted = files.select(
        *KEYS,
        line_count("text").cast("bigint").alias("loc"),
        total("if ", "for ", "while ").alias("complexity"),
        total("TODO", "FIXME", "XXX", "HACK").alias("code_smells"),
        total("except:", "eval(", "exec(").alias("bugs"),
        total('f"SELECT', 'password = "', 'api_key = "').alias("vulnerabilities"),
    )
    hours = F.round(
        F.greatest(F.col("complexity") - 10, F.lit(0)) * 0.5
        + F.col("code_smells") * 0.25
        + F.col("bugs") * 1.0
        + F.col("vulnerabilities") * 2.0,
        2,
    )
    tests = [F.col("complexity") > 10, F.col("code_smells") > 0, F.col("bugs") > 0, F.col("vulnerabilities") > 0]
    plan = F.array_compact(F.array(*[F.when(t, text) for t, text in zip(tests, DEBT_PLAN)]))
    return counted.select(
        "*", hours.alias("debt_hours"), F.round(hours * hourly_rate, 2).alias("debt_cost_usd"),
        F.array_join(plan, "\n").alias("payback_plan"),
    )


# Words of a change message, the factor they mean, points, advice.
CHANGE_FACTORS = [
    (["security", "auth"], "安全相关变更", 30, "- 需要安全团队审查"),
    (["database", "sql"], "数据库相关变更", 20, "- 需要 DBA 审查"),
    (["api", "interface"], "接口变更", 15, "- 需要更新 API 文档"),
]
LARGE_CHANGE = (100, "大规模变更", 10, "- 建议拆分为小 PR")
CHANGE_FINE, CHANGE_HEAD = "变更风险低，可正常合并", "建议："


def change_risk(changes: DataFrame) -> DataFrame:
    """``changes(path, message)`` to one risk row per path.

    Only counts are aggregated, with partial sums, so one path may hold any
    share of the messages.
    """
    text = F.lower("message")
    flags = []
    for words, *_ in CHANGE_FACTORS:
        test = F.contains(text, F.lit(words[0]))
        for word in words[1:]:
            test = test | F.contains(text, F.lit(word))
        flags.append(test)
    flags.append(F.length("message") > LARGE_CHANGE[0])
    points = [p for _, _, p, _ in CHANGE_FACTORS] + [LARGE_CHANGE[2]]
    advice = [a for *_, a in CHANGE_FACTORS] + [LARGE_CHANGE[3]]
    names = [n for _, n, _, _ in CHANGE_FACTORS] + [LARGE_CHANGE[1]]
    counts = changes.groupBy("path").agg(
        F.count("*").alias("changes"), *[F.count_if(f).alias(f"_{i}") for i, f in enumerate(flags)]
    )
    score = sum((F.col(f"_{i}") * p for i, p in enumerate(points)), F.lit(0))
    any_flag = [F.col(f"_{i}") > 0 for i in range(len(flags))]
    factors = F.array_compact(F.array(*[F.when(t, n) for t, n in zip(any_flag, names)]))
    lines = F.array_compact(F.array(F.lit(CHANGE_HEAD), *[F.when(t, a) for t, a in zip(any_flag, advice)]))
    return counts.select(
        "path",
        "changes",
        F.least(F.lit(100), score).cast("bigint").alias("risk_score"),
        F.when(score >= 60, "HIGH").when(score >= 30, "MEDIUM").otherwise("LOW").alias("risk_level"),
        F.array_join(factors, ",").alias("risk_factors"),
        F.when(F.size(factors) == 0, CHANGE_FINE).otherwise(F.array_join(lines, "\n")).alias("recommendation"),
        (score >= 30).alias("requires_review"),
        (score >= 20).alias("requires_test"),
    )


# ---- project wide ----------------------------------------------------------

SURFACE = {
    "public_apis": "public|export|api|route",
    "user_input_points": "input|request|param|query|body",
    "output_points": "response|output|print|render",
}


def attack_surface(files: DataFrame) -> DataFrame:
    """Matches of three word groups per project and the score out of ten."""
    counted = files.select("project", *[count_matches("text", p).alias(n) for n, p in SURFACE.items()])
    totals = counted.groupBy("project").agg(*[F.sum(n).cast("bigint").alias(n) for n in SURFACE])
    score = (
        F.col("public_apis") * 0.3 + F.col("user_input_points") * 0.5 + F.col("output_points") * 0.2
    ) / 10
    return totals.withColumn("attack_surface_score", F.round(F.least(F.lit(10.0), score), 6))


def project_style(files: DataFrame) -> DataFrame:
    """Majority naming of functions, and shares of files with docstrings and hints."""
    names = F.regexp_extract_all("text", F.lit(r"def (\w+)\("), F.lit(1))
    snake = F.size(F.filter(names, lambda n: n.rlike("_") & n.rlike("[a-z]") & ~n.rlike("[A-Z]")))
    camel = F.size(F.filter(names, lambda n: n.rlike("^[a-z]") & n.rlike("^.+[A-Z]")))
    per_file = files.where(F.col("language") == "python").select(
        "project",
        snake.alias("snake"),
        camel.alias("camel"),
        F.contains("text", F.lit('"""')).alias("doc"),
        F.contains("text", F.lit("->")).alias("hint"),
    )
    return (
        per_file.groupBy("project")
        .agg(
            F.count("*").alias("files"),
            F.sum("snake").cast("bigint").alias("snake_case"),
            F.sum("camel").cast("bigint").alias("camel_case"),
            F.count_if("doc").alias("with_docstrings"),
            F.count_if("hint").alias("with_type_hints"),
        )
        .withColumn("naming", F.when(F.col("snake_case") > F.col("camel_case"), "snake_case").otherwise("camelCase"))
    )


def project_structure(files: DataFrame) -> DataFrame:
    """Files and lines below each directory, every level counted."""
    pieces = F.split("path", "/")
    depth = F.size(pieces) - 1
    levels = F.when(depth >= 1, F.sequence(F.lit(1), depth)).otherwise(F.array().cast("array<int>"))
    prefixes = F.transform(levels, lambda k: F.array_join(F.slice(pieces, F.lit(1), k), "/"))
    counted = files.select("project", F.explode(prefixes).alias("directory"), line_count("text").alias("lines"))
    return counted.groupBy("project", "directory").agg(
        F.count("*").alias("files"), F.sum("lines").cast("bigint").alias("lines")
    ).withColumn("level", F.size(F.split("directory", "/")))
