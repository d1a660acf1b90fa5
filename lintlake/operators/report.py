"""Counts, scores, gates, plans and rankings over findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake.functions.text import col_of

# Rank by severity (others last), SARIF level and editor number by severity.
SEVERITY_RANK = {"error": 0, "warning": 1, "info": 2}
SARIF_LEVEL = {
    "ERROR": "error", "CRITICAL": "error", "HIGH": "error", "WARNING": "warning", "MEDIUM": "warning",
    "INFO": "note", "LOW": "note", "NOTE": "note",
}
EDITOR_NUMBER = {"ERROR": 1, "WARNING": 2, "INFO": 3, "HINT": 4}


def _map(table: dict, key: Column, default) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), F.lit(default))


def severity_rank(severity) -> Column:
    return _map(SEVERITY_RANK, col_of(severity), 3)


def sarif_level(severity) -> Column:
    return _map(SARIF_LEVEL, F.upper(col_of(severity)), "warning")


def editor_severity(severity) -> Column:
    """Number of the editor's scale; unknown ones count as warnings."""
    return _map(EDITOR_NUMBER, F.upper(col_of(severity)), 2)


def count_by(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(F.coalesce(F.col(key), F.lit("unknown")).alias(key)).agg(F.count("*").alias("count"))


def dimension_counts(findings: DataFrame, dimensions: list[str]) -> DataFrame:
    """Counts per value of each dimension and in total, in one shuffle.

    Rows: ``dimension, key, count``; the total has dimension ``total``.
    """
    grouped = findings.groupingSets([[d] for d in dimensions] + [[]], *dimensions).agg(
        F.count("*").alias("count"), *[F.grouping(d).alias(f"_{d}") for d in dimensions]
    )
    name = F.lit("total")
    key = F.lit("*")
    for d in dimensions:
        used = F.col(f"_{d}") == 0
        name = F.when(used, d).otherwise(name)
        key = F.when(used, F.coalesce(F.col(d).cast("string"), F.lit("unknown"))).otherwise(key)
    return grouped.select(name.alias("dimension"), key.alias("key"), "count")


def directory_report(files: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings by severity, category, language and rule, with file counts.

    ``files`` may carry an ``error`` column for files that could not be read.
    """
    failed = F.col("error").isNotNull() if "error" in files.columns else F.lit(False)
    status = files.select(F.when(failed, "failed").otherwise("analyzed").alias("key")).groupBy("key").agg(
        F.count("*").alias("count")
    )
    return dimension_counts(findings, ["severity", "category", "language", "rule"]).unionByName(
        status.select(F.lit("files").alias("dimension"), "key", "count")
    )


def review_summary(findings: DataFrame) -> DataFrame:
    """Per file: totals by severity, categories and fixable ones."""
    return findings.groupBy("project", "path").agg(
        F.count("*").alias("total_issues"),
        *[F.count_if(F.col("severity") == s).alias(f"{s}_count") for s in ("error", "warning", "info", "hint")],
        F.countDistinct("category").alias("categories"),
        F.count_if("auto_fixable").alias("auto_fixable"),
    )


def project_facts(findings: DataFrame, diagnostics: DataFrame | None = None, toolchain: DataFrame | None = None) -> DataFrame:
    """The counts all project verdicts are made from, one row per project.

    ``toolchain(project, toolchain_issues, toolchain_warnings, toolchain_action)``.
    """
    facts = findings.groupBy("project").agg(
        F.count("*").alias("issues"),
        *[F.count_if(F.col("severity") == s).alias(f"{s}s") for s in ("error", "warning")],
        F.count_if(F.col("category") == "security").alias("security"),
        F.count_if(F.col("category").isin("complexity", "maintainability")).alias("complexity"),
    )
    zero = F.lit(0).cast("bigint")
    if diagnostics is None:
        facts = facts.withColumn("diagnostics", zero)
    else:
        found = diagnostics.groupBy("project").agg(F.count("*").alias("diagnostics"))
        facts = facts.join(found, "project", "full")
    if toolchain is None:
        facts = facts.select(
            "*", zero.alias("toolchain_issues"), zero.alias("toolchain_warnings"),
            F.lit(None).cast("string").alias("toolchain_action"),
        )
    else:
        facts = facts.join(toolchain, "project", "full")
    counts = [c for c in facts.columns if c not in ("project", "toolchain_action")]
    return facts.select("project", *[F.coalesce(c, zero).alias(c) for c in counts], "toolchain_action")


def quality_scores(facts: DataFrame) -> DataFrame:
    score = F.greatest(
        F.lit(0),
        100 - F.col("errors") * 8 - F.col("warnings") * 3 - F.col("diagnostics") * 4
        - F.col("toolchain_issues") * 10 - F.col("toolchain_warnings") * 4,
    )
    return facts.select(
        "project",
        score.cast("bigint").alias("quality_score"),
        F.when(score < 50, "high").when(score < 75, "medium").otherwise("low").alias("risk_level"),
    )


def _numbered(text: str, column: str) -> Column:
    head, tail = text.split("{n}")
    return F.concat(F.lit(head), F.col(column).cast("string"), F.lit(tail))


def quality_gate(facts: DataFrame) -> DataFrame:
    """pass / warn / fail with what blocks and how many warnings."""
    tests = [
        ("errors", "error-level findings: {n}"),
        ("diagnostics", "compiler diagnostics: {n}"),
        ("toolchain_issues", "toolchain issues: {n}"),
    ]
    blockers = F.array_compact(F.array(*[F.when(F.col(c) > 0, _numbered(t, c)) for c, t in tests]))
    warned = F.col("warnings") + F.col("toolchain_warnings")
    return facts.select(
        "project",
        F.when(F.size(blockers) > 0, "fail").when(warned > 0, "warn").otherwise("pass").alias("status"),
        F.array_join(blockers, "; ").alias("blockers"),
        warned.alias("warning_count"),
    )


# Count column, priority, reason, action; the toolchain may name its own action.
ADVICE = [
    ("errors", "high", "Found {n} high-severity code issues.",
     "Fix error-level findings before merging or releasing."),
    ("diagnostics", "high", "Compiler/type diagnostics reported {n} issue(s).",
     "Resolve TypeScript/JavaScript diagnostics to restore a clean build."),
    ("security", "high", "Security-related findings detected: {n}.",
     "Review and remediate injection, secret-handling, and dependency security findings first."),
    ("toolchain_issues", "high", "Toolchain problems detected: {n}.",
     "Repair the project toolchain and dependency installation before rerunning analysis."),
    ("complexity", "medium", "Complexity or maintainability hotspots were found.",
     "Refactor the top hotspot files after blocking errors are fixed."),
]


def recommendations(facts: DataFrame) -> DataFrame:
    items = []
    for order, (column, priority, reason, action) in enumerate(ADVICE):
        reason_text = _numbered(reason, column) if "{n}" in reason else F.lit(reason)
        action_text = F.coalesce("toolchain_action", F.lit(action)) if column == "toolchain_issues" else F.lit(action)
        items.append(
            F.when(
                F.col(column) > 0,
                F.struct(
                    F.lit(order).alias("step_order"), F.lit(priority).alias("priority"),
                    action_text.alias("action"), reason_text.alias("reason"),
                ),
            )
        )
    rows = facts.select("project", F.explode(F.array_compact(F.array(*items))).alias("_r"))
    return rows.select("project", "_r.step_order", "_r.priority", "_r.action", "_r.reason")


def file_scores(findings: DataFrame, metrics: DataFrame) -> DataFrame:
    """``metrics(project, path, language, cyclomatic, maintainability_index)`` with issue counts."""
    counted = findings.groupBy("project", "path").agg(F.count("*").alias("issue_count"))
    return metrics.join(counted, ["project", "path"], "left").select(
        "project",
        "path",
        "language",
        F.coalesce("issue_count", F.lit(0)).alias("issue_count"),
        F.col("cyclomatic").alias("cyclomatic_complexity"),
        "maintainability_index",
        (F.coalesce("issue_count", F.lit(0)) + F.col("cyclomatic")).alias("score"),
    )


def hotspots(scores: DataFrame, limit: int = 10) -> DataFrame:
    """Files with most issues plus complexity; a bounded top-k, not a full sort."""
    return scores.orderBy(F.desc("score"), "path").limit(limit)


def project_hotspots(scores: DataFrame, limit: int = 10) -> DataFrame:
    """The same per project; ranks are cut before the shuffle."""
    order = Window.partitionBy("project").orderBy(F.desc("score"), "path")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def top_findings(findings: DataFrame, limit: int = 20) -> DataFrame:
    return findings.orderBy(severity_rank("severity"), "path", "line", "column", "rule", "message").limit(limit)


def limit_per_file(findings: DataFrame, limit: int = 100) -> DataFrame:
    """At most ``limit`` findings of each file, in file order."""
    order = Window.partitionBy("project", "path").orderBy("line", "column", "rule", "message")
    return findings.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit).drop("_n")


def findings_page(findings: DataFrame, page: int = 1, per_page: int = 50, severity: str | None = None) -> DataFrame:
    if severity:
        findings = findings.where(F.lower("severity") == severity.lower())
    order = [c for c in ("line", "path", "column", "rule", "message") if c in findings.columns]
    return findings.orderBy(*order).offset((page - 1) * per_page).limit(per_page)


def top_rules(findings: DataFrame, rule: str = "rule", limit: int = 10) -> DataFrame:
    counted = findings.groupBy(F.coalesce(F.col(rule), F.lit("unknown")).alias("rule")).agg(F.count("*").alias("count"))
    return counted.orderBy(F.desc("count"), "rule").limit(limit)


def action_plan(recommended: DataFrame, dependency_summary: DataFrame | None, scores: DataFrame) -> DataFrame:
    """Recommendations, one dependency step, and the three worst files of a project."""
    plan = recommended.select("project", "step_order", "priority", "action", "reason")
    if dependency_summary is not None:
        step = dependency_summary.where(F.col("total_issues") > 0).select(
            "project",
            F.lit(len(ADVICE)).alias("step_order"),
            F.lit("high").alias("priority"),
            F.lit("Review dependency vulnerabilities and upgrade or replace risky packages.").alias("action"),
            _numbered("Dependency report contains {n} issue(s).", "total_issues").alias("reason"),
        )
        plan = plan.unionByName(step)
    worst = project_hotspots(scores, 3).select(
        "project",
        (F.col("rank") + len(ADVICE)).alias("step_order"),
        F.lit("medium").alias("priority"),
        F.concat(F.lit("Refactor hotspot file: "), "path").alias("action"),
        F.concat(
            F.lit("High issue/complexity score ("), F.col("issue_count").cast("string"), F.lit(" issues, CC="),
            F.col("cyclomatic_complexity").cast("string"), F.lit(")."),
        ).alias("reason"),
    )
    return plan.unionByName(worst)


def fix_proposals(findings: DataFrame) -> DataFrame:
    """Changed line for fixable findings, manual steps for the others.

    Takes findings scanned with ``around=0``, which carry their own line.
    """
    line = F.col("snippet")
    code = (
        F.when(F.col("rule") == "missingClosing", F.concat(line, F.lit(" }")))
        .when(F.col("rule") == "missingSemicolon", F.concat(F.regexp_replace(line, r"\s+\z", ""), F.lit(";")))
        .when(F.col("rule") == "offByOne", F.regexp_replace(line, r"\A([\s\S]*?)<=", "$1<"))
    )
    steps = F.concat_ws(
        "\n",
        F.concat(F.lit("Locate the issue at line "), F.col("line").cast("string")),
        F.col("suggestion"),
        F.lit("Review the change in context"),
        F.lit("Test the modified code"),
    )
    return findings.select(
        "*",
        F.col("auto_fixable").alias("has_auto_fix"),
        F.when(F.col("auto_fixable"), code).alias("fix_code"),
        F.when(~F.col("auto_fixable"), steps).alias("manual_steps"),
    )


# Part of a rule id -> advice; the first part that occurs decides.
RULE_ADVICE = [
    ("sql-injection", '使用参数化查询：cursor.execute("SELECT ... WHERE id = %s", (user_id,))'),
    ("hardcoded-password", '使用环境变量：os.environ.get("PASSWORD")'),
    ("bare-except", "捕获具体异常：except Exception as e:"),
    ("unused-import", "移除未使用的导入"),
    ("missing-type-hint", "添加类型提示：def func(param: str) -> int:"),
]
OTHER_ADVICE = "请查看 Semgrep 文档获取修复建议"
# Part of a rule id -> title and new text of a quick fix.
QUICK_FIXES = [
    ("sql-injection", "使用参数化查询", 'execute("{}", ())'),
    ("hardcoded-password", "使用环境变量", 'password = os.environ.get("PASSWORD")'),
    ("bare-except", "捕获具体异常", "except Exception as e:"),
]


def rule_suggestions(findings: DataFrame) -> DataFrame:
    """Advice and quick fix of each finding by its rule id."""

    def pick(pairs):
        result = None
        for part, value in pairs:
            test = F.contains("rule", F.lit(part))
            result = F.when(test, value) if result is None else result.when(test, value)
        return result

    return findings.select(
        "*",
        pick(RULE_ADVICE).otherwise(OTHER_ADVICE).alias("advice"),
        pick([(p, t) for p, t, _ in QUICK_FIXES]).alias("quick_fix_title"),
        pick([(p, n) for p, _, n in QUICK_FIXES]).alias("quick_fix_text"),
    )


def rule_coverage(rules: DataFrame, findings: DataFrame) -> DataFrame:
    """Every rule of a catalogue with its findings, also those without any."""
    counted = findings.groupBy("engine", "rule").agg(F.count("*").alias("findings"), F.countDistinct("path").alias("files"))
    listed = rules.groupBy("engine", "rule").agg(F.count("*").alias("patterns"))
    return listed.join(counted, ["engine", "rule"], "left").select(
        "engine", "rule", "patterns", F.coalesce("findings", F.lit(0)).alias("findings"), F.coalesce("files", F.lit(0)).alias("files")
    )


def engine_selection(files: DataFrame, rules) -> DataFrame:
    """Per language of the files: which engines apply and with how many patterns.

    The catalogue is a literal array, tested against each distinct language.
    """
    texts = lambda names: F.array(*[F.lit(n) for n in names]).cast("array<string>")
    table = F.array(
        *[
            F.struct(
                F.lit(r.engine).alias("engine"),
                texts([x for x in r.languages if not x.startswith("!")]).alias("only"),
                texts([x[1:] for x in r.languages if x.startswith("!")]).alias("never"),
            )
            for r in rules
        ]
    )
    applies = lambda x: ((F.size(x["only"]) == 0) | F.array_contains(x["only"], F.col("language"))) & ~F.array_contains(
        x["never"], F.col("language")
    )
    languages = files.groupBy("language").agg(F.count("*").alias("files"))
    return (
        languages.select("language", "files", F.explode(F.filter(table, applies)).alias("_r"))
        .groupBy("language", "files", F.col("_r.engine").alias("engine"))
        .agg(F.count("*").alias("patterns"))
    )


def scan_statistics(files: DataFrame) -> DataFrame:
    """Scanned, skipped and failed files with lines and bytes; ``files`` as in a corpus scan."""
    from lintlake.functions.language import detect_scanner_language
    from lintlake.functions.text import line_count

    failed = F.col("error").isNotNull() if "error" in files.columns else F.lit(False)
    supported = detect_scanner_language("path").isNotNull()
    status = F.when(failed, "failed").when(supported, "scanned").otherwise("skipped")
    facts = files.select(
        status.alias("status"), line_count("text").alias("lines"), F.octet_length("text").alias("bytes")
    )
    scanned = F.col("status") == "scanned"
    return facts.agg(
        F.count("*").alias("total_files"),
        *[F.count_if(F.col("status") == s).alias(f"{s}_files") for s in ("scanned", "skipped", "failed")],
        F.coalesce(F.sum(F.when(scanned, F.col("lines"))), F.lit(0)).cast("bigint").alias("total_lines"),
        F.coalesce(F.sum(F.when(scanned, F.col("bytes"))), F.lit(0)).cast("bigint").alias("total_bytes"),
    )
