"""The composite queries, each a composition of operators over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lintlake.operators import baseline, dependencies, diagnostics, logs, metrics, report, rewrite, structure, taint
from lintlake.operators.scan import scan_rules
from lintlake.plans.analysis import project_findings, quality_findings
from lintlake.rules import quality


def analyze_project(files: DataFrame, deps: DataFrame | None = None, toolchain: DataFrame | None = None) -> dict[str, DataFrame]:
    """Findings, diagnostics, metrics, hotspots, scores, gate, advice and plan of a project."""
    findings = project_findings(files)
    diags = diagnostics.all_diagnostics(files)
    facts = report.project_facts(findings, diags, toolchain)
    sizes = files.select("project", "path", "language", metrics.file_complexity("text").alias("cyclomatic"), metrics.halstead("text").alias("_h"))
    sizes = sizes.select("project", "path", "language", "cyclomatic", metrics.halstead_numbers("_h")[-1])
    scores = report.file_scores(findings, sizes)
    advice = report.recommendations(facts)
    summary = None
    if deps is not None:
        merged = dependencies.merge_dependencies(deps)
        summary = dependencies.issue_summary(merged, dependencies.check_dependencies(merged))
    return {
        "findings": findings,
        "diagnostics": diags,
        "by_severity": report.dimension_counts(findings, ["severity", "category"]),
        "hotspots": report.hotspots(scores),
        "top_findings": report.top_findings(findings),
        "scores": report.quality_scores(facts),
        "quality_gate": report.quality_gate(facts),
        "recommendations": advice,
        "action_plan": report.action_plan(advice, summary, scores),
    }


def generate_report(files: DataFrame) -> DataFrame:
    return report.directory_report(files, quality_findings(files))


def check_dependencies(manifests: DataFrame) -> dict[str, DataFrame]:
    """Issues, summary and suggestions of the preferred manifest of each project."""
    from lintlake.sources.manifests import read_manifests

    chosen = dependencies.preferred_manifest(manifests)
    deps = read_manifests(manifests).join(chosen, ["project", "manifest"], "left_semi")
    merged = dependencies.merge_dependencies(deps)
    issues = dependencies.check_dependencies(merged)
    return {
        "issues": issues,
        "summary": dependencies.issue_summary(merged, issues),
        "suggestions": dependencies.fix_suggestions(issues),
    }


def analyze_logs(files: DataFrame, max_lines: int | None = None) -> dict[str, DataFrame]:
    """``files(path, text)``: entries, events, summary and advice; the format comes from each text."""
    # The format is known before a text is cut into lines, so lines need no join.
    entries = logs.parse_lines(logs.log_file_lines(files.select("path", "text", logs.detect_format("text").alias("format")), max_lines))
    summary = logs.summarize(entries)
    return {
        "entries": entries,
        "events": logs.events_found(entries),
        "summary": summary,
        "recommendations": logs.recommendations(summary),
    }


def deep_security_scan(files: DataFrame) -> dict[str, DataFrame]:
    findings, endpoints = taint.taint_findings(files), taint.api_endpoints(files)
    return {"findings": findings, "endpoints": endpoints, "report": taint.deep_scan_report(findings, endpoints)}


def predict_risks(files: DataFrame, changes: DataFrame | None = None) -> dict[str, DataFrame]:
    predictions = metrics.risk_prediction(metrics.risk_metrics(files))
    result = {"risky_files": metrics.risky_files(predictions), "debt": metrics.technical_debt(files)}
    if changes is not None:
        result["changes"] = metrics.change_risk(changes)
    return result


def compare_baseline(before: DataFrame, after: DataFrame) -> dict[str, DataFrame]:
    return {"findings": baseline.compare(before, after), "summary": baseline.comparison_summary(before, after)}


def analyze_complexity(files: DataFrame) -> dict[str, DataFrame]:
    from lintlake.operators.graph import inheritance_depth

    units = structure.code_units(files)
    functions = structure.function_metrics(units)
    summary = structure.complexity_report(files, units)
    return {
        "summary": summary,
        "functions": functions,
        "classes": structure.class_metrics(units),
        "inheritance": inheritance_depth(structure.inheritance_edges(files)),
        "halstead": metrics.halstead_metrics(files),
        "hotspots": structure.complex_functions(functions),
        "recommendations": structure.complexity_recommendations(summary),
    }


def enhanced_security_scan(files: DataFrame) -> dict[str, DataFrame]:
    """Symbols, complexity and dependencies, with sensitive code and attack surface."""
    from lintlake.operators.graph import module_dependents

    return {
        "symbols": structure.symbols(files),
        "complexity": metrics.complexity_scores(files),
        "dependencies": module_dependents(structure.import_edges(files)),
        "sensitive": taint.sensitive_terms(files),
        "attack_surface": metrics.attack_surface(files),
    }


def check_code_quality(files: DataFrame) -> dict[str, DataFrame]:
    issues, checks = taint.deep_check(files), diagnostics.python_checks(files)
    return {"issues": issues, "checks": checks, "statistics": diagnostics.check_statistics(files, checks, issues)}


def auto_fix(files: DataFrame) -> dict[str, DataFrame]:
    rewritten = rewrite.apply_rewrites(files.where("language = 'python'"), rewrite.PYTHON_REWRITES)
    return {
        "rewritten": rewritten,
        "counts": rewrite.rewrite_counts(rewritten),
        "report": rewrite.rewrite_report(rewritten),
        "diffs": rewrite.unified_diffs(rewritten),
    }


def review_change(before: DataFrame, after: DataFrame) -> dict[str, DataFrame]:
    """Diagnostics of the files a change touched."""
    changed = baseline.changed_files(before, after)
    found = taint.review_diagnostics(changed)
    return {"diagnostics": found, "summary": taint.review_summary(changed, found)}


def scan_project(files: DataFrame, rules) -> dict[str, DataFrame]:
    return {"findings": scan_rules(files, rules), "statistics": report.scan_statistics(files)}


def incremental_scan(before: DataFrame, after: DataFrame, rules) -> DataFrame:
    return scan_rules(baseline.changed_files(before, after), rules)
