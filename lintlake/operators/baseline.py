"""Finding snapshots: ids, baselines, comparison, statistics and trends.

Input rows: ``rule_id, file, line, column, severity, category, message``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.functions.text import content_hash, finding_id
from lintlake.operators.report import dimension_counts, top_rules
from lintlake.session import cut_lineage

_FIELDS = ["rule_id", "severity", "file", "line", "column", "message", "status"]


def with_ids(findings: DataFrame) -> DataFrame:
    return findings.withColumn("id", finding_id("rule_id", "file", "line", "column"))


def unique_findings(findings: DataFrame) -> DataFrame:
    """One row per id; among equal ids the greatest text wins, in any order of input."""
    status = F.col("status") if "status" in findings.columns else F.lit("open")
    filled = with_ids(findings).select(
        "id",
        F.coalesce("rule_id", F.lit("")).alias("rule_id"),
        F.coalesce("severity", F.lit("WARNING")).alias("severity"),
        F.coalesce("file", F.lit("")).alias("file"),
        F.coalesce("line", F.lit(0)).alias("line"),
        F.coalesce("column", F.lit(0)).alias("column"),
        F.coalesce("message", F.lit("")).alias("message"),
        status.alias("status"),
    )
    picked = filled.groupBy("id").agg(
        F.max(F.struct("message", *[c for c in _FIELDS if c != "message"])).alias("_f"), F.count("*").alias("copies")
    )
    return picked.select("id", *[F.col("_f")[c].alias(c) for c in _FIELDS], "copies")


def compare(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """``state`` new / fixed / persistent per id, by one full outer join on unique ids."""
    left = unique_findings(baseline).select("id", *[F.col(c).alias(f"b_{c}") for c in _FIELDS])
    right = unique_findings(current).select("id", "copies", *[F.col(c).alias(f"c_{c}") for c in _FIELDS])
    state = (
        F.when(F.col("b_status").isNull(), "new").when(F.col("c_status").isNull(), "fixed").otherwise("persistent")
    )
    return left.join(right, "id", "full").select(
        "id",
        state.alias("state"),
        *[F.coalesce(F.col(f"c_{c}"), F.col(f"b_{c}")).alias(c) for c in _FIELDS if c != "status"],
        F.coalesce("copies", F.lit(0)).alias("copies"),
    )


def comparison_summary(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Totals and trend in one row; ``current_total`` counts repeats, ids do not."""
    return trend(
        compare(baseline, current).agg(
            F.count_if(F.col("state") != "new").alias("baseline_total"),
            F.coalesce(F.sum("copies"), F.lit(0)).cast("bigint").alias("current_total"),
            *[F.count_if(F.col("state") == s).alias(f"{s}_issues") for s in ("new", "fixed", "persistent")],
        )
    )


def trend(totals: DataFrame) -> DataFrame:
    """Direction, percent and difference from ``baseline_total`` and ``current_total``."""
    b, c = F.col("baseline_total"), F.col("current_total")
    percent = F.when(b == 0, F.when(c > 0, 100.0).otherwise(0.0)).otherwise((c - b) / b * 100)
    return totals.select(
        "*",
        F.when(percent < 0, "improving").when(percent > 0, "worsening").otherwise("stable").alias("direction"),
        F.round(percent, 2).alias("change_percent"),
        (c - b).alias("change_absolute"),
    )


def set_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct ids of the left side that the right side lacks."""
    return with_ids(left).select("id").distinct().join(with_ids(right).select("id"), "id", "left_anti")


def set_intersection(left: DataFrame, right: DataFrame) -> DataFrame:
    return with_ids(left).select("id").distinct().join(with_ids(right).select("id"), "id", "left_semi")


def statistics(findings: DataFrame) -> DataFrame:
    """Unique findings by severity, status and file, and the total."""
    return dimension_counts(unique_findings(findings), ["severity", "status", "file"])


def totals(findings: DataFrame) -> DataFrame:
    return unique_findings(findings).agg(
        F.count("*").alias("total_findings"), F.countDistinct("file").alias("total_files")
    )


def baseline_top_rules(findings: DataFrame, limit: int = 10) -> DataFrame:
    return top_rules(unique_findings(findings), "rule_id", limit)


def dashboard_statistics(findings: DataFrame) -> DataFrame:
    """Counts by severity and category with the dashboard's defaults."""
    filled = findings.select(
        F.coalesce("severity", F.lit("WARNING")).alias("severity"),
        F.coalesce("category", F.lit("security")).alias("category"),
    )
    return dimension_counts(filled, ["severity", "category"])


def daily_trend(findings: DataFrame, ts: str = "timestamp") -> DataFrame:
    severity = F.lower(F.coalesce("severity", F.lit("WARNING")))
    return (
        findings.where(F.col(ts).isNotNull())
        .groupBy(F.to_date(ts).alias("date"))
        .agg(
            F.count("*").alias("total"),
            *[F.count_if(severity == s).alias(s) for s in ("error", "warning", "info")],
        )
        .orderBy("date")
    )


def quality_trend(daily: DataFrame, start: str, days: int) -> DataFrame:
    """``daily(date, new_issues, issues_fixed)`` on every day of a span, gaps as 0."""
    spark = daily.sparkSession
    spine = spark.range(1).select(
        F.explode(F.sequence(F.lit(start).cast("date"), F.date_add(F.lit(start).cast("date"), days - 1))).alias("date")
    )
    filled = spine.join(daily, "date", "left").select(
        "date",
        F.coalesce("new_issues", F.lit(0)).alias("new_issues"),
        F.coalesce("issues_fixed", F.lit(0)).alias("issues_fixed"),
    )
    return filled.withColumn("quality_score", F.greatest(F.lit(0), 100 - F.col("new_issues") * 5).cast("bigint"))


def file_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """``files(path, text)`` of two snapshots to new / modified / unchanged / deleted.

    Texts are hashed before the join, so only paths and hashes are shuffled.
    """
    left = before.select("path", content_hash("text").alias("old_hash"))
    right = after.select("path", content_hash("text").alias("new_hash"))
    status = (
        F.when(F.col("old_hash").isNull(), "new")
        .when(F.col("new_hash").isNull(), "deleted")
        .when(F.col("old_hash") == F.col("new_hash"), "unchanged")
        .otherwise("modified")
    )
    return left.join(right, "path", "full").select("path", status.alias("status"), "old_hash", "new_hash")


#: (path, hash) rows that may be broadcast: some hundred bytes each.
SHARED_KEYS = 100_000


def rows_of_keys(files: DataFrame, keys: DataFrame, shared_keys: int = SHARED_KEYS) -> DataFrame:
    """Files, with ``content_hash``, whose (path, content_hash) is among ``keys``, a table that is cheap to count.

    As long as the keys are few, they go to the texts, which stay where they
    are; beyond that both sides are joined by key.
    """
    if keys.count() <= shared_keys:
        keys = F.broadcast(keys)
    return files.withColumn("content_hash", content_hash("text")).join(keys, ["path", "content_hash"], "left_semi")


def changed_files(before: DataFrame, after: DataFrame, shared_keys: int = SHARED_KEYS) -> DataFrame:
    """Files of the later snapshot to scan again, with their hash.

    Paths and hashes are compared first, in a table in the checkpoint folder;
    only then the texts of the changed files are looked up.
    """
    seen = before.select("path", content_hash("text").alias("content_hash"))
    keys = after.select("path", content_hash("text").alias("content_hash")).join(seen, ["path", "content_hash"], "left_anti")
    return rows_of_keys(after, cut_lineage(keys.distinct()), shared_keys)
