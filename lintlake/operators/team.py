"""Contributor, fix-vote and progress reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def contributor_stats(commits: DataFrame) -> DataFrame:
    """``commits(author, commit_id, ts, issues)``: totals and score of the last commit."""
    last = F.max(F.struct("ts", "commit_id", "issues"))
    return commits.groupBy("author").agg(
        F.count("*").alias("total_commits"), F.sum("issues").cast("bigint").alias("total_issues"), last.alias("_l")
    ).select(
        "author", "total_commits", "total_issues",
        F.greatest(F.lit(0), 100 - F.col("_l.issues") * 5).cast("bigint").alias("quality_score"),
    )


def team_overview(stats: DataFrame) -> DataFrame:
    return stats.agg(
        F.count("*").alias("total_members"),
        F.round(F.coalesce(F.avg("quality_score"), F.lit(0.0)), 1).alias("average_quality_score"),
        F.coalesce(F.sum("total_issues"), F.lit(0)).cast("bigint").alias("total_issues"),
    )


def top_contributors(stats: DataFrame, limit: int = 5) -> DataFrame:
    return stats.orderBy(F.desc("quality_score"), "author").limit(limit)


# Weight of a suggestion by the model that made it.
MODEL_WEIGHTS = {"gpt-4": 1.2, "claude-3": 1.15, "gemini-pro": 1.1, "qwen2.5-coder:7b": 1.0}


def fix_scores(suggestions: DataFrame) -> DataFrame:
    """``suggestions(issue_id, suggestion_id, model, confidence, pros, cons, estimated_time)`` with score."""
    weight = F.lit(1.0)
    for name, w in MODEL_WEIGHTS.items():
        weight = F.when(F.col("model") == name, w).otherwise(weight)
    t = F.col("estimated_time")
    raw = F.col("confidence") * 50 + F.size("pros") * 5 - F.size("cons") * 3
    raw = raw + F.when(t < 30, 10).when(t < 60, 5).otherwise(0)
    return suggestions.withColumn("score", F.least(F.lit(100.0), raw * weight))


def fix_ranking(suggestions: DataFrame) -> DataFrame:
    """All suggestions of an issue, best first."""
    order = Window.partitionBy("issue_id").orderBy(F.desc("score"), "suggestion_id")
    return fix_scores(suggestions).withColumn("rank", F.row_number().over(order))


def best_fix(suggestions: DataFrame) -> DataFrame:
    """One suggestion per issue, by partial aggregation instead of a ranking."""
    best = F.max(F.struct("score", (-F.col("suggestion_id")).alias("_neg"), "model", "confidence")).alias("_b")
    return fix_scores(suggestions).groupBy("issue_id").agg(best, F.count("*").alias("suggestions")).select(
        "issue_id", (-F.col("_b._neg")).alias("suggestion_id"), "_b.model", "_b.confidence", "_b.score", "suggestions"
    )


def fix_history_stats(history: DataFrame) -> DataFrame:
    """``history(model, confidence, success, latency_ms)`` to one row of totals."""
    ok = F.col("success")
    models = history.where(ok).groupBy("model").agg(F.count("*").alias("n"))
    favourite = models.agg(F.min(F.struct((-F.col("n")).alias("_n"), "model")).alias("_m")).select(
        F.coalesce("_m.model", F.lit("N/A")).alias("most_used_model"), F.lit(1).alias("_k")
    )
    totals = history.agg(
        F.count("*").alias("total_requests"),
        F.count_if(ok).alias("successful_requests"),
        F.coalesce(F.avg(F.when(ok, F.col("confidence"))), F.lit(0.0)).alias("average_confidence"),
        F.coalesce(F.sum("latency_ms"), F.lit(0)).alias("_time"),
    ).withColumn("_k", F.lit(1))
    return totals.join(favourite, "_k").select(
        "total_requests",
        "successful_requests",
        "most_used_model",
        "average_confidence",
        (F.col("_time") / F.greatest("successful_requests", F.lit(1))).alias("avg_time_ms"),
        (F.col("successful_requests") / F.greatest("total_requests", F.lit(1))).alias("success_rate"),
    )


def fix_quality(suggestions: DataFrame) -> DataFrame:
    """Score 0-10 and grade of ``(id, fixes ARRAY<STRUCT<code,pros,cons>>, recommendation, avg_time_ms)``."""
    n = F.size("fixes")
    has_code = F.exists("fixes", lambda f: F.length(F.coalesce(f["code"], F.lit(""))) > 0)
    has_analysis = F.forall("fixes", lambda f: f["pros"].isNotNull() & f["cons"].isNotNull())
    two = lambda test: F.when(test, 2).otherwise(0)
    score = (
        F.when(n >= 2, 2).when(n == 1, 1).otherwise(0) + two(has_code) + two(has_analysis)
        + two(F.col("recommendation").isNotNull()) + two(F.col("avg_time_ms") < 5000)
    )
    return suggestions.select(
        "id",
        score.alias("score"),
        F.when(score >= 8, "优秀").when(score >= 6, "良好").when(score >= 4, "及格").otherwise("需改进").alias("quality"),
        has_code.alias("has_code"),
        has_analysis.alias("has_analysis"),
    )


def kpi_progress(kpi: DataFrame) -> DataFrame:
    """``kpi(metric, baseline, current, target, direction)`` with percent done, at most 100."""
    lower = F.col("direction") == "lower_better"
    needed = F.when(lower, F.col("baseline") - F.col("target")).otherwise(F.col("target") - F.col("baseline"))
    done = F.when(lower, F.col("baseline") - F.col("current")).otherwise(F.col("current") - F.col("baseline"))
    percent = F.when(needed == 0, 100.0).otherwise(F.least(F.lit(100.0), done / F.nullif(needed, F.lit(0.0)) * 100))
    return kpi.withColumn("progress", percent)


def overall_progress(progress: DataFrame) -> DataFrame:
    return progress.agg(F.avg("progress").alias("overall_progress"))


def request_counts(requests: DataFrame, max_requests: int, window_seconds: int) -> DataFrame:
    """``requests(key, ts)``: requests in the trailing window and what is left.

    Time runs inside (key, bucket) parts with one bucket of overlap, so a hot
    key is spread over many windows instead of one.
    """
    w = window_seconds
    seconds = F.unix_micros(F.col("ts").cast("timestamp"))
    bucket = F.floor(seconds / (w * 1_000_000)).cast("bigint")
    keyed = requests.select("key", "ts", seconds.alias("_us"), bucket.alias("_b"))
    # Every request also serves the next bucket as context.
    spread = keyed.select("key", "ts", "_us", F.explode(F.array(F.struct(F.col("_b").alias("b"), F.lit(True).alias("own")), F.struct((F.col("_b") + 1).alias("b"), F.lit(False).alias("own")))).alias("_p"))
    frame = Window.partitionBy("key", "_p.b").orderBy("_us").rangeBetween(-(w * 1_000_000) + 1, 0)
    counted = spread.withColumn("requests_in_window", F.count("*").over(frame)).where("_p.own")
    return counted.select(
        "key", "ts", "requests_in_window",
        F.greatest(F.lit(0), max_requests - F.col("requests_in_window")).cast("bigint").alias("remaining"),
    )
