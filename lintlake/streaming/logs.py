"""Continuous log triage and windowed counts with the batch expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.operators.logs import classify, detect_line_format, events_found, parse_lines


def read_log_stream(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """``lines(path, line, raw)`` of files arriving in a folder; a stream has no line numbers."""
    lines = spark.readStream.option("maxFilesPerTrigger", max_files).text(folder)
    return lines.select(
        F.col("_metadata.file_path").alias("path"), F.lit(0).alias("line"), F.col("value").alias("raw")
    ).where(~F.col("raw").rlike(r"\A\s*\z"))


def triage(lines: DataFrame) -> DataFrame:
    """Stateless: format per line, parse, classes and events. Batch or stream."""
    return classify(parse_lines(lines.withColumn("format", detect_line_format("raw"))))


def triage_events(lines: DataFrame) -> DataFrame:
    return events_found(parse_lines(lines.withColumn("format", detect_line_format("raw"))))


def windowed_counts(entries: DataFrame, window: str = "10 minutes", lateness: str = "1 hour") -> DataFrame:
    """Entries per level and events per kind in event-time windows.

    State is a few counters per open window; rows later than the watermark
    are dropped.
    """
    timed = entries.where("ts IS NOT NULL")
    if entries.isStreaming:
        timed = timed.withWatermark("ts", lateness)
    is_level = lambda x: F.count_if(F.col("level_class") == x)
    return timed.groupBy(F.window("ts", window).alias("window")).agg(
        F.count("*").alias("entries"),
        is_level("error").alias("errors"),
        is_level("warn").alias("warnings"),
        F.count_if(F.size("security") > 0).alias("security_issues"),
        F.count_if(F.size("performance") > 0).alias("performance_issues"),
    ).select("window.start", "window.end", "entries", "errors", "warnings", "security_issues", "performance_issues")


def error_rate_alerts(counts: DataFrame, rate: float = 0.2) -> DataFrame:
    """Windows whose share of errors passes a limit, in the alert shape."""
    share = F.col("errors") / F.col("entries")
    return counts.where(share > rate).select(
        F.lit("High error rate").alias("title"),
        F.when(F.col("security_issues") > 0, "critical").otherwise("warning").alias("severity"),
        "start",
        F.format_string("%d of %d entries are errors", "errors", "entries").alias("message"),
    )


def start_triage(lines: DataFrame, path: str, checkpoint: str, once: bool = False):
    """Append triaged entries to a Parquet table; restarts resume from the checkpoint."""
    writer = triage(lines).writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)
