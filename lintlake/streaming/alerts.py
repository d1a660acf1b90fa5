"""Alerts of a stream, once per window and rule, whatever restarts come between.

A batch first writes its alerts under ``alerts/batch=<id>`` and then its mark
under ``commits/batch=<id>``. Rows without a mark do not count: a batch that
was cut off between the two is written again, over what it left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.streaming.logs import error_rate_alerts

#: One alert per window and rule.
KEY = ["start", "title"]


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def _mark(path: str, batch_id: int) -> str:
    return f"{path}/commits/batch={batch_id}"


def mark_committed(spark: SparkSession, path: str, batch_id: int) -> None:
    spark.createDataFrame([(batch_id,)], "id bigint").coalesce(1).write.mode("overwrite").parquet(_mark(path, batch_id))


def committed_alerts(spark: SparkSession, path: str) -> DataFrame | None:
    """Alerts of all batches that have their mark; None before the first one."""
    if not _exists(spark, f"{path}/alerts") or not _exists(spark, f"{path}/commits"):
        return None
    marks = spark.read.schema("id bigint, batch bigint").parquet(f"{path}/commits").select("batch")
    rows = spark.read.option("basePath", f"{path}/alerts").parquet(f"{path}/alerts/batch=*")
    return rows.withColumn("batch", F.col("batch").cast("bigint")).join(marks, "batch", "left_semi")


def write_alerts(batch: DataFrame, batch_id: int, path: str) -> None:
    """The alerts of a micro-batch whose (window, rule) no earlier batch has reported.

    Earlier alerts are read for the days of this batch's windows only, which
    bounds the read by the watermark and not by the age of the stream. Of
    alerts that share a key the smallest row stays, so a repeated batch gives
    the same rows. A batch that has its mark is skipped.
    """
    spark = batch.sparkSession
    if _exists(spark, f"{_mark(path, batch_id)}/_SUCCESS"):
        return
    rest = [c for c in batch.columns if c not in KEY]
    rows = batch.groupBy(*KEY).agg(F.min(F.struct(*rest)).alias("_r")).select(*KEY, "_r.*").withColumn("day", F.to_date("start"))
    rows.persist()
    try:
        first, last = rows.agg(F.min("day"), F.max("day")).head()
        if first is not None:
            known = committed_alerts(spark, path)
            if known is not None:
                rows = rows.join(known.where(F.col("day").between(F.lit(first), F.lit(last))).select(*KEY), KEY, "left_anti")
            # A folder of its own, so static overwrite replaces all that a cut-off attempt has left.
            rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("day").parquet(f"{path}/alerts/batch={batch_id}")
        mark_committed(spark, path, batch_id)
    finally:
        rows.unpersist()


def start_alerts(counts: DataFrame, path: str, checkpoint: str, rate: float = 0.2, once: bool = False):
    """Error-rate alerts of windowed counts, written by :func:`write_alerts`; restarts resume from the checkpoint."""
    writer = (
        error_rate_alerts(counts, rate).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
        .foreachBatch(lambda batch, batch_id: write_alerts(batch, batch_id, path))
    )
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()
