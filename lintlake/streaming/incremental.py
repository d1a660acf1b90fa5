"""Scan only what is new: snapshots stream in, hashes decide."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.functions.text import content_hash
from lintlake.operators.baseline import rows_of_keys
from lintlake.operators.scan import scan_rules
from lintlake.session import cut_lineage

SEEN = "path string, content_hash string, batch bigint"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table, or no rows before the first batch has written it."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return spark.read.parquet(path) if system.exists(folder) else spark.createDataFrame([], schema)


def scan_new(spark: SparkSession, files: DataFrame, rules, seen_path: str, findings_path: str, batch: int) -> None:
    """Scan files whose (path, hash) is not in the seen table, append findings, note them as seen.

    Both tables are partitioned by batch and written with partition overwrite,
    so a batch that is run again after a failure replaces its own rows; rows
    of the same batch do not count as seen.

    New paths and hashes are found once, without texts. Texts are read where
    they are; only files that a batch holds more than once are moved, to keep
    one of each.
    """
    seen = _read(spark, seen_path, SEEN).where(F.col("batch") != batch).select("path", "content_hash")
    names = files.select("path", content_hash("text").alias("content_hash")).groupBy("path", "content_hash").agg(F.count("*").alias("copies"))
    fresh = cut_lineage(names.join(seen, ["path", "content_hash"], "left_anti"))
    once = rows_of_keys(files, fresh.where("copies = 1").drop("copies"))
    repeated = rows_of_keys(files, fresh.where("copies > 1").drop("copies")).dropDuplicates(["path", "content_hash"])
    found = scan_rules(once.unionByName(repeated), rules).drop("rule_order", "number")
    for rows, path in ((found, findings_path), (fresh.select("path", "content_hash"), seen_path)):
        (
            rows.withColumn("batch", F.lit(batch).cast("bigint"))
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch").parquet(path)
        )


def start_incremental_scan(stream: DataFrame, rules, seen_path: str, findings_path: str, checkpoint: str):
    """``stream`` of files(project, path, language, text) into :func:`scan_new`."""
    rules = list(rules)

    def run(batch: DataFrame, number: int) -> None:
        scan_new(batch.sparkSession, batch, rules, seen_path, findings_path, number)

    return (
        stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
