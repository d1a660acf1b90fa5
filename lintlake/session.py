"""Session settings the jobs rely on.

On a cluster the session already exists and is left alone apart from the
SQL options below; nothing here picks a machine-local folder for it.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Observation, SparkSession
from pyspark.sql import functions as F

SQL_OPTIONS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def local_session(app: str = "lintlake", cores: str = "8", memory: str = "12g") -> SparkSession:
    """Session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.files.maxPartitionBytes", "16m")
    )
    for key, value in SQL_OPTIONS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts: the cluster's own setting wins.

    A private folder is chosen only when the session names none and runs in
    local mode, which is the case in tests.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    if not configured:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="lintlake-checkpoint-", dir=os.environ.get("TMPDIR"))
    context.setCheckpointDir(configured)
    return configured


def cut_lineage(df):
    """Reliable checkpoint of a DataFrame in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class RoundTables:
    """Tables between the rounds of an iterative job, in the shared folder.

    A lost executor costs only its tasks, and :meth:`close` removes all but the result.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.written = 0

    def table(self, df, **counts):
        """The rows of ``df`` as a table; with ``counts`` (name to condition) also the numbers of rows that meet them, from the same pass."""
        self.written += 1
        path = f"{self.folder}/{self.written}"
        seen = Observation()
        if counts:
            df = df.observe(seen, *[F.count_if(test).alias(name) for name, test in counts.items()])
        df.write.parquet(path)
        rows = self.spark.read.schema(df.schema).parquet(path)
        return (rows, seen.get) if counts else rows

    def close(self, result=None):
        """Removes the tables; ``result`` is written beside them before, and returned."""
        kept = None
        if result is not None:
            path = f"{self.folder}-result"
            result.write.parquet(path)
            kept = self.spark.read.schema(result.schema).parquet(path)
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.folder)
        folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        return kept
