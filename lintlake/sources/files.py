"""Files, logs and snapshots from storage as tables.

Readers take any path Spark can list. Small files pay per file; pack a tree
into Parquet once (:func:`pack`) and scan the table after that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.functions.language import detect_language, detect_scanner_language, is_code_file
from lintlake.functions.text import content_hash
from lintlake.operators.logs import is_log_path

# Endings of a project scan, and folders left out of scans.
PROJECT_EXTENSIONS = [
    "js", "jsx", "ts", "tsx", "mts", "cts", "py", "java", "go", "rs", "php", "rb", "sh", "bash", "zsh",
    "json", "toml", "xml", "yaml", "yml", "c", "h", "cpp", "cc", "cxx", "hpp", "hh", "cs", "kt", "kts", "swift",
]
PROJECT_IGNORED = ["node_modules", ".git", "dist", "build", ".venv", "venv"]
CORPUS_IGNORED = [
    "node_modules", "venv", ".venv", "dist", "build", ".git", "__pycache__", "target", "out", ".egg-info",
]


#: Tasks a core gets at least, and tasks a split of the input is dealt to.
TASKS_A_CORE, TASKS_A_SPLIT = 3, 6


def spread(table: DataFrame, *keys: str) -> DataFrame:
    """Rows of an input over all cores, in tasks whose size does not grow with it.

    Rules cost far more per byte than reading does, and a file whose rows lie in
    one row group is read by one task, however many splits it has. So rows are
    dealt by key once, before any text is derived, to several tasks a core and a
    split. Meant for tables as read: counting partitions must not start a job.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(max(TASKS_A_CORE * cores, TASKS_A_SPLIT * table.rdd.getNumPartitions()), *keys)


def _relative(root: str):
    """Path below the root; Spark reports it as a URI with its scheme."""
    base = root.rstrip("/").split("://", 1)[-1]
    base = base[5:] if base.startswith("file:") else base
    plain = F.regexp_replace(F.url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B"))), "^[a-z0-9]+:/*", "/")
    return F.regexp_replace(F.split_part(plain, F.lit(base), F.lit(-1)), "^/+", "")


def _has_folder(path, names):
    folders = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    return F.arrays_overlap(folders, F.array(*[F.lit(n) for n in names]))


def read_tree(spark: SparkSession, root: str, extensions=None, ignored=(), project: str | None = None) -> DataFrame:
    """``files(project, path, language, text, size, content_hash)`` of a tree.

    Endings and folders are tested on the listing, before contents are read.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if extensions:
        reader = reader.option("pathGlobFilter", "*.{" + ",".join(e.lstrip(".") for e in extensions) + "}")
    listed = reader.load(root).withColumn("_path", _relative(root))
    if ignored:
        listed = listed.where(~_has_folder(F.col("_path"), list(ignored)))
    text = F.try_validate_utf8(F.col("content").cast("string"))
    text = F.coalesce(text, F.make_valid_utf8(F.col("content").cast("string")))
    return listed.select(
        F.lit(project or root.rstrip("/").rsplit("/", 1)[-1]).alias("project"),
        F.col("_path").alias("path"),
        detect_language("_path").alias("language"),
        text.alias("text"),
        F.col("length").alias("size"),
        F.md5("content").alias("content_hash"),
    )


def directory_files(spark, root, extensions=None, ignored=PROJECT_IGNORED, max_files: int | None = None) -> DataFrame:
    """Files of known languages; ``max_files`` keeps the first ones by path."""
    files = read_tree(spark, root, extensions, ignored).where(F.col("language") != "unknown")
    return files.orderBy("path").limit(max_files) if max_files else files


def project_files(spark, root, max_files: int | None = None) -> DataFrame:
    files = read_tree(spark, root, PROJECT_EXTENSIONS, PROJECT_IGNORED)
    return files.orderBy("path").limit(max_files) if max_files else files


def corpus_files(spark, root, ignored=CORPUS_IGNORED) -> DataFrame:
    """Code files of a corpus scan with the scanner's language names."""
    files = read_tree(spark, root, None, ignored).where(is_code_file("path"))
    return files.withColumn("language", detect_scanner_language("path"))


def listed_files(spark, root: str, paths: DataFrame) -> DataFrame:
    """The asked ``paths(path)`` below a root; a missing one gives an ``error`` row."""
    found = read_tree(spark, root)
    return paths.select("path").join(found, "path", "left").withColumn(
        "error", F.when(F.col("project").isNull(), F.concat(F.lit("File not found: "), "path"))
    )


def snippet_files(spark, snippets) -> DataFrame:
    """Inline ``(id, language, code)`` rows as files."""
    rows = spark.createDataFrame(snippets, "path string, language string, text string")
    return rows.select(F.lit("inline").alias("project"), "path", "language", "text")


def log_files(spark, root: str) -> DataFrame:
    """``files(path, text)`` of a log folder: names with ``log`` in them."""
    return read_tree(spark, root).where(is_log_path("path")).select("path", "text")


def manifest_tree(spark, root: str) -> DataFrame:
    """Manifests of a tree, one project per folder."""
    from lintlake.sources.manifests import MANIFEST_NAMES

    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    found = reader.option("pathGlobFilter", "{" + ",".join(MANIFEST_NAMES) + "}").load(root).withColumn("_path", _relative(root))
    return found.select(
        F.regexp_replace("_path", "/?[^/]+$", "").alias("project"),
        F.col("_path").alias("path"),
        F.col("content").cast("string").alias("text"),
    )


def pack(files: DataFrame, path: str) -> None:
    """A tree as one Parquet table, for scans without per-file cost."""
    packed = files if "content_hash" in files.columns else files.withColumn("content_hash", content_hash("text"))
    packed.write.mode("overwrite").parquet(path)


SNAPSHOT = (
    "timestamp string, findings array<struct<rule_id:string,file:string,line:int,column:int,severity:string,"
    "category:string,message:string>>"
)


def finding_snapshots(spark, path: str) -> DataFrame:
    """Findings of all JSON snapshots, objects or arrays of objects, tagged by file."""
    rows = spark.read.schema(SNAPSHOT).option("multiLine", True).json(path).select(
        F.regexp_extract("_metadata.file_name", "([^/]+)$", 1).alias("source_file"),
        F.try_to_timestamp("timestamp").alias("timestamp"),
        F.explode_outer("findings").alias("_f"),
    )
    return rows.select("source_file", "timestamp", "_f.*")


def read_baseline(spark, path: str, name: str | None = None) -> DataFrame:
    """One baseline, or all; the partition column prunes the read."""
    rows = spark.read.parquet(path)
    return rows.where(F.col("baseline_name") == name) if name else rows


def list_baselines(spark, path: str) -> DataFrame:
    """Names with date and size, newest first."""
    return (
        spark.read.parquet(path).groupBy("baseline_name")
        .agg(F.max("created_at").alias("created_at"), F.count("*").alias("total_findings"))
        .orderBy(F.desc("created_at"), "baseline_name")
    )
