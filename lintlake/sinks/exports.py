"""Finding exports: SARIF, Markdown, JSON, baselines, alerts, review comments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lintlake.functions.language import sarif_language
from lintlake.operators.report import sarif_level

SARIF_SCHEMA = "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/master/Schemata/sarif-schema-2.1.0.json"


def sarif_rules(findings: DataFrame) -> DataFrame:
    """Per rule, the text of its first finding by (file, line, column)."""
    first = F.min(F.struct("file", "line", "column", "message", "severity", "category")).alias("_f")
    return findings.groupBy("rule_id").agg(first).select(
        "rule_id", "_f.message", sarif_level("_f.severity").alias("level"), "_f.category"
    )


# What stands for a field that a finding lacks, and the text over a fix.
SARIF_DEFAULTS = {
    "rule_id": "unknown-rule", "severity": "WARNING", "message": "Static analysis finding", "file": "unknown", "line": 1, "column": 1, "confidence": 0.8, "category": "security",
    "documentation_url": "", "cwe": "", "owasp": "",
}
FIX_HEADLINE = "Apply this fix"


def _sarif_columns(findings: DataFrame) -> DataFrame:
    """Findings with all columns a log can show; those they lack are null."""
    wanted = {
        "run": "string", "rule_id": "string", "file": "string", "line": "int", "column": "int", "severity": "string", "category": "string", "message": "string", "confidence": "double",
        "timestamp": "string", "fix": "string", "code_snippet": "string", "documentation_url": "string", "cwe": "string", "owasp": "string", "tags": "array<string>",
    }
    held = {c.lower() for c in findings.columns}
    return findings.select(*[(F.col(c) if c in held else F.lit(None)).cast(t).alias(c) for c, t in wanted.items()])


def _or_default(name: str):
    return F.coalesce(name, F.lit(SARIF_DEFAULTS[name]))


def _sarif_result(created_at):
    """One result; a field that is null stays out of the JSON text."""
    text = lambda c: F.struct(c.alias("text"))
    region = F.struct(_or_default("line").alias("startLine"), _or_default("column").alias("startColumn"), F.when(F.col("code_snippet").isNotNull(), text(F.col("code_snippet"))).alias("snippet"))
    place = F.struct(F.struct(F.struct(_or_default("file").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    applied = F.array(F.struct(text(F.col("fix")).alias("description")))
    fixes = F.array(F.struct(text(F.lit(FIX_HEADLINE)).alias("description"), applied.alias("appliedFixes")))
    return F.struct(
        _or_default("rule_id").alias("ruleId"), sarif_level(_or_default("severity")).alias("level"), text(_or_default("message")).alias("message"), F.array(place).alias("locations"),
        F.struct(F.coalesce("timestamp", created_at).alias("timestamp"), _or_default("confidence").alias("confidence")).alias("properties"),
        F.when(F.col("fix").isNotNull(), fixes).alias("fixes"),
    )


def _sarif_rule():
    """One rule, from its first finding."""
    return F.struct(
        _or_default("rule_id").alias("id"), _or_default("rule_id").alias("name"), F.struct(_or_default("message").alias("text")).alias("shortDescription"),
        F.struct(_or_default("message").alias("text")).alias("fullDescription"), F.struct(sarif_level(_or_default("severity")).alias("level")).alias("defaultConfiguration"),
        _or_default("documentation_url").alias("helpUri"),
        F.struct(_or_default("category").alias("category"), _or_default("cwe").alias("cwe"), _or_default("owasp").alias("owasp"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags")).alias("properties"),
    )


#: Ranges of a run lie together up to so many full parts, and totals of so many ranges are sent to all tasks.
BLOCK_PARTS, KNOWN_RANGES = 16, 100_000


def sarif_documents(findings: DataFrame, files: DataFrame | None = None, max_bytes: int = 8_000_000, created_at: str | None = None, ranges: int = 256) -> DataFrame:
    """``(run, part, sarif)``: SARIF 2.1.0 logs, one per part of about ``max_bytes`` of results and artifacts.

    ``findings(run, rule_id, file, line, column, severity, category, message)``
    may also have confidence, timestamp, fix, code_snippet, documentation_url,
    cwe, owasp and tags. ``files(path, text)`` adds the files with findings as
    artifacts with their contents, each once a run. Findings without a time get
    ``created_at``, by default that of the job.

    Where a part ends comes from running totals of bytes on two levels: over a
    fixed number of ranges a run, then within each range. So a run of any size
    is cut by many tasks, only (run, range) totals meet in a join, and no
    document and no task holds more than ``max_bytes`` and one item. Parts end
    with a block of ranges, so findings are shuffled once, by block, as the
    columns that they have; a first pass adds up the ranges. JSON texts are
    made where they are used and shuffled nowhere.
    """
    at = F.lit(created_at) if created_at else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
    found = _sarif_columns(findings)
    order = ["file", "line", "column", "rule_id"]
    facts = [*order, "message", "severity", "category", "documentation_url", "cwe", "owasp", "tags"]
    items, json = found.withColumn("is_file", F.lit(False)), F.to_json(_sarif_result(at))
    if files is not None:
        named = found.select("run", "file").where("file is not null").distinct().join(files.select(F.col("path").alias("file"), "text"), "file")
        artifact = F.struct(F.struct(F.col("file").alias("uri")).alias("location"), F.struct(F.col("text")).alias("contents"), sarif_language("file").alias("sourceLanguage"))
        items = items.unionByName(named.withColumn("is_file", F.lit(True)), allowMissingColumns=True)
        json = F.when(F.col("is_file"), F.to_json(artifact)).otherwise(json)
    held = [c for c in items.columns if c != "run"]
    items = items.withColumns({"range": F.pmod(F.xxhash64(*order, "is_file"), F.lit(ranges)), "bytes": F.octet_length(json) + 1})
    totals = items.groupBy("run", "range").agg(F.sum("bytes").alias("held"))
    known = totals.limit(KNOWN_RANGES + 1).collect()
    few = len(known) <= KNOWN_RANGES
    if few:
        totals = items.sparkSession.createDataFrame(known, totals.schema)
    before = F.coalesce(F.sum("held").over(Window.partitionBy("run").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = totals.select(F.col("run").alias("_run"), F.col("range").alias("_range"), before.alias("start"))
    starts = starts.withColumn("block", F.floor(F.col("start") / (BLOCK_PARTS * max_bytes)).cast("int"))
    placed = items.join(F.broadcast(starts) if few else starts, F.col("run").eqNullSafe(F.col("_run")) & (F.col("range") == F.col("_range"))).drop("_run", "_range")
    inside = F.sum("bytes").over(Window.partitionBy("run", "block", "range").orderBy(*order, "is_file", *[c for c in held if c not in order]).rowsBetween(Window.unboundedPreceding, -1))
    parted = placed.repartition("run", "block").withColumn("inside", F.coalesce(inside, F.lit(0)))
    # A block counts one more, so that no part's number stands in two.
    parted = parted.withColumn("part", (F.floor((F.col("start") + F.col("inside")) / max_bytes) + F.col("block")).cast("int"))
    # A part lists a rule once however often it hits, with the text of its first finding there.
    of_rule = Window.partitionBy("run", "block", "part", "is_file", _or_default("rule_id")).orderBy(*facts)
    parted = parted.withColumn("is_first", ~F.col("is_file") & (F.row_number().over(of_rule) == 1)).withColumn("json", json)
    lists = [F.sort_array(F.collect_list(F.when(~F.col("is_file"), F.struct(*order, "json")))).alias("results"), F.sort_array(F.collect_list(F.when(F.col("is_first"), _sarif_rule()))).alias("rules")]
    if files is not None:
        lists.append(F.sort_array(F.collect_list(F.when(F.col("is_file"), F.struct(*order, "json")))).alias("artifacts"))
    documents = parted.groupBy("run", "block", "part").agg(*lists)
    texts = lambda c: F.array_join(F.transform(c, lambda x: x["json"]), ",")
    name = F.to_json(F.struct(F.concat_ws("/", "run", F.col("part").cast("string")).alias("id")))
    head = f'{{"$schema":"{SARIF_SCHEMA}","version":"2.1.0","runs":[{{"tool":{{"driver":{{"name":"lintlake","version":"1.0.0","rules":'
    text = F.concat(
        F.lit(head), F.to_json("rules"), F.lit('}},"automationDetails":'), name,
        F.lit(',"results":['), texts("results"), F.lit('],"artifacts":['), texts("artifacts") if files is not None else F.lit(""), F.lit("]}]}"),
    )
    return documents.select("run", "part", text.alias("sarif"))


#: What :func:`sarif_results` reads of a log.
_LOG = """runs array<struct<
 results:array<struct<ruleId:string, level:string, message:struct<text:string>,
  locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>, region:struct<startLine:int, startColumn:int, snippet:struct<text:string>>>>>,
  properties:struct<timestamp:string, confidence:double>, fixes:array<struct<appliedFixes:array<struct<description:struct<text:string>>>>>>>>>"""


def sarif_results(documents: DataFrame) -> DataFrame:
    """The results in logs ``(run, part, sarif)``, a row each."""
    runs = documents.select("run", "part", F.explode(F.from_json("sarif", _LOG).runs).alias("_run"))
    rows = runs.select("run", "part", F.explode("_run.results").alias("r"))
    place = F.col("r.locations")[0].physicalLocation
    return rows.select(
        "run", "part", F.col("r.ruleId").alias("rule_id"), F.col("r.level").alias("level"), F.col("r.message.text").alias("message"),
        place.artifactLocation.uri.alias("file"), place.region.startLine.alias("line"), place.region.startColumn.alias("column"), place.region.snippet.text.alias("snippet"),
        F.col("r.fixes")[0].appliedFixes[0].description.text.alias("fix"), F.col("r.properties.confidence").alias("confidence"), F.col("r.properties.timestamp").alias("timestamp"),
    )


def write_sarif(documents: DataFrame, path: str) -> None:
    """One text file per task under ``run=``/``part=`` folders."""
    documents.withColumnRenamed("sarif", "value").write.mode("overwrite").partitionBy("run", "part").text(path)


def save_baseline(findings: DataFrame, path: str, name: str, created_at: str) -> None:
    """Replaces only the partition of this baseline."""
    from lintlake.operators.baseline import unique_findings

    rows = unique_findings(findings).drop("copies").withColumn("created_at", F.lit(created_at).cast("timestamp"))
    (
        rows.withColumn("baseline_name", F.lit(name))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("baseline_name")
        .parquet(path)
    )


def delete_baseline(spark, path: str, name: str) -> None:
    """Removes the partition folder of a baseline with the file system of the path."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/baseline_name={name}")
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def comparison_markdown(compared: DataFrame, summary: DataFrame, shown: int = 20) -> DataFrame:
    """One Markdown text: the totals, and at most ``shown`` rows per section.

    Showing only the first rows is the report's own rule; the text is built
    from those few rows.
    """
    top = None
    for state in ("new", "fixed"):
        rows = compared.where(F.col("state") == state).orderBy("rule_id", "file", "line", "column").limit(shown)
        top = rows if top is None else top.unionByName(rows)
    item = F.concat(
        F.lit("### "), "rule_id", F.lit("\n- **文件**: `"), "file", F.lit(":"), F.col("line").cast("string"),
        F.lit("`\n- **严重性**: "), "severity",
        F.when(F.col("state") == "new", F.concat(F.lit("\n- **描述**: "), "message")).otherwise(""),
    )
    sections = top.groupBy().agg(
        *[
            F.array_join(
                F.transform(
                    F.sort_array(F.collect_list(F.when(F.col("state") == s, F.struct("rule_id", "file", "line", "column", item.alias("text"))))),
                    lambda x: x["text"],
                ),
                "\n",
            ).alias(s)
            for s in ("new", "fixed")
        ]
    )
    head = summary.select(
        F.concat(
            F.lit("# 基线对比报告\n\n## 摘要\n\n| 指标 | 数量 |\n|------|------|\n| 基线问题数 | "), F.col("baseline_total").cast("string"),
            F.lit(" |\n| 当前问题数 | "), F.col("current_total").cast("string"), F.lit(" |\n| 新增问题 | "),
            F.col("new_issues").cast("string"), F.lit(" |\n| 已修复 | "), F.col("fixed_issues").cast("string"),
            F.lit(" |\n| 持续存在 | "), F.col("persistent_issues").cast("string"),
            F.lit(" |\n\n## 趋势\n\n- 方向："), "direction", F.lit("\n- 变化："),
            F.format_string("%+.2f%%", "change_percent"), F.lit("\n- 绝对变化："), F.format_string("%+d", "change_absolute"),
        ).alias("head")
    )
    both = head.withColumn("_k", F.lit(1)).join(sections.withColumn("_k", F.lit(1)), "_k")
    title = lambda c, t: F.when(F.col(c) != "", F.concat(F.lit(f"\n\n## {t}\n\n"), c)).otherwise("")
    return both.select(F.concat("head", title("new", "新增问题"), title("fixed", "已修复问题")).alias("markdown"))


def supply_chain_markdown(report: DataFrame, shown: int = 20) -> DataFrame:
    """Totals of a supply-chain roll-up as Markdown, with the worst manifests listed."""
    totals = report.agg(
        F.sum("vulnerable_packages").alias("v"), F.sum("abandoned_packages").alias("a"), F.sum("typosquatting_risks").alias("t")
    ).withColumn("_k", F.lit(1))
    listed = (
        report.orderBy(F.desc("vulnerable_packages"), F.desc("abandoned_packages"), "manifest").limit(shown)
        .groupBy()
        .agg(
            F.array_join(
                F.transform(
                    F.sort_array(F.collect_list(F.struct(-F.col("vulnerable_packages"), -F.col("abandoned_packages"), "manifest", "ecosystem", "total_packages"))),
                    lambda x: F.concat(F.lit("## 文件："), x["manifest"], F.lit("\n- 生态系统："), x["ecosystem"], F.lit("\n- 总包数："), x["total_packages"].cast("string")),
                ),
                "\n\n",
            ).alias("files")
        )
        .withColumn("_k", F.lit(1))
    )
    return totals.join(listed, "_k").select(
        F.concat(
            F.lit("# 供应链安全扫描报告\n\n"), "files", F.lit("\n\n## 📊 总结\n- 🔴 漏洞包："), F.col("v").cast("string"),
            F.lit("\n- 🟡 废弃包："), F.col("a").cast("string"), F.lit("\n- 🟠 Typosquatting 风险："), F.col("t").cast("string"),
        ).alias("markdown")
    )


def json_rows(df: DataFrame) -> DataFrame:
    """Each row as one JSON text; a fixed schema has no cycles to guard against."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


ALERT_SEVERITY = {"error": "critical", "warning": "warning"}
ALERT_COLOR = {"critical": "danger", "warning": "warning", "info": "good"}


def alerts(findings: DataFrame) -> DataFrame:
    """Alert rows: title with mark, severity, place, text, fix and color."""
    severity = F.when(F.col("severity") == "error", "critical").when(F.col("severity") == "warning", "warning").otherwise("info")
    mark = F.when(severity == "critical", "🔴").when(severity == "warning", "🟡").otherwise("🔵")
    color = F.when(severity == "critical", "danger").when(severity == "warning", "warning").otherwise("good")
    return findings.select(
        F.concat(mark, F.lit(" "), "rule").alias("title"),
        severity.alias("severity"),
        F.concat("path", F.lit(":"), F.col("line").cast("string")).alias("place"),
        "message",
        F.coalesce("suggestion", F.lit("")).alias("fix_suggestion"),
        color.alias("color"),
    )


def review_comments(diagnostics: DataFrame) -> DataFrame:
    """``(path, position, body)`` with the suggestion appended where there is one."""
    body = F.when(
        F.col("suggestion").isNotNull(),
        F.concat("message", F.lit("\n\n💡 **建议**: "), "suggestion"),
    ).otherwise(F.col("message"))
    return diagnostics.select("path", F.col("line").alias("position"), body.alias("body"))
