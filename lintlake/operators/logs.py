"""Log lines: format, parse, classes, events and summaries, batch or stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.functions.text import col_of, computed_once, has_match, java_regex

_STAMP = r"\d{4}-\d{2}-\d{2}[T\s]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?"
# Line patterns by format, in order of detection.
BRACKETED = rf"^\[({_STAMP})\]\s*\[(\w+)\]\s*(.*)$"
PLAIN = rf"^({_STAMP})\s+(\w+)\s+(.*)$"
WORD_FIRST = r"^(\w+)\s+(\d{1,2},?\s+\d{4}\s+\d{2}:\d{2}:\d{2}(?:\.\d+)?)\s+(.*)$"
NPM = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d+Z\s+(\w+)\s+(.*)$"
PYTHON = r"^(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}(?:,\d+)?)\s*-\s*(\w+)\s*-\s*(.*)$"
JAVA = r"^(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}(?:\.\d+)?)\s+\[(\w+)\]\s+(.*)$"
SYSLOG = r"^(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+(\S+):\s*(.*)$"
APACHE = r"^(\S+)\s+(\S+)\s+(\S+)\s+\[([^\]]+)\]\s+\"([^\"]+)\"\s+(\d+)\s+(\d+)"
JSON = r"^\s*\{.*\"level\".*\"message\".*\}\s*$"
FORMATS = {
    "generic": [BRACKETED, PLAIN, WORD_FIRST], "npm": [NPM], "python": [PYTHON], "java": [JAVA],
    "syslog": [SYSLOG], "apache": [APACHE],
}
LEVELS = ["ERROR", "WARN", "WARNING", "INFO", "DEBUG", "TRACE"]
# Event name -> pattern, ignoring case.
SECURITY_EVENTS = {
    "Failed Login": r"failed\s+(login|authentication)|invalid\s+(password|credentials)|unauthorized",
    "SQL Injection": r"sql\s+injection|union\s+select|drop\s+table|;\s*--",
    "XSS Attempt": r"<script|javascript:|onerror\s*=|onload\s*=",
    "Path Traversal": r"\.\./|\.\.\\|%2e%2e%2f|%2e%2e/",
    "Command Injection": r";\s*(cat|ls|pwd|whoami|id|uname)|`[^`]+`|\$\([^)]+\)",
    "Access Denied": r"access\s+(denied|forbidden)|permission\s+denied|403",
    "Rate Limit": r"rate\s+limit|too\s+many\s+requests|429",
    "Suspicious IP": r"blocked\s+ip|blacklist|suspicious\s+activity",
}
PERFORMANCE_EVENTS = {
    "Slow Query": r"slow\s+query|query\s+took|execution\s+time.*\d{4,}",
    "Timeout": r"timeout|timed?\s*out|connection\s+reset",
    "Memory Issue": r"out\s+of\s+memory|memory\s+exhausted|heap\s+overflow",
    "Connection Pool": r"connection\s+pool|pool\s+exhausted|no\s+available\s+connections",
    "High Load": r"high\s+load|cpu\s+spike|resource\s+contention",
    "Disk Space": r"disk\s+full|no\s+space\s+left|storage\s+exhausted",
}
ERROR_CLASSES = {
    "SYNTAX": ("Syntax Error", r"syntax\s+error|parse\s+error|unexpected\s+token"),
    "RUNTIME": ("Runtime Error", r"runtime\s+error|exception|crash|fatal"),
    "NETWORK": ("Network Error", r"network\s+error|connection\s+(refused|failed|lost)|ECONN"),
    "DATABASE": ("Database Error", r"database\s+error|sql\s+error|query\s+failed|deadlock"),
    "FILESYSTEM": ("Filesystem Error", r"file\s+not\s+found|ENOENT|EACCES|permission\s+denied"),
    "CONFIGURATION": ("Configuration Error", r"config\s+error|invalid\s+config|missing\s+config"),
    "DEPENDENCY": ("Dependency Error", r"module\s+not\s+found|cannot\s+find\s+module|import\s+error"),
}


def log_file_lines(files: DataFrame, max_lines: int | None = None) -> DataFrame:
    """``files(path, text)`` to non-blank lines, numbered among themselves.

    ``max_lines`` is the caller's own option; the default reads whole files.
    Further columns of ``files`` go with each line.
    """
    lines = F.filter(F.split("text", "\n", -1), lambda x: ~x.rlike(r"\A\s*\z"))
    if max_lines is not None:
        lines = F.slice(lines, 1, max_lines)
    rest = [c for c in files.columns if c not in ("path", "text")]
    return files.select("path", *rest, F.posexplode(lines).alias("_at", "raw")).select(
        "path", (F.col("_at") + 1).alias("line"), "raw", *rest
    )


def is_log_path(path) -> Column:
    name = F.element_at(F.split(col_of(path), "/"), -1)
    return F.contains(name, F.lit("log"))


def detect_format(text) -> Column:
    """Format of a whole log text: JSON by its first line, else by any line."""
    t = col_of(text)
    first = F.split(F.regexp_replace(t, r"\A\s+", ""), "\n", 2)[0]
    result = F.when(has_match(first, JSON), "json")
    for name, patterns in FORMATS.items():
        for pattern in patterns:
            result = result.when(has_match(t, pattern, "m"), name)
    return result.otherwise("unknown")


def detect_line_format(raw) -> Column:
    """The same for one line on its own, as a stream sees it."""
    result = F.when(has_match(raw, JSON), "json")
    for name, patterns in FORMATS.items():
        for pattern in patterns:
            result = result.when(has_match(raw, pattern), name)
    return result.otherwise("unknown")


def detect_file_formats(lines: DataFrame) -> DataFrame:
    """``lines(path, line, raw)`` to one format per path.

    Flags and a minimum are combined before the shuffle, so a path may hold
    any share of the lines.
    """
    flags = [
        F.max(F.coalesce(sum((has_match("raw", p).cast("int") for p in ps), F.lit(0)) > 0, F.lit(False))).alias(f"_{n}")
        for n, ps in FORMATS.items()
    ]
    seen = lines.groupBy("path").agg(
        F.min_by(has_match("raw", JSON), "line").alias("_json_first"), *flags
    )
    result = F.when(F.col("_json_first"), "json")
    for name in FORMATS:
        result = result.when(F.col(f"_{name}"), name)
    return seen.select("path", result.otherwise("unknown").alias("format"))


def _group(pattern: str, n: int) -> Column:
    return F.regexp_extract("raw", java_regex(pattern), n)


def _entry(stamp, level, message, metadata=None) -> Column:
    nothing = F.lit(None).cast("map<string,string>")
    return F.struct(
        stamp.cast("string").alias("timestamp"),
        level.cast("string").alias("level"),
        message.cast("string").alias("message"),
        (nothing if metadata is None else metadata).alias("metadata"),
    )


def parse_lines(lines: DataFrame) -> DataFrame:
    """``lines(path, line, raw, format)`` to entries.

    ``parsed`` is false only for lines of a JSON file that are not JSON. Each
    format has its own fields; lines that do not fit it keep their raw text as
    the message.
    """
    document = F.from_json("raw", "map<string,string>", {"mode": "PERMISSIVE"})
    nothing = F.lit(None)

    def first_of(*names):
        return F.coalesce(*[F.nullif(F.col("_json")[n], F.lit("")) for n in names])

    def fields(pattern, stamp, level, message):
        return F.when(
            has_match("raw", pattern),
            _entry(_group(pattern, stamp), F.upper(_group(pattern, level)), _group(pattern, message)),
        )

    generic = F.coalesce(fields(BRACKETED, 1, 2, 3), fields(PLAIN, 1, 2, 3), fields(WORD_FIRST, 2, 1, 3))
    syslog = F.when(
        has_match("raw", SYSLOG),
        _entry(
            _group(SYSLOG, 1), nothing, _group(SYSLOG, 4),
            F.create_map(F.lit("host"), _group(SYSLOG, 2), F.lit("process"), _group(SYSLOG, 3)),
        ),
    )
    apache = F.when(
        has_match("raw", APACHE),
        _entry(
            _group(APACHE, 4), nothing, _group(APACHE, 5),
            F.create_map(
                F.lit("client"), _group(APACHE, 1), F.lit("status"), _group(APACHE, 6), F.lit("bytes"), _group(APACHE, 7)
            ),
        ),
    )
    from_json = F.when(
        F.col("_json").isNotNull(),
        _entry(
            first_of("timestamp", "time", "date"),
            first_of("level", "severity", "loglevel"),
            first_of("message", "msg", "text"),
            F.map_filter("_json", lambda k, v: ~k.isin("timestamp", "level", "message")),
        ),
    )
    by_format = (
        F.when(F.col("format") == "json", from_json)
        .when(F.col("format") == "python", F.coalesce(fields(PYTHON, 1, 2, 3), generic))
        .when(F.col("format") == "java", F.coalesce(fields(JAVA, 1, 2, 3), generic))
        .when(F.col("format") == "syslog", F.coalesce(syslog, generic))
        .when(F.col("format") == "apache", F.coalesce(apache, generic))
        .otherwise(generic)
    )
    carried = [c for c in lines.columns]
    read = lines.withColumn("_json", F.when(F.col("format") == "json", document))
    entries = read.withColumn(
        "_entry",
        F.when((F.col("format") == "json") & F.col("_json").isNull(), F.lit(None)).otherwise(
            F.coalesce(by_format, _entry(nothing, nothing, F.col("raw")))
        ),
    )
    # Later filters on level or time must not repeat the parse.
    return computed_once(
        entries,
        carried,
        [
            F.col("_entry").isNotNull().alias("parsed"),
            *[F.col("_entry")[n].alias(n) for n in ("timestamp", "level", "message", "metadata")],
            F.try_to_timestamp(F.regexp_replace(F.col("_entry")["timestamp"], r"^(\d{4}-\d{2}-\d{2})T", "$1 ")).alias("ts"),
        ],
    )


def level_class(level) -> Column:
    """error / warn / info / debug, null for other or missing levels."""
    c = F.upper(col_of(level))

    def has(*words):
        test = F.contains(c, F.lit(words[0]))
        for word in words[1:]:
            test = test | F.contains(c, F.lit(word))
        return test

    return (
        F.when(has("ERROR", "FATAL", "CRITICAL"), "error")
        .when(has("WARN"), "warn")
        .when(has("INFO"), "info")
        .when(has("DEBUG", "TRACE"), "debug")
    )


def matching_events(message, patterns: dict) -> Column:
    """Names of all events whose pattern the message holds."""
    return F.array_compact(F.array(*[F.when(has_match(message, p, "i"), n) for n, p in patterns.items()]))


def error_class(message) -> Column:
    result = None
    for code, (_, pattern) in ERROR_CLASSES.items():
        test = has_match(message, pattern, "i")
        result = F.when(test, code) if result is None else result.when(test, code)
    return result.otherwise("UNKNOWN")


def classify(entries: DataFrame) -> DataFrame:
    """Level class, events and error class of parsed entries; unparsed ones drop out."""
    text = F.coalesce(F.nullif("message", F.lit("")), "raw")
    upper = F.upper("level")
    is_error = F.contains(upper, F.lit("ERROR")) | F.contains(upper, F.lit("FATAL"))
    return (
        entries.where("parsed")
        .withColumn("_text", text)
        .withColumn("level_class", level_class("level"))
        .withColumn("security", matching_events("_text", SECURITY_EVENTS))
        .withColumn("performance", matching_events("_text", PERFORMANCE_EVENTS))
        .withColumn("error_class", F.when(is_error, error_class("_text")))
        .drop("_text")
    )


def events_found(entries: DataFrame) -> DataFrame:
    """One row per (line, event): type, name, severity."""
    found = F.concat(
        F.transform("security", lambda n: F.struct(F.lit("security").alias("type"), n.alias("name"), F.lit("error").alias("severity"))),
        F.transform("performance", lambda n: F.struct(F.lit("performance").alias("type"), n.alias("name"), F.lit("warning").alias("severity"))),
    )
    return classify(entries).select("path", "line", "timestamp", F.explode(found).alias("_e")).select(
        "path", "line", "timestamp", "_e.type", "_e.name", "_e.severity"
    )


def filter_entries(entries: DataFrame, start=None, end=None, levels=None) -> DataFrame:
    """Entries in [start, end] and of the given levels; each bound is optional."""
    if start is not None:
        entries = entries.where(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end is not None:
        entries = entries.where(F.col("ts") <= F.lit(end).cast("timestamp"))
    if levels:
        entries = entries.where(F.upper("level").isin(*[x.upper() for x in levels]))
    return entries


def _summary_columns() -> list[Column]:
    """Aggregates over entries classified without dropping unparsed lines."""
    is_level = lambda name: F.count_if(F.col("level_class") == name)
    return [
        F.count("*").alias("total_lines"),
        F.count_if("parsed").alias("parsed_lines"),
        is_level("error").alias("errors"),
        is_level("warn").alias("warnings"),
        is_level("info").alias("infos"),
        is_level("debug").alias("debugs"),
        F.count_if(F.size("security") > 0).alias("security_issues"),
        F.count_if(F.size("performance") > 0).alias("performance_issues"),
        F.lit(0).cast("bigint").alias("error_issues"),
        F.count_if(F.col("error_class").isNotNull()).alias("error_entries"),
    ]


def summarize(entries: DataFrame) -> DataFrame:
    """Per-file and, in the row without a path, directory totals, in one pass."""
    text = F.coalesce(F.nullif("message", F.lit("")), "raw")
    upper = F.upper("level")
    is_error = F.contains(upper, F.lit("ERROR")) | F.contains(upper, F.lit("FATAL"))
    facts = entries.select(
        "path",
        "parsed",
        F.when(F.col("parsed"), level_class("level")).alias("level_class"),
        F.when(F.col("parsed"), matching_events(text, SECURITY_EVENTS)).alias("security"),
        F.when(F.col("parsed"), matching_events(text, PERFORMANCE_EVENTS)).alias("performance"),
        F.when(F.col("parsed") & is_error, F.lit(1)).alias("error_class"),
    )
    rolled = facts.rollup("path").agg(*_summary_columns(), F.grouping("path").alias("_total"))
    return rolled.select(
        F.when(F.col("_total") == 1, "*").otherwise(F.col("path")).alias("path"),
        *[c for c in rolled.columns if c not in ("path", "_total")],
        (F.col("security_issues") + F.col("performance_issues")).alias("total_issues"),
        (F.col("parsed_lines") / F.col("total_lines")).alias("parse_rate"),
    )


def recommendations(summary: DataFrame) -> DataFrame:
    """Advice rows from summary rows."""

    def item(test, priority, category, text):
        return F.when(
            test, F.struct(F.lit(priority).alias("priority"), F.lit(category).alias("category"), text.alias("description"))
        )

    def counted(template, column):
        head, tail = template.split("{n}")
        return F.concat(F.lit(head), F.col(column).cast("string"), F.lit(tail))

    items = F.array_compact(
        F.array(
            item(F.col("errors") > 0, "high", "errors",
                 counted("Found {n} error entries. Review and address critical errors.", "errors")),
            item(F.col("security_issues") > 0, "critical", "security",
                 counted("Found {n} security-related log entries. Investigate immediately.", "security_issues")),
            item(F.col("performance_issues") > 0, "medium", "performance",
                 counted("Found {n} performance-related log entries. Consider optimization.", "performance_issues")),
            item(F.col("parse_rate") < 0.5, "low", "format",
                 F.lit("Low log parse rate. Consider using a standardized log format.")),
        )
    )
    return summary.select("path", F.explode(items).alias("_i")).select(
        "path", "_i.priority", "_i.category", "_i.description"
    )


def with_formats(lines: DataFrame) -> DataFrame:
    """Each line with the format of its file."""
    return lines.join(detect_file_formats(lines), "path")
