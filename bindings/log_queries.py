"""Log operators over ``events`` written as log lines in seven formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.corpus import q, read
from lintlake.functions.text import sql_string
from lintlake.operators import logs as g
from lintlake.streaming import logs as stream

MESSAGES = [
    "request served", "failed login for admin", "union select probe", "<script>x</script> seen",
    "read ../etc/hosts", "arg ; cat /etc/shadow", "access denied", "rate limit hit", "blocked ip 10.0.0.9",
    "slow query found", "timeout after 30s", "out of memory", "connection pool empty", "high load on node",
    "disk full", "syntax error near line 3", "runtime error in worker", "connection refused by peer",
    "database error code 7", "file not found", "missing config key", "module not found", "fatal crash",
    "query took 2000 ms and timed out, 403", "execution time was 123456",
]
LEVELS = {"error": "ERROR", "click": "INFO", "view": "debug", "signup": "WARNING"}


def log_lines(spark, d):
    """One log line per event; the format is fixed per log file."""
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    kind = F.col("event_type")
    level = F.when(kind == "error", "ERROR").when(kind == "click", "INFO").when(kind == "view", "debug").when(kind == "signup", "WARNING").otherwise("FATAL")
    message = F.concat(
        F.expr(f"element_at(array({', '.join(map(sql_string, MESSAGES))}), cast(event_id % {len(MESSAGES)} as int) + 1)"),
        F.lit(" user="), F.col("user_id").cast("string"), F.lit(" value="), F.col("value").cast("string"),
    )
    f = F.col("user_id") % 7
    raw = (
        F.when(f == 0, F.concat(F.lit("["), stamp, F.lit("] ["), level, F.lit("] "), message))
        .when(f == 1, F.concat(stamp, F.lit(" "), level, F.lit(" "), message))
        .when(f == 2, F.concat(F.lit('{"timestamp":"'), stamp, F.lit('","level":"'), level, F.lit('","message":"'), message, F.lit('","user":"'), F.col("user_id").cast("string"), F.when(F.col("event_id") % 9 == 0, F.lit("")).otherwise(F.lit('"}'))))
        .when(f == 3, F.concat(stamp, F.lit(" - "), level, F.lit(" - "), message))
        .when(f == 4, F.concat(stamp, F.lit(" ["), level, F.lit("] "), message))
        .when(f == 5, F.concat(F.date_format("ts", "MMM dd HH:mm:ss"), F.lit(" host1 app[7]: "), message))
        .otherwise(message)
    )
    return read(spark, d, "events").select(
        F.concat(F.lit("logs/app-"), (F.col("user_id") % 21).cast("string"), F.lit(".log")).alias("path"),
        F.col("event_id").alias("line"),
        raw.alias("raw"),
    )


_msg = "[" + ",".join(q(x) for x in MESSAGES) + f"][event_id % {len(MESSAGES)} + 1] || ' user=' || CAST(user_id AS VARCHAR) || ' value=' || CAST(value AS VARCHAR)"
LINES_SQL = f"""lines AS MATERIALIZED (SELECT 'logs/app-' || CAST(user_id % 21 AS VARCHAR) || '.log' AS path, event_id AS line,
 CASE user_id % 7 WHEN 0 THEN '[' || stamp || '] [' || level || '] ' || msg WHEN 1 THEN stamp || ' ' || level || ' ' || msg
 WHEN 2 THEN '{{"timestamp":"' || stamp || '","level":"' || level || '","message":"' || msg || '","user":"' || CAST(user_id AS VARCHAR) || CASE WHEN event_id % 9 = 0 THEN '' ELSE '"}}' END
 WHEN 3 THEN stamp || ' - ' || level || ' - ' || msg WHEN 4 THEN stamp || ' [' || level || '] ' || msg
 WHEN 5 THEN strftime(ts, '%b %d %H:%M:%S') || ' host1 app[7]: ' || msg ELSE msg END AS raw
 FROM (SELECT *, strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'click' THEN 'INFO' WHEN 'view' THEN 'debug' WHEN 'signup' THEN 'WARNING' ELSE 'FATAL' END AS level, {_msg} AS msg FROM events))"""
_any = lambda ps: " OR ".join(f"regexp_matches(raw, {q(p)})" for p in ps)
FORMAT_SQL = f"""formats AS (SELECT path, CASE WHEN arg_min(regexp_matches(raw, {q(g.JSON)}), line) THEN 'json' {' '.join(f"WHEN bool_or({_any(ps)}) THEN '{n}'" for n, ps in g.FORMATS.items())} ELSE 'unknown' END AS format FROM lines GROUP BY path)"""
LINE_FORMAT_SQL = f"""CASE WHEN regexp_matches(raw, {q(g.JSON)}) THEN 'json' {' '.join(f"WHEN {_any(ps)} THEN '{n}'" for n, ps in g.FORMATS.items())} ELSE 'unknown' END"""


def _x(p, k):
    return f"regexp_extract(raw, {q(p)}, {k})"


def _pick(field):
    """CASE text for timestamp, level or message of a line."""
    k = {"timestamp": (1, 2, 1), "level": (2, 1, 2), "message": (3, 3, 3)}[field]
    up = (lambda s: f"upper({s})") if field == "level" else (lambda s: s)
    generic = f"WHEN regexp_matches(raw, {q(g.BRACKETED)}) THEN {up(_x(g.BRACKETED, k[0]))} WHEN regexp_matches(raw, {q(g.PLAIN)}) THEN {up(_x(g.PLAIN, k[0]))} WHEN regexp_matches(raw, {q(g.WORD_FIRST)}) THEN {up(_x(g.WORD_FIRST, k[1]))}"
    sys = {"timestamp": _x(g.SYSLOG, 1), "level": "NULL", "message": _x(g.SYSLOG, 4)}[field]
    apache = {"timestamp": _x(g.APACHE, 4), "level": "NULL", "message": _x(g.APACHE, 5)}[field]
    js = {"timestamp": "coalesce(j->>'timestamp', j->>'time', j->>'date')", "level": "coalesce(j->>'level', j->>'severity', j->>'loglevel')", "message": "coalesce(j->>'message', j->>'msg', j->>'text')"}[field]
    rest = "raw" if field == "message" else "NULL"
    return f"""CASE WHEN format = 'json' THEN {js} WHEN format = 'python' AND regexp_matches(raw, {q(g.PYTHON)}) THEN {up(_x(g.PYTHON, k[2]))}
 WHEN format = 'java' AND regexp_matches(raw, {q(g.JAVA)}) THEN {up(_x(g.JAVA, k[2]))} WHEN format = 'syslog' AND regexp_matches(raw, {q(g.SYSLOG)}) THEN {sys}
 WHEN format = 'apache' AND regexp_matches(raw, {q(g.APACHE)}) THEN {apache} {generic} ELSE {rest} END AS {field}"""


ENTRIES_SQL = f"""entries AS MATERIALIZED (SELECT path, line, raw, format, NOT (format = 'json' AND NOT json_valid(raw)) AS parsed, {_pick('timestamp')}, {_pick('level')}, {_pick('message')}
 FROM (SELECT *, CASE WHEN format = 'json' AND json_valid(raw) THEN CAST(raw AS JSON) END AS j FROM lines JOIN formats USING (path)))"""
LEVEL_SQL = "CASE WHEN regexp_matches(upper(level), 'ERROR|FATAL|CRITICAL') THEN 'error' WHEN contains(upper(level), 'WARN') THEN 'warn' WHEN contains(upper(level), 'INFO') THEN 'info' WHEN regexp_matches(upper(level), 'DEBUG|TRACE') THEN 'debug' END"
_text = "coalesce(nullif(message, ''), raw)"


def _event_list(patterns):
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({_text}, {q('(?i)' + p)}) THEN {q(n)} END" for n, p in patterns.items()) + "], lambda x: x IS NOT NULL)"


ERROR_SQL = "CASE " + " ".join(f"WHEN regexp_matches({_text}, {q('(?i)' + p)}) THEN '{c}'" for c, (_, p) in g.ERROR_CLASSES.items()) + " ELSE 'UNKNOWN' END"
CLASSES_SQL = f"""classified AS (SELECT *, {LEVEL_SQL} AS level_class, {_event_list(g.SECURITY_EVENTS)} AS security, {_event_list(g.PERFORMANCE_EVENTS)} AS performance,
 CASE WHEN regexp_matches(upper(level), 'ERROR|FATAL') THEN {ERROR_SQL} END AS error_class FROM entries WHERE parsed)"""
HEAD = f"WITH {LINES_SQL}, {FORMAT_SQL}, {ENTRIES_SQL}"


def entries(s, d):
    return g.parse_lines(g.with_formats(log_lines(s, d)))


def doc_logs(s, d):
    return read(s, d, "documents").select(F.concat(F.lit("logs/"), F.col("doc_id").cast("string")).alias("path"), "text")


SUMMARY_SQL = f"""summary AS (SELECT CASE WHEN grouping(path) = 1 THEN '*' ELSE path END AS path, count(*) AS total_lines, count(*) FILTER (WHERE parsed) AS parsed_lines,
 count(*) FILTER (WHERE level_class = 'error') AS errors, count(*) FILTER (WHERE level_class = 'warn') AS warnings, count(*) FILTER (WHERE level_class = 'info') AS infos, count(*) FILTER (WHERE level_class = 'debug') AS debugs,
 count(*) FILTER (WHERE len(security) > 0) AS security_issues, count(*) FILTER (WHERE len(performance) > 0) AS performance_issues, CAST(0 AS BIGINT) AS error_issues, count(*) FILTER (WHERE error_class IS NOT NULL) AS error_entries,
 count(*) FILTER (WHERE len(security) > 0) + count(*) FILTER (WHERE len(performance) > 0) AS total_issues, count(*) FILTER (WHERE parsed) / count(*) AS parse_rate
 FROM (SELECT path, true AS parsed, level_class, security, performance, error_class FROM classified UNION ALL SELECT path, false, NULL, [], [], NULL FROM entries WHERE NOT parsed) GROUP BY ROLLUP (path))"""

QUERIES, ORACLES = {}, {}
QUERIES["SC6_log_file_lines"] = lambda s, d: g.log_file_lines(doc_logs(s, d))
ORACLES["SC6_log_file_lines"] = """WITH l AS (SELECT 'logs/' || CAST(doc_id AS VARCHAR) AS path, unnest(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '^\\s*$'))) AS raw,
 generate_subscripts(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '^\\s*$')), 1) AS line FROM documents) SELECT path, CAST(line AS INTEGER) AS line, raw FROM l"""
QUERIES["F11_file_formats"] = lambda s, d: g.detect_file_formats(log_lines(s, d))
ORACLES["F11_file_formats"] = f"WITH {LINES_SQL}, {FORMAT_SQL} SELECT * FROM formats"
QUERIES["F11_text_formats"] = lambda s, d: doc_logs(s, d).select("path", g.detect_format("text").alias("format"))
ORACLES["F11_text_formats"] = f"""SELECT 'logs/' || CAST(doc_id AS VARCHAR) AS path, CASE WHEN regexp_matches(string_split(regexp_replace(text, '^\\s+', ''), chr(10))[1], {q(g.JSON)}) THEN 'json'
 {' '.join(f"WHEN regexp_matches(text, {q('(?m)' + p)}) THEN '{n}'" for n, ps in g.FORMATS.items() for p in ps)} ELSE 'unknown' END AS format FROM documents"""
QUERIES["F12_parsed_lines"] = lambda s, d: entries(s, d).select(
    "path", "line", "format", "parsed", "timestamp", "level", "message", F.size(F.coalesce("metadata", F.create_map().cast("map<string,string>"))).alias("fields"))
ORACLES["F12_parsed_lines"] = HEAD + """ SELECT path, line, format, parsed, timestamp, level, message,
 CAST(CASE WHEN NOT parsed THEN 0 WHEN format = 'json' THEN 1 WHEN format = 'syslog' THEN 2 ELSE 0 END AS INTEGER) AS fields FROM entries"""
QUERIES["F10_level_classes"] = lambda s, d: entries(s, d).where("parsed").groupBy(g.level_class("level").alias("level_class")).agg(F.count("*").alias("entries"))
ORACLES["F10_level_classes"] = HEAD + f" SELECT {LEVEL_SQL} AS level_class, count(*) AS entries FROM entries WHERE parsed GROUP BY 1"
QUERIES["F13_error_classes"] = lambda s, d: g.classify(entries(s, d)).where("error_class IS NOT NULL").select("path", "line", "level", "error_class")
ORACLES["F13_error_classes"] = HEAD + f", {CLASSES_SQL} SELECT path, line, level, error_class FROM classified WHERE error_class IS NOT NULL"
QUERIES["RS28_log_events"] = lambda s, d: g.events_found(entries(s, d))
ORACLES["RS28_log_events"] = HEAD + f""", {CLASSES_SQL} SELECT path, line, timestamp, 'security' AS type, unnest(security) AS name, 'error' AS severity FROM classified
 UNION ALL SELECT path, line, timestamp, 'performance', unnest(performance), 'warning' FROM classified"""
QUERIES["P7_filtered_entries"] = lambda s, d: g.filter_entries(
    entries(s, d), "2024-01-05 00:00:00", "2024-01-20 12:00:00", ["error", "warning"]).select("path", "line", "timestamp", "level")
ORACLES["P7_filtered_entries"] = HEAD + """ SELECT path, line, timestamp, level FROM entries WHERE upper(level) IN ('ERROR', 'WARNING')
 AND TRY_CAST(timestamp AS TIMESTAMP) BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 12:00:00'"""
QUERIES["G14_log_summary"] = lambda s, d: g.summarize(entries(s, d)).withColumn("parse_rate", F.round("parse_rate", 6))
ORACLES["G14_log_summary"] = HEAD + f", {CLASSES_SQL}, {SUMMARY_SQL} SELECT * REPLACE (round(parse_rate, 6) AS parse_rate) FROM summary"
QUERIES["E4_F21_log_recommendations"] = lambda s, d: g.recommendations(g.summarize(entries(s, d)))
ORACLES["E4_F21_log_recommendations"] = HEAD + f""", {CLASSES_SQL}, {SUMMARY_SQL}
 SELECT path, 'high' AS priority, 'errors' AS category, 'Found ' || errors || ' error entries. Review and address critical errors.' AS description FROM summary WHERE errors > 0
 UNION ALL SELECT path, 'critical', 'security', 'Found ' || security_issues || ' security-related log entries. Investigate immediately.' FROM summary WHERE security_issues > 0
 UNION ALL SELECT path, 'medium', 'performance', 'Found ' || performance_issues || ' performance-related log entries. Consider optimization.' FROM summary WHERE performance_issues > 0
 UNION ALL SELECT path, 'low', 'format', 'Low log parse rate. Consider using a standardized log format.' FROM summary WHERE parse_rate < 0.5"""

_LINE_HEAD = f"WITH {LINES_SQL}, " + ENTRIES_SQL.replace("FROM lines JOIN formats USING (path)", f"FROM (SELECT *, {LINE_FORMAT_SQL} AS format FROM lines)") + f", {CLASSES_SQL}"
QUERIES["ST1_line_triage"] = lambda s, d: stream.triage(log_lines(s, d)).select("path", "line", "format", "level", "level_class", F.size("security").alias("security"), F.size("performance").alias("performance"), "error_class")
ORACLES["ST1_line_triage"] = _LINE_HEAD + " SELECT path, line, format, level, level_class, CAST(len(security) AS INTEGER) AS security, CAST(len(performance) AS INTEGER) AS performance, error_class FROM classified"
QUERIES["ST2_windowed_counts"] = lambda s, d: stream.windowed_counts(stream.triage(log_lines(s, d)), "1 hour").select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "entries", "errors", "warnings", "security_issues", "performance_issues")
ORACLES["ST2_windowed_counts"] = _LINE_HEAD + """ SELECT strftime(date_trunc('hour', TRY_CAST(timestamp AS TIMESTAMP)), '%Y-%m-%d %H:%M') AS start, count(*) AS entries, count(*) FILTER (WHERE level_class = 'error') AS errors, count(*) FILTER (WHERE level_class = 'warn') AS warnings,
 count(*) FILTER (WHERE len(security) > 0) AS security_issues, count(*) FILTER (WHERE len(performance) > 0) AS performance_issues FROM classified WHERE TRY_CAST(timestamp AS TIMESTAMP) IS NOT NULL GROUP BY 1"""
QUERIES["SK6_window_alerts"] = lambda s, d: stream.error_rate_alerts(stream.windowed_counts(stream.triage(log_lines(s, d)), "1 hour"), 0.2).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm"))
ORACLES["SK6_window_alerts"] = f"SELECT 'High error rate' AS title, CASE WHEN security_issues > 0 THEN 'critical' ELSE 'warning' END AS severity, start, errors || ' of ' || entries || ' entries are errors' AS message FROM ({ORACLES['ST2_windowed_counts']}) WHERE errors > entries * 0.2"
