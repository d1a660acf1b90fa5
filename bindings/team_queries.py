"""Contributor, vote, progress and request reports over ``orders``, ``lineitem``, ``part`` and ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.corpus import q, read
from lintlake.operators import team as t
from lintlake.streaming.admission import admit_requests

QUERIES, ORACLES = {}, {}


def add(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


def commits(s, d):
    return read(s, d, "orders").select(
        F.expr("concat('dev', cast(o_custkey % 200 as string))").alias("author"), F.col("o_orderkey").alias("commit_id"),
        F.col("o_orderdate").alias("ts"), F.expr("cast(o_totalprice as bigint) % 23").alias("issues"))


_COMMITS = "commits AS (SELECT 'dev' || (o_custkey % 200) AS author, o_orderkey AS commit_id, o_orderdate AS ts, CAST(trunc(o_totalprice) AS BIGINT) % 23 AS issues FROM orders)"
_STATS = f"WITH {_COMMITS}, stats AS (SELECT author, count(*) AS total_commits, CAST(sum(issues) AS BIGINT) AS total_issues, greatest(0, 100 - arg_max(issues, (ts, commit_id, issues)) * 5) AS quality_score FROM commits GROUP BY author)"
add("G25_contributor_stats", lambda s, d: t.contributor_stats(commits(s, d)), _STATS + " SELECT * FROM stats")
add("G26_team_overview", lambda s, d: t.team_overview(t.contributor_stats(commits(s, d))),
    _STATS + " SELECT count(*) AS total_members, round(avg(quality_score), 1) AS average_quality_score, CAST(sum(total_issues) AS BIGINT) AS total_issues FROM stats")
add("T5_top_contributors", lambda s, d: t.top_contributors(t.contributor_stats(commits(s, d))), _STATS + " SELECT * FROM stats ORDER BY quality_score DESC, author LIMIT 5")

_MODELS = ["gpt-4", "claude-3", "gemini-pro", "qwen2.5-coder:7b", "other"]


def suggestions(s, d):
    return read(s, d, "lineitem").select(
        F.col("l_orderkey").alias("issue_id"), F.expr("l_partkey * 1000 + l_suppkey * 10 + l_linenumber").alias("suggestion_id"),
        F.element_at(F.array(*map(F.lit, _MODELS)), (F.col("l_suppkey") % 5 + 1).cast("int")).alias("model"),
        (F.col("l_quantity") / 50).alias("confidence"),
        F.expr("slice(array('clear','short','safe','fast'), 1, cast(l_partkey % 4 + 1 as int))").alias("pros"),
        F.expr("slice(array('slow','vague','long'), 1, cast(l_suppkey % 3 + 1 as int))").alias("cons"),
        F.expr("cast(l_partkey % 90 as int)").alias("estimated_time"))


_W = "CASE model " + " ".join(f"WHEN {q(k)} THEN {v}::DOUBLE" for k, v in t.MODEL_WEIGHTS.items()) + " ELSE 1.0::DOUBLE END"
_SUG = f"""WITH sug AS (SELECT l_orderkey AS issue_id, l_partkey * 1000 + l_suppkey * 10 + l_linenumber AS suggestion_id, [{','.join(map(q, _MODELS))}][l_suppkey % 5 + 1] AS model, l_quantity / 50 AS confidence, l_partkey % 4 + 1 AS np, l_suppkey % 3 + 1 AS nc, l_partkey % 90 AS et FROM lineitem),
 scored AS (SELECT *, least(100.0::DOUBLE, (confidence * 50 + np * 5 - nc * 3 + CASE WHEN et < 30 THEN 10 WHEN et < 60 THEN 5 ELSE 0 END) * {_W}) AS score FROM sug)"""
add("T9_best_fix", lambda s, d: t.best_fix(suggestions(s, d)).withColumn("score", F.round("score", 6)),
    _SUG + " SELECT issue_id, suggestion_id, model, confidence, round(score, 6) AS score, n AS suggestions FROM (SELECT *, row_number() OVER (PARTITION BY issue_id ORDER BY score DESC, suggestion_id) AS k, count(*) OVER (PARTITION BY issue_id) AS n FROM scored) WHERE k = 1")
add("T9_fix_ranking", lambda s, d: t.fix_ranking(suggestions(s, d)).select("issue_id", "suggestion_id", "model", F.round("score", 6).alias("score"), "rank"),
    _SUG + " SELECT issue_id, suggestion_id, model, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY issue_id ORDER BY score DESC, suggestion_id) AS INTEGER) AS rank FROM scored")


def history(s, d):
    return suggestions(s, d).select("model", "confidence", (F.col("suggestion_id") % 4 != 0).alias("success"), (F.col("suggestion_id") % 3000).alias("latency_ms"))


add("G28_fix_history", lambda s, d: t.fix_history_stats(history(s, d)).select("total_requests", "successful_requests", "most_used_model", *[F.round(c, 6).alias(c) for c in ("average_confidence", "avg_time_ms", "success_rate")]),
    _SUG + """, h AS (SELECT model, confidence, suggestion_id % 4 <> 0 AS ok, suggestion_id % 3000 AS ms FROM sug) SELECT count(*) AS total_requests, count(*) FILTER (WHERE ok) AS successful_requests, (SELECT model FROM h WHERE ok GROUP BY model ORDER BY count(*) DESC, model LIMIT 1) AS most_used_model,
 round(avg(confidence) FILTER (WHERE ok), 6) AS average_confidence, round(sum(ms) / greatest(count(*) FILTER (WHERE ok), 1), 6) AS avg_time_ms, round(count(*) FILTER (WHERE ok) / count(*), 6) AS success_rate FROM h""")


def fixes(s, d):
    one = "named_struct('code', CASE WHEN l_partkey % 3 = 0 THEN '' ELSE 'x = 1' END, 'pros', CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE array('a') END, 'cons', array('b'))"
    return read(s, d, "lineitem").select(
        F.expr("l_orderkey * 10000000 + l_partkey * 100 + l_linenumber").alias("id"),
        F.expr(f"slice(array({one}, {one}), 1, cast(l_linenumber % 3 as int))").alias("fixes"),
        F.expr("CASE WHEN l_returnflag = 'R' THEN NULL ELSE 'first' END").alias("recommendation"), (F.col("l_extendedprice") / 10).alias("avg_time_ms"))


_Q = """(CASE WHEN n >= 2 THEN 2 WHEN n = 1 THEN 1 ELSE 0 END + CASE WHEN hc THEN 2 ELSE 0 END + CASE WHEN ha THEN 2 ELSE 0 END + CASE WHEN l_returnflag <> 'R' THEN 2 ELSE 0 END + CASE WHEN l_extendedprice / 10 < 5000 THEN 2 ELSE 0 END)"""
add("F17_fix_quality", lambda s, d: t.fix_quality(fixes(s, d)),
    f"SELECT id, CAST(sc AS INTEGER) AS score, CASE WHEN sc >= 8 THEN '优秀' WHEN sc >= 6 THEN '良好' WHEN sc >= 4 THEN '及格' ELSE '需改进' END AS quality, hc AS has_code, ha AS has_analysis FROM (SELECT *, {_Q} AS sc FROM (SELECT *, l_orderkey * 10000000 + l_partkey * 100 + l_linenumber AS id, l_linenumber % 3 AS n, l_linenumber % 3 > 0 AND l_partkey % 3 <> 0 AS hc, l_linenumber % 3 = 0 OR l_suppkey % 4 <> 0 AS ha FROM lineitem))")


def kpi(s, d):
    return read(s, d, "part").select(
        F.expr("concat('metric', cast(p_partkey as string))").alias("metric"), F.expr("cast(p_size % 5 as double)").alias("baseline"),
        F.expr("cast(p_partkey % 60 - 30 as double)").alias("current"),
        F.expr("CASE WHEN p_partkey % 2 = 0 THEN cast(-(p_partkey % 50) as double) ELSE cast(p_partkey % 50 as double) END").alias("target"),
        F.expr("CASE WHEN p_partkey % 2 = 0 THEN 'lower_better' ELSE 'higher_better' END").alias("direction"))


_KPI = """WITH k AS (SELECT 'metric' || p_partkey AS metric, CAST(p_size % 5 AS DOUBLE) AS baseline, CAST(p_partkey % 60 - 30 AS DOUBLE) AS current, CAST(CASE WHEN p_partkey % 2 = 0 THEN -(p_partkey % 50) ELSE p_partkey % 50 END AS DOUBLE) AS target, CASE WHEN p_partkey % 2 = 0 THEN 'lower_better' ELSE 'higher_better' END AS direction FROM part),
 p AS (SELECT *, CASE WHEN target = baseline THEN 100.0::DOUBLE WHEN direction = 'lower_better' THEN least(100.0::DOUBLE, (baseline - current) / (baseline - target) * 100) ELSE least(100.0::DOUBLE, (current - baseline) / (target - baseline) * 100) END AS progress FROM k)"""
add("G29_kpi_progress", lambda s, d: t.kpi_progress(kpi(s, d)).select("metric", F.round("progress", 6).alias("progress")), _KPI + " SELECT metric, round(progress, 6) AS progress FROM p")
add("G29_overall_progress", lambda s, d: t.overall_progress(t.kpi_progress(kpi(s, d))).select(F.round("overall_progress", 6).alias("overall_progress")), _KPI + " SELECT round(avg(progress), 6) AS overall_progress FROM p")


def requests(s, d):
    return read(s, d, "events").select(F.expr("concat('key', cast(user_id % 20 as string))").alias("key"), F.col("ts").cast("timestamp").alias("ts"), "event_id")


add("W10_request_counts", lambda s, d: t.request_counts(requests(s, d), 6, 3600).select("key", F.col("ts").cast("timestamp_ntz").alias("ts"), "requests_in_window", "remaining"),
    "WITH r AS (SELECT 'key' || (user_id % 20) AS key, ts FROM events), c AS (SELECT key, ts, count(*) OVER (PARTITION BY key ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS requests_in_window FROM r) SELECT key, ts, requests_in_window, greatest(0, 6 - requests_in_window) AS remaining FROM c")
# One request of each key a step; the list holds the admitted times of the last window.
_ADMITTED = """WITH RECURSIVE r AS (SELECT 'key' || (user_id % 20) AS key, ts, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id % 20 ORDER BY ts) AS k FROM events),
 w AS (SELECT key, ts, k, [us] AS held, true AS allowed, 5 AS remaining FROM r WHERE k = 1
  UNION ALL SELECT key, ts, k, CASE WHEN len(h) < 6 THEN list_append(h, us) ELSE h END, len(h) < 6, greatest(5 - len(h), 0) FROM (SELECT r.*, list_filter(w.held, lambda x: x > r.us - 3600000000) AS h FROM w JOIN r ON r.key = w.key AND r.k = w.k + 1))"""
add("ST4_admission", lambda s, d: admit_requests(requests(s, d), 6, 3600).select("key", F.col("ts").cast("timestamp_ntz").alias("ts"), "allowed", "remaining"),
    _ADMITTED + " SELECT key, ts, allowed, CAST(remaining AS INTEGER) AS remaining FROM w")
