"""Streams give what the batch forms give."""

import time
from collections import defaultdict, deque

from pyspark.sql import functions as F

from lintlake.rules import security
from lintlake.streaming import alerts as stream_alerts
from lintlake.streaming import incremental
from lintlake.streaming import logs as stream_logs
from lintlake.streaming.admission import admit_requests, admit_stream, decide
from lintlake.streaming.team import running_contributor_stats

LINES = [
    "[2024-01-01 10:00:00] [ERROR] failed login for a", "[2024-01-01 10:01:00] [INFO] fine", "2024-01-01 10:12:00 WARN slow query",
    '{"timestamp":"2024-01-01 10:13:00","level":"ERROR","message":"deadlock"}', "", "loose words",
]


def run(query):
    query.awaitTermination(120)
    assert query.exception() is None


def test_log_triage_stream_equals_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.log").write_text("\n".join(LINES[:3]))
    (folder / "b.log").write_text("\n".join(LINES[3:]))
    run(stream_logs.start_triage(stream_logs.read_log_stream(spark, str(folder)), str(tmp_path / "out"), str(tmp_path / "cp"), once=True))
    batch = stream_logs.triage(spark.createDataFrame([("x", 0, s) for s in LINES if s], "path string, line int, raw string"))
    pick = lambda df: sorted((r.raw, r.level_class or "", tuple(r.security), tuple(r.performance)) for r in df.collect())
    assert pick(spark.read.parquet(str(tmp_path / "out"))) == pick(batch)


def test_windowed_counts_and_alerts(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.log").write_text("\n".join(LINES))
    entries = stream_logs.triage(stream_logs.read_log_stream(spark, str(folder)))
    counts = stream_logs.windowed_counts(entries)
    query = counts.writeStream.format("memory").queryName("window_counts").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    run(query)
    batch = stream_logs.windowed_counts(stream_logs.triage(spark.createDataFrame([("x", 0, s) for s in LINES if s], "path string, line int, raw string")))
    assert sorted(map(tuple, spark.table("window_counts").collect())) == sorted(map(tuple, batch.collect()))
    alerts = stream_logs.error_rate_alerts(batch, 0.4).collect()
    assert sorted(a.severity for a in alerts) == ["critical", "warning"]


def test_incremental_scan_skips_seen_files_and_survives_replay(spark, tmp_path):
    seen, out = str(tmp_path / "seen"), str(tmp_path / "found")
    schema = "project string, path string, language string, text string"
    first = spark.createDataFrame([("p", "a.py", "python", "password = 'abcdef'"), ("p", "b.py", "python", "x")], schema)
    second = spark.createDataFrame([("p", "a.py", "python", "password = 'abcdef'"), ("p", "b.py", "python", "token = 'abcdefghij'")], schema)
    incremental.scan_new(spark, first, security.CREDENTIALS, seen, out, 0)
    incremental.scan_new(spark, second, security.CREDENTIALS, seen, out, 1)
    incremental.scan_new(spark, second, security.CREDENTIALS, seen, out, 1)
    rows = spark.read.parquet(out).select("path", "batch").collect()
    assert sorted(map(tuple, rows)) == [("a.py", 0), ("b.py", 1)]
    assert spark.read.parquet(seen).count() == 3


def test_changed_files_move_no_text(spark):
    """Few keys go to the texts; with no room for a broadcast both sides are joined, with equal rows."""
    from lintlake.operators import baseline

    before = spark.createDataFrame([(f"f{i}", f"text {i}") for i in range(50)], "path string, text string")
    after = spark.createDataFrame([(f"f{i}", f"text {i % 47}") for i in range(60)] + [("f55", "text 8")] * 2, "path string, text string")
    few, many = baseline.changed_files(before, after), baseline.changed_files(before, after, shared_keys=0)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect())) and few.count() == 15
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_incremental_scan_takes_repeated_files_once(spark, tmp_path):
    schema = "project string, path string, language string, text string"
    batch = spark.createDataFrame([("p", "a.py", "python", "password = 'abcdef'")] * 3 + [("p", "a.py", "python", "token = 'abcdefghij'"), ("p", "b.py", "python", "secret = 'abcdefghij'")], schema)
    incremental.scan_new(spark, batch, security.CREDENTIALS, str(tmp_path / "seen"), str(tmp_path / "found"), 0)
    assert sorted(r.path for r in spark.read.parquet(str(tmp_path / "found")).collect()) == ["a.py", "a.py", "b.py"]
    assert spark.read.parquet(str(tmp_path / "seen")).count() == 3


def test_incremental_stream(spark, tmp_path):
    schema = "project string, path string, language string, text string"
    src = str(tmp_path / "src")
    spark.createDataFrame([("p", "a.py", "python", "password = 'abcdef'")], schema).write.parquet(src)
    args = (security.CREDENTIALS, str(tmp_path / "seen"), str(tmp_path / "found"), str(tmp_path / "cp"))
    run(incremental.start_incremental_scan(spark.readStream.schema(schema).parquet(src), *args))
    spark.createDataFrame([("p", "a.py", "python", "password = 'abcdef'"), ("p", "c.py", "python", "secret = 'abcdefghij'")], schema).write.mode("append").parquet(src)
    run(incremental.start_incremental_scan(spark.readStream.schema(schema).parquet(src), *args))
    assert sorted(r.path for r in spark.read.parquet(str(tmp_path / "found")).collect()) == ["a.py", "c.py"]


def _brute(rows, limit, window):
    by_key, out = defaultdict(list), []
    for key, at in sorted(rows):
        by_key[key].append(at)
    for key, times in by_key.items():
        out += [(key, t, a, r) for t, (a, r) in zip(times, decide(times, deque(), limit, window * 1_000_000))]
    return sorted(out)


def _requests(spark, rows):
    return spark.createDataFrame(rows, "key string, us long").select("key", F.timestamp_micros("us").alias("ts"))


def _rows(n):
    return [(f"k{(i * 7) % 3}", 1_700_000_000_000_000 + (i * i * 137_001) % 400_000_000) for i in range(n)]


def test_admission_batch_against_brute_force(spark):
    rows = _rows(300)
    got = admit_requests(_requests(spark, rows), 3, 10).select("key", F.unix_micros("ts"), "allowed", "remaining").collect()
    assert sorted(map(tuple, got)) == _brute(rows, 3, 10)


def test_admission_rule():
    flags = [a for a, _ in decide([0, 1, 2, 10, 11], deque(), 2, 10)]
    assert flags == [True, True, False, True, True]


def test_admission_stream_equals_batch(spark, tmp_path):
    """Shuffled input in several batches, with rows that come late but inside the watermark."""
    first = 1_700_000_000_000_000
    rows = sorted(_rows(60), key=lambda r: r[1])
    # Neighbouring batches change some rows, so later batches hold times before the ones already seen.
    batches = [rows[:20] + rows[25:30], rows[20:25] + rows[30:45] + rows[50:52], rows[45:50] + rows[52:]]
    late = [[("late", first + 100_000_000)], [("late", first + 50_000_000)], []]
    end = first + 4_000_000_000
    src = str(tmp_path / "req")
    parts = [list(reversed(b + x)) for b, x in zip(batches, late)] + [[("end", end)], [("end", end + 600_000_000)]]
    for part in parts:
        _requests(spark, part).coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)  # files are taken in order of their time stamps
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    reader = spark.readStream.schema("key string, ts timestamp").option("maxFilesPerTrigger", 1)
    stream = admit_stream(reader.parquet(src), 1, 10, lateness="10 minutes")
    run(stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start(str(tmp_path / "out")))
    got = spark.read.parquet(str(tmp_path / "out")).select("key", F.unix_micros("ts"), "allowed", "remaining").where("key != 'end'").collect()
    assert sorted(map(tuple, got)) == _brute(rows + late[0] + late[1], 1, 10)


def test_running_contributors(spark, tmp_path):
    src = str(tmp_path / "commits")
    schema = "author string, commit_id long, ts timestamp, issues long"
    spark.sql("SELECT concat('a', id % 3) AS author, id AS commit_id, timestamp_seconds(id) AS ts, id % 5 AS issues FROM range(20)").write.parquet(src)
    stats = running_contributor_stats(spark.readStream.schema(schema).parquet(src))
    run(stats.writeStream.format("memory").queryName("contributors").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start())
    assert sorted(map(tuple, spark.table("contributors").collect())) == sorted(map(tuple, running_contributor_stats(spark.read.parquet(src)).collect()))


def _alert_rows(spark, out):
    return sorted((str(r.start), r.title, r.message) for r in stream_alerts.committed_alerts(spark, str(out)).collect())


def test_alerts_once_per_window_across_a_restart(spark, tmp_path, monkeypatch):
    """The stream is cut off between writing a batch and marking it; windows that stay over the rate alert once."""
    folder, out, checkpoint = tmp_path / "in", tmp_path / "out", str(tmp_path / "cp")
    folder.mkdir()
    line = "[2024-01-0{} {:02d}:{:02d}:00] [{}] m".format

    def start():
        entries = stream_logs.triage(stream_logs.read_log_stream(spark, str(folder)))
        return stream_alerts.start_alerts(stream_logs.windowed_counts(entries, "1 hour"), str(out), checkpoint, once=True)

    (folder / "a.log").write_text("\n".join([line(1, 10, 0, "ERROR"), line(1, 10, 1, "INFO"), line(1, 11, 0, "INFO"), line(2, 9, 0, "ERROR")]))

    def cut_off(*_):
        raise RuntimeError("cut off before the mark")

    with monkeypatch.context() as patch:
        patch.setattr(stream_alerts, "mark_committed", cut_off)
        query = start()
        while query.isActive:
            time.sleep(0.1)
        assert "cut off before the mark" in str(query.exception())
    assert (out / "alerts").exists() and stream_alerts.committed_alerts(spark, str(out)) is None
    run(start())
    first = [("2024-01-01 10:00:00", "High error rate", "1 of 2 entries are errors"), ("2024-01-02 09:00:00", "High error rate", "1 of 1 entries are errors")]
    assert _alert_rows(spark, out) == first
    # The window of the second day goes on failing, a new one joins it.
    (folder / "b.log").write_text("\n".join([line(2, 9, 5, "ERROR"), line(2, 10, 0, "ERROR")]))
    run(start())
    assert _alert_rows(spark, out) == [*first, ("2024-01-02 10:00:00", "High error rate", "1 of 1 entries are errors")]
    # The same batch again changes nothing, also when its mark is there already.
    again = spark.createDataFrame([("High error rate", "warning", first[0][0], "x")], "title string, severity string, start string, message string").withColumn("start", F.to_timestamp("start"))
    stream_alerts.write_alerts(again, 0, str(out))
    stream_alerts.write_alerts(again, 77, str(out))
    stream_alerts.write_alerts(again.limit(0), 78, str(out))
    assert len(_alert_rows(spark, out)) == 3
