"""A few registered queries next to their SQL on the smallest tables, in a plain session's terms."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_queries import TABLES, rows_of

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
CHOSEN = ["RS5_general_security", "W5_cognitive", "G14_log_summary", "J1_F3_vulnerable", "J7_D4_baseline_compare", "W10_request_counts", "D3_duplicate_blocks"]


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 140


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", CHOSEN)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = rows_of(entry.queries()[name](spark, SF).toArrow())
    want = rows_of(con.execute(entry.oracle_sql()[name]).to_arrow_table())
    assert got == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_entry_has_a_stable_schema(spark):
    assert entry.entry(spark).columns == ["rule", "severity", "findings", "files"]


def test_hot_file_keeps_every_finding(spark):
    """One file holding most hits: same findings as brute force, none dropped."""
    from lintlake.operators.scan import dedup_findings, scan_rules
    from lintlake.rules import security

    hot = "password = 'abcdef' " * 3000
    rows = [("p", "hot.py", "python", hot)] + [("p", f"f{i}.py", "python", "token = 'abcdefghij'") for i in range(50)]
    files = spark.createDataFrame(rows, "project string, path string, language string, text string")
    found = dedup_findings(scan_rules(files, security.CREDENTIALS))
    counts = {r.path: r["count"] for r in found.groupBy("path").count().collect()}
    assert counts["hot.py"] == 3000 and sum(counts.values()) == 3050
    columns = sorted(r.column for r in found.where("path = 'hot.py'").select("column").collect())
    assert columns == [1 + 20 * i for i in range(3000)]
