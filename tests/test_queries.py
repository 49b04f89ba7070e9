"""Registered queries against their SQL on the smallest tables.

By default a spread of queries runs; SCRIBELAKE_ALL=1 runs every one
(``tools/check.py`` does the same on any folder).
"""

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from scribelake.plans import registered

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
from check import TABLES, table_of  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
SPREAD = (
    "A1_quality_by_source", "W1_timeline_audit", "W4_adjacent_identical", "P8_library_search", "W8_gap_groups", "J5_reusable_run",
    "J20_overlap_check", "M1_purge_plan", "R1_folder_watch", "R3_progress_state", "R4_stale_reject", "R3_progress_stream", "F16_wer_counts", "F3_tokens_review", "Q4_whole_review", "A2_verdict",
    "T1_sort_recorded", "T3_sort_rows_filename", "T4_natural_sort", "M4_trash_restore", "M5_relabel", "P10_line_matches", "A13_channel_levels", "K6_batch_report", "Q1_run_audit",
)
ALL = sorted(registered().plans())
NAMES = [n for n in ALL if n in SPREAD or os.environ.get("SCRIBELAKE_ALL")]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="shared tables not here")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    rows = [tuple(r) for r in df.collect()]
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    assert table_of(df.columns, rows) == table_of(columns, cur.fetchall())


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(ALL) <= set(entry.queries())
    assert {n for n in SPREAD} <= set(ALL)


def test_registry_needs_no_session():
    code = "import __spark_entry__ as e; assert len(e.queries()) >= len(e.oracle_sql()) > 0"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.abspath(entry.__file__)))


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns[0] == "source_id"
