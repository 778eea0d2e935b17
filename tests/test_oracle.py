"""Registered queries against their SQL in DuckDB at the smallest scale."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry  # noqa: E402

SF = "/root/testdata/sf0.001"
# One per family here; tools/check_oracle.py compares all of them.
NAMES = [
    "src_packets", "snk_upsert", "flt_capture", "fn_event_id", "cln_prepared", "ds_split", "qry_list_alerts", "vw_threats", "ses_summary",
    "ses_predict_trigger", "feat_session", "det_heuristic", "det_bruteforce", "alr_upsert", "alr_session_dedup", "blk_state", "blk_commands",
    "blk_flag_packets", "blk_settled", "blk_watch_packets", "ip_control_state", "tel_rates", "tel_exchanges", "dash_rollup", "dash_summary", "dash_incident_detail", "chk_orphans",
    "ev_metrics", "st_telemetry", "st_rollup", "st_sessions", "st_detect", "st_block_state", "evt_ids", "snk_fanout", "dash_incident_report", "ml_artifact_guard",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f[:-8]} as select * from read_parquet('{SF}/{f}')")
    return c


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(r[i] for i in order)) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert canonical(df.columns, df.collect()) == canonical(columns, cur.fetchall())


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 8
