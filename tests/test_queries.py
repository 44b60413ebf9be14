"""Registered queries against their SQL twins on the smallest data set."""

import os

import duckdb
import pytest

from check import TABLES, normal
from conftest import DATA
from sessionlens.catalog import load
from sessionlens.catalog.registry import ORACLE, QUERIES

load()
# One query per module area; CHECK_ALL=1 runs every query that has SQL.
CHOSEN = (
    "D02_usage_by_session D05_session_rollup L01_sessions_by_cache_ratio D08_composition_detected_kind D11_unknown_summary D12_tool_surface D24_request_ledger"
    " D28_sidecar_audit D14_compressor_summary D29_session_repetition C10_context_deltas Q03_compaction_survival Q05_semantic_reappearances Q08_eviction_policies"
    " C05_structural_tokens C08_line_signals C01_request_blocks F21_usage_normalisation P10_attempt_status T02_stream_fold T09_running_counters R16_ripgrep R07_line_fold"
    " E03_paired_verdict E09_layer_decomposition Q10_convergence_gate S04_merge_sidecars D45_snapshot_metrics"
).split()
NAMES = sorted(ORACLE) if os.environ.get("CHECK_ALL") else CHOSEN


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    return connection


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES) and len(QUERIES) > 200


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, db, name):
    frame = QUERIES[name](spark, DATA)
    columns = sorted(frame.columns)
    got = sorted((tuple(normal(v) for v in row) for row in frame.select(*columns).collect()), key=repr)
    result = db.execute(ORACLE[name])
    found = [d[0] for d in result.description]
    assert sorted(found) == columns
    pick = [found.index(c) for c in columns]
    want = sorted((tuple(normal(row[i]) for i in pick) for row in result.fetchall()), key=repr)
    assert got == want
