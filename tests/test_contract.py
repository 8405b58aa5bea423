"""Every registered query against its SQL on the smallest driver tables."""

from __future__ import annotations

import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
import check
from fixtures.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="driver tables not present")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for table in check.TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) <= set(contract.queries())
    assert set(QUERIES) <= set(contract.oracle_sql()) <= set(contract.queries())


# check.py runs every query; here, unless ALL_QUERIES is set, one of each kind.
SOME = (
    "rich_text_to_plain_documents ingest_changelog sprint_list csv_export_velocity upsert replace_columns "
    "sprint_issues transition_snapshots sync_summary sufficiency_update iso_week_label other_sprint_count "
    "leaderboard_last_3_weeks velocity_by_team team_summary sprint_achievement sprint_daily_burndown "
    "trend_class velocity_pivot velocity_pivot_some_weeks assignee_summary scoring_prompts score_issues "
    "comment_threads_long ingest_rejects unique_sprints dashboard_export_issues run_scoring_scores "
    "sprint_total_sp_partly_stored").split()


@pytest.mark.parametrize("name", list(QUERIES) if os.environ.get("ALL_QUERIES") else SOME)
def test_query_equals_sql(spark, con, name):
    frame = contract.queries()[name](spark, FOLDER)
    got = check.rows([tuple(r) for r in frame.collect()], frame.columns)
    result = con.execute(contract.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(frame.columns) == sorted(columns)
    assert got == check.rows(result.fetchall(), columns)


def test_entry(spark):
    assert contract.entry(spark).count() == 589
