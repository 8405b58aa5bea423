from __future__ import annotations

import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from sprintloom import schemas  # noqa: E402
from sprintloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("spark")
    session = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g",
        "spark.checkpoint.dir": str(folder / "shared"),
        "spark.sql.warehouse.dir": str(folder / "warehouse")})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def at(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)


def day(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


ISSUE = dict(
    key="T-1", board_name="Main Board", sprint_id=1, sprint_name="S1 ScrumA", summary="work",
    assignee="ann", reported_sp=1.0, status="To Do", status_category="To Do", priority="Medium",
    issuetype="Story", resolution=None, flagged=False, created=at("2025-01-06"),
    updated=at("2025-01-06"), description="")


class Make:
    """Small typed tables from the columns a test cares about."""

    def __init__(self, spark):
        self.spark = spark

    def _table(self, schema, rows, defaults):
        full = [{**defaults, **row} for row in rows]
        return self.spark.createDataFrame(
            [tuple(row.get(name) for name in schema.fieldNames()) for row in full], schema)

    def issues(self, *rows):
        return self._table(schemas.ISSUES, rows, ISSUE)

    def changes(self, *rows):
        rows = [{"id": str(i), **row} for i, row in enumerate(rows)]
        return self._table(schemas.ISSUE_CHANGELOG, rows, dict(
            issue_key="T-1", author="ann", field="status", to_string="Done", created=at("2025-01-10")))

    def comments(self, *rows):
        return self._table(schemas.ISSUE_COMMENTS, rows, dict(
            issue_key="T-1", author="ann", body="hi", created=at("2025-01-10")))

    def sprints(self, *rows):
        return self._table(schemas.SYNCED_SPRINTS, rows, dict(
            sprint_id=1, board_name="Main Board", sprint_name="S1 ScrumA", state="active",
            synced_at=at("2025-01-01")))

    def metadata(self, *rows):
        return self._table(schemas.SPRINT_METADATA, rows, dict(sprint_id=1, sprint_name="S1 ScrumA"))

    def bridge(self, *pairs):
        return self.spark.createDataFrame(list(pairs), schemas.SPRINT_ISSUES)

    def weekly(self, *rows):
        return self._table(schemas.WEEKLY_METRICS, rows, dict(
            board_name="Main Board", assignee="ann", reported_sp=1.0, issue_count=1))

    def history(self, *rows):
        return self.spark.createDataFrame(list(rows), schemas.SUFFICIENCY_SNAPSHOTS)

    def scores(self, *rows):
        return self._table(schemas.AI_SCORES, rows, {})


@pytest.fixture(scope="session")
def make(spark):
    return Make(spark)


def dicts(df):
    return [row.asDict() for row in df.collect()]


def tuples(df):
    return [tuple(row) for row in df.collect()]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
