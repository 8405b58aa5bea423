"""Spark schemas of the nine stored tables and of the landed raw documents."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _D, _I, _B = T.StringType(), T.DoubleType(), T.IntegerType(), T.BooleanType()
_TS, _DATE = T.TimestampNTZType(), T.DateType()


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in columns.items()])


ISSUES = _table(
    key=_S, board_name=_S, sprint_id=_I, sprint_name=_S, summary=_S, assignee=_S,
    reported_sp=_D, status=_S, status_category=_S, priority=_S, issuetype=_S,
    resolution=_S, flagged=_B, created=_TS, updated=_TS, description=_S,
)
ISSUE_COMMENTS = _table(id=_S, issue_key=_S, author=_S, body=_S, created=_TS)
ISSUE_CHANGELOG = _table(
    id=_S, issue_key=_S, author=_S, field=_S, from_string=_S, to_string=_S, created=_TS,
)
AI_SCORES = _table(
    issue_key=_S, complexity_reasoning=_S, clarity_score=_D, clarity_notes=_S, analyzed_at=_TS,
)
WEEKLY_METRICS = _table(
    week_start=_DATE, board_name=_S, assignee=_S, reported_sp=_D, issue_count=T.LongType(),
)
SUFFICIENCY_SNAPSHOTS = _table(snapshot_date=_DATE, future_sp=_D, avg_velocity=_D, sufficiency=_D)
SYNCED_SPRINTS = _table(
    sprint_id=_I, board_name=_S, sprint_name=_S, state=_S, synced_at=_TS,
    planned_sp_snapshot=_D, snapshot_created_at=_TS,
)
SPRINT_ISSUES = _table(sprint_name=_S, issue_key=_S)
SPRINT_METADATA = _table(
    sprint_id=_I, sprint_name=_S, start_date=_S, end_date=_S, created_at=_TS, updated_at=_TS,
)
# What derived tables are kept as, so that a batch can be added and what it replaces taken out.
WEEKLY_SUMS = _table(
    week_start=_DATE, board_name=_S, assignee=_S, points=T.DecimalType(38, 6),
    n_points=T.LongType(), issue_count=T.LongType(),
)
MEMBERSHIPS = _table(sprint_name=_S, issue_key=_S, n=T.LongType())
COMPLETION_TIMES = _table(issue_key=_S, first_done=_TS, last_done=_TS, n_done=T.LongType())
SCORED_PROMPTS = _table(issue_key=_S, digest=_S, analyzed_at=_TS)

TABLES: dict[str, T.StructType] = {
    "issues": ISSUES,
    "issue_comments": ISSUE_COMMENTS,
    "issue_changelog": ISSUE_CHANGELOG,
    "ai_scores": AI_SCORES,
    "weekly_metrics": WEEKLY_METRICS,
    "sufficiency_snapshots": SUFFICIENCY_SNAPSHOTS,
    "synced_sprints": SYNCED_SPRINTS,
    "sprint_issues": SPRINT_ISSUES,
    "sprint_metadata": SPRINT_METADATA,
}
STATES: dict[str, T.StructType] = {
    "weekly_sums": WEEKLY_SUMS,
    "memberships": MEMBERSHIPS,
    "completion_times": COMPLETION_TIMES,
    "scored_prompts": SCORED_PROMPTS,
}
TABLE_KEYS: dict[str, tuple[str, ...]] = {
    "issues": ("key",),
    "issue_comments": ("id",),
    "issue_changelog": ("id",),
    "ai_scores": ("issue_key",),
    "weekly_metrics": ("week_start", "board_name", "assignee"),
    "sufficiency_snapshots": ("snapshot_date",),
    "synced_sprints": ("sprint_id",),
    "sprint_issues": ("sprint_name", "issue_key"),
    "sprint_metadata": ("sprint_id",),
    "scored_prompts": ("issue_key",),
}
# Order inside each stored file. Row groups then hold few fields of the history, or a short span of
# days, and the scan skips those that a pushed-down filter rules out. No shuffle is needed for it.
TABLE_ORDER: dict[str, tuple[str, ...]] = {
    "issues": ("created",),
    "issue_changelog": ("field", "created"),
    "weekly_sums": ("week_start",),
    "memberships": ("sprint_name",),
}
# Values given to rows written before a column existed.
COLUMN_DEFAULTS: dict[str, dict[str, object]] = {
    "issues": {"issuetype": "", "flagged": False},
}

STORY_POINTS_FIELD = "customfield_10016"
CORRUPT = "_corrupt_record"


def raw_issue_schema(story_points_field: str = STORY_POINTS_FIELD) -> T.StructType:
    """One landed line: the sprint it was fetched for plus the nested issue document.

    Rich-text parts and ``flagged`` may be of any JSON type, so they are variants: a text that looks
    like JSON stays apart from a tree. A line that cannot be read is kept whole in ``CORRUPT``.
    """
    person = T.StructType([T.StructField("displayName", _S)])
    named = T.StructType([T.StructField("name", _S)])
    status = T.StructType([T.StructField("name", _S), T.StructField("statusCategory", named)])
    comment = _table(id=_S, author=person, body=T.VariantType(), created=_S)
    item = _table(field=_S, fromString=_S, toString=_S)
    history = _table(id=_S, author=person, created=_S, items=T.ArrayType(item))
    fields = T.StructType([
        T.StructField("summary", _S),
        T.StructField("assignee", person),
        T.StructField(story_points_field, _D),
        T.StructField("status", status),
        T.StructField("priority", named),
        T.StructField("issuetype", named),
        T.StructField("resolution", named),
        T.StructField("flagged", T.VariantType()),
        T.StructField("created", _S),
        T.StructField("updated", _S),
        T.StructField("description", T.VariantType()),
        T.StructField("comment", T.StructType([T.StructField("comments", T.ArrayType(comment))])),
    ])
    changelog = T.StructType([T.StructField("histories", T.ArrayType(history))])
    return T.StructType([
        T.StructField("board_name", _S),
        T.StructField("sprint_id", _I),
        T.StructField("sprint_name", _S),
        T.StructField("issue", T.StructType([
            T.StructField("key", _S),
            T.StructField("fields", fields),
            T.StructField("changelog", changelog),
        ])),
        T.StructField(CORRUPT, _S),
    ])


RAW_SPRINTS = T.StructType([
    T.StructField("board_name", _S),
    T.StructField("page", _I),
    T.StructField("values", T.ArrayType(_table(
        id=_I, name=_S, state=_S, startDate=_S, endDate=_S, completeDate=_S))),
])
