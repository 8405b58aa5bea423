"""Reports about sprints: achievement, carry-over, and the sprints now running.

The sprint registry carries no broadcast hint. It grows with the data, so Spark decides from its
measured size; above the threshold the sort-merge join splits a sprint that holds very many issues.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.expressions import (
    as_date, days_since_update, first_completed, is_done_change, is_high_priority, issue_filter,
    needs_attention, planned_value, round_sp, safe_pct, sort_if, sum_if, team_of,
    urgency_rank, week_start,
)
from ..functions.skew import counted_join, key_counts
from ..vocab import DEFAULT, Vocabulary
from .reports import sprint_column_sums


def _in_sprints(issues: DataFrame, sprints: DataFrame, states: Sequence[str],
                *extra: str) -> DataFrame:
    """Issue rows of the sprints in the given states, with the registry's sprint name.

    The issue's own sprint name decides its team and so is kept as ``issue_sprint``.
    """
    chosen = sprints.filter(F.col("state").isin(*states)).select("sprint_id", "sprint_name", *extra)
    return issues.withColumnRenamed("sprint_name", "issue_sprint").join(chosen, "sprint_id")


def _team(vocab: Vocabulary):
    return team_of(sprint=F.col("issue_sprint"), rule=vocab.team_rule).alias("team")


# ── achievement and carry-over ──────────────────────────────────────────────────────────────


def _memberships(issues: DataFrame, sprint_issues: DataFrame, team: str | None,
                 vocab: Vocabulary) -> DataFrame:
    """Sized issues once per sprint they were ever in, with done and carried-over marks.

    An issue is carried over when it is not done and any other sprint holds it too, counted over
    the whole bridge.
    """
    sized = (
        issues.filter((F.col("reported_sp") > 0) & issue_filter(team=team, vocab=vocab))
        .select(F.col("key").alias("issue_key"), team_of(rule=vocab.team_rule).alias("team"),
                "reported_sp", "status_category", "created")
    )
    category = F.col("status_category")
    joined = counted_join(sprint_issues, sized, key_counts(sprint_issues), "sprint_name")
    return joined.select(
        "sprint_name", "team", "reported_sp", "created",
        (category == vocab.done).alias("is_done"),
        ((category != vocab.done) & (F.col("n") > 1)).alias("is_carried"),
    )


def membership_totals(issues: DataFrame, sprint_issues: DataFrame, team: str | None = None,
                      vocab: Vocabulary = DEFAULT) -> DataFrame:
    """What both achievement reports need of the bridge, one row per sprint and team: the bridge is
    joined once for the two of them if a caller passes this as their ``totals``."""
    sp = F.col("reported_sp")
    return (
        _memberships(issues, sprint_issues, team, vocab)
        .groupBy("sprint_name", "team")
        .agg(F.count("*").alias("total_issues"),
             F.max("created").alias("newest"),
             F.sum(sp).alias("sp"),
             sum_if(F.col("is_done"), sp).alias("done"),
             sum_if(F.col("is_carried"), sp).alias("carried"),
             F.count_if("is_carried").alias("carryover_count"))
        .filter(F.col("sp") > 0)
    )


def sprint_achievement(issues: DataFrame, sprint_issues: DataFrame, sprints: DataFrame,
                       team: str | None = None, vocab: Vocabulary = DEFAULT,
                       ordered: bool = True, totals: DataFrame | None = None) -> DataFrame:
    """Per sprint and team: planned (snapshot, else today's total), done and carried-over work."""
    found = membership_totals(issues, sprint_issues, team, vocab) if totals is None else totals
    planned = planned_value(F.col("planned_sp_snapshot"), round_sp(F.col("sp")))
    done = round_sp(F.col("done"))
    rows = (
        found.join(sprints.select("sprint_name", "planned_sp_snapshot"), "sprint_name", "left")
        .select("sprint_name", "team", "total_issues", planned.alias("planned_sp"), done.alias("done_sp"),
                round_sp(F.col("carried")).alias("carryover_sp"), "carryover_count",
                safe_pct(done, planned).alias("achievement_pct"))
    )
    return sort_if(rows, ordered, "sprint_name", "team")


def sprint_achievement_timeline(issues: DataFrame, sprint_issues: DataFrame,
                                team: str | None = None, vocab: Vocabulary = DEFAULT,
                                totals: DataFrame | None = None) -> DataFrame:
    """Achievement per week and team; a sprint falls in the week of its newest issue."""
    found = membership_totals(issues, sprint_issues, team, vocab) if totals is None else totals
    return (
        found.groupBy(week_start(F.col("newest")).alias("week_start"), "team")
        .agg(F.sum("sp").alias("planned_sp"), F.sum("done").alias("done_sp"),
             F.sum("carried").alias("carryover_sp"))
        .withColumn("achievement_pct", safe_pct(F.col("done_sp"), F.col("planned_sp")))
        .orderBy("week_start", "team")
    )


# ── registry ────────────────────────────────────────────────────────────────────────────────


def sprint_registry(sprints: DataFrame, metadata: DataFrame) -> DataFrame:
    """State, snapshot and dates per sprint; filter by sprint_id for a point lookup."""
    dates = metadata.select("sprint_id", "start_date", "end_date", "created_at", "updated_at")
    return sprints.join(dates, "sprint_id", "left").select(
        "sprint_id", "sprint_name", "board_name", "state", "planned_sp_snapshot",
        "snapshot_created_at", "start_date", "end_date", "created_at", "updated_at")


def sprint_total_sp(issues: DataFrame, sprint_issues: DataFrame) -> DataFrame:
    """Today's story points per sprint name; 0 for a sprint none of whose issues is stored."""
    sized = issues.select(F.col("key").alias("issue_key"), "reported_sp")
    joined = counted_join(sprint_issues, sized, key_counts(sprint_issues), "sprint_name")
    # A second sum over the bridge's names adds the sprints without a stored issue, so no join
    # has to keep unmatched rows of the long side.
    names = sprint_issues.select("sprint_name", F.lit(0.0).alias("reported_sp")).distinct()
    return joined.select("sprint_name", "reported_sp").unionByName(names).groupBy("sprint_name").agg(
        F.coalesce(F.sum("reported_sp"), F.lit(0.0)).alias("total_sp"))


# ── sprints now running ─────────────────────────────────────────────────────────────────────


def active_sprints_progress(issues: DataFrame, sprints: DataFrame, vocab: Vocabulary = DEFAULT,
                            ordered: bool = True) -> DataFrame:
    """Issues and story points, all and done, per open sprint and team."""
    keep = ("total_issues", "done_issues", "total_sp", "done_sp")
    rows = (
        _in_sprints(issues, sprints, ("active", "future"), "state")
        .groupBy("sprint_name", _team(vocab), "state")
        .agg(*sprint_column_sums(vocab))
        .select("sprint_name", "team", "state", *keep)
    )
    return sort_if(rows, ordered, "team", F.desc("state"), "sprint_name")


def active_sprint_details(issues: DataFrame, sprints: DataFrame, metadata: DataFrame,
                          vocab: Vocabulary = DEFAULT) -> DataFrame:
    """Active sprints with dates and work by status category, per team.

    Dates are joined after the aggregation, where there is one row per sprint and team.
    """
    sums = (
        _in_sprints(issues, sprints, ("active",), "state")
        .groupBy("sprint_id", "sprint_name", _team(vocab), "state")
        .agg(*sprint_column_sums(vocab))
    )
    dates = metadata.select("sprint_id", "start_date", "end_date")
    measures = [c for c in sums.columns if c not in ("sprint_id", "sprint_name", "team", "state")]
    return sums.join(dates, "sprint_id", "left").select(
        "sprint_id", "sprint_name", "team", "state", "start_date", "end_date", *measures,
    ).orderBy("team", "sprint_id")


def active_sprint_issues(issues: DataFrame, sprints: DataFrame, changelog: DataFrame | None,
                         as_of: object, vocab: Vocabulary = DEFAULT,
                         completed: DataFrame | None = None, ordered: bool = True) -> DataFrame:
    """Issue rows of active sprints with urgency, idle days and first completion."""
    done = first_completed(changelog, vocab) if completed is None else completed
    summary, priority = F.col("summary"), F.col("priority")
    rows = _in_sprints(issues, sprints, ("active",)).join(done, F.col("key") == F.col("issue_key"), "left")
    urgency = urgency_rank(priority, summary, vocab)
    return (
        sort_if(rows, ordered, urgency, F.desc_nulls_last("reported_sp"), "key")
        .select(
            "key", "summary", "status", "status_category", "priority", "assignee", "sprint_name",
            _team(vocab), "reported_sp", "flagged",
            F.col("created").cast("date").alias("created_date"),
            F.col("updated").cast("date").alias("updated_date"),
            days_since_update(F.col("updated"), as_date(as_of)).alias("days_since_update"),
            is_high_priority(summary, priority, vocab).alias("is_high_priority"),
            "completed_date",
        )
    )


def sprint_daily_burndown(issues: DataFrame, sprints: DataFrame, changelog: DataFrame,
                          vocab: Vocabulary = DEFAULT) -> DataFrame:
    """Work completed per active sprint, team and day; closing an issue again counts again.

    Transitions are counted per issue and day before the join, so an issue with a very long
    history brings one row per day into it.
    """
    closings = (
        changelog.filter(is_done_change(vocab))
        .groupBy("issue_key", F.col("created").cast("date").alias("completion_date"))
        .agg(F.count("*").alias("times"))
    )
    return (
        _in_sprints(issues, sprints, ("active",))
        .join(closings, F.col("key") == F.col("issue_key"))
        .groupBy("sprint_name", _team(vocab), "completion_date")
        .agg(F.sum(F.col("reported_sp") * F.col("times")).alias("completed_sp"),
             F.sum("times").alias("completed_count"))
        .orderBy("sprint_name", "completion_date", "team")
    )


def sprint_member_workload(issues: DataFrame, sprints: DataFrame, vocab: Vocabulary = DEFAULT) -> DataFrame:
    """Work by status category per active sprint, team and assignee."""
    return (
        _in_sprints(issues.filter(F.col("assignee").isNotNull()), sprints, ("active",))
        .groupBy("sprint_name", _team(vocab), "assignee")
        .agg(*sprint_column_sums(vocab))
        .orderBy("team", F.desc_nulls_last("total_sp"), "assignee", "sprint_name")
    )


_LIST_COLUMNS = ("key", "summary", "status", "status_category", "priority", "assignee", "sprint_name")


def high_priority_issues(issues: DataFrame, sprints: DataFrame, as_of: object,
                         vocab: Vocabulary = DEFAULT, ordered: bool = True) -> DataFrame:
    """Open issues of active sprints that need attention, most urgent and longest idle first."""
    wanted = needs_attention(
        F.col("summary"), F.col("priority"), F.col("flagged"), F.col("status_category"), vocab)
    idle = days_since_update(F.col("updated"), as_date(as_of))
    rows = _in_sprints(issues.filter(wanted), sprints, ("active",))
    urgency = urgency_rank(F.col("priority"), vocab=vocab)
    return (
        sort_if(rows, ordered, urgency, idle.desc_nulls_last(), "key")
        .select(*_LIST_COLUMNS, _team(vocab), "reported_sp", "flagged",
                F.col("updated").cast("date").alias("updated_date"),
                idle.alias("days_since_update"))
    )


def stalled_issues(issues: DataFrame, sprints: DataFrame, as_of: object, days: int = 3,
                   vocab: Vocabulary = DEFAULT, ordered: bool = True) -> DataFrame:
    """Open issues of active sprints that nobody has touched for ``days`` days or more."""
    idle = days_since_update(F.col("updated"), as_date(as_of))
    open_and_idle = (F.col("status_category") != vocab.done) & (idle >= days)
    rows = _in_sprints(issues.filter(open_and_idle), sprints, ("active",))
    return (
        sort_if(rows, ordered, idle.desc(), F.desc_nulls_last("reported_sp"), "key")
        .select(*_LIST_COLUMNS, _team(vocab), "reported_sp",
                F.col("updated").cast("date").alias("updated_date"),
                idle.alias("days_since_update"))
    )
