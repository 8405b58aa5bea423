"""The bundle of reports behind the dashboard."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from ..functions.expressions import completions
from ..operators import reports as r, sprint_reports as s
from ..session import written
from ..vocab import DEFAULT, Vocabulary


def shared_completions(changelog: DataFrame, vocab: Vocabulary = DEFAULT) -> DataFrame:
    """First and last completions, written to the shared folder and read back."""
    return written(completions(changelog, vocab), "completions")


def shared_totals(issues: DataFrame, start: object = None, vocab: Vocabulary = DEFAULT) -> DataFrame:
    """``issue_totals`` from the report start on, written to the shared folder and read back."""
    return written(r.issue_totals(issues, vocab.report_start if start is None else start, vocab), "totals")


def shared_memberships(issues: DataFrame, bridge: DataFrame, vocab: Vocabulary = DEFAULT) -> DataFrame:
    """``membership_totals`` of all teams, written to the shared folder and read back."""
    return written(s.membership_totals(issues, bridge, vocab=vocab), "memberships")


def shared_work(issues: DataFrame, completed: DataFrame, vocab: Vocabulary = DEFAULT) -> DataFrame:
    """``work_totals``, written to the shared folder and read back."""
    return written(r.work_totals(issues, completed, vocab), "work")


def dashboard(tables: Mapping[str, DataFrame], as_of: object, start: object = None,
              vocab: Vocabulary = DEFAULT, completed: DataFrame | None = None,
              totals: DataFrame | None = None, members: DataFrame | None = None,
              work: DataFrame | None = None) -> dict[str, DataFrame]:
    """Every dashboard result by name, all lazy.

    ``tables`` holds the stored tables by name. Seven results need the first or last completion of
    each issue, an aggregate of the change history, by far the largest table. A caller that wants
    many results computes it once with ``shared_completions`` and passes it; a ``TableStore`` keeps it as
    ``completions``. Four results need no more of the issues than ``shared_totals`` has, two no more of the bridge than
    ``shared_memberships``, and five no more of issues and completions than ``shared_work``.
    """
    start = vocab.report_start if start is None else start
    issues, changelog = tables["issues"], tables["issue_changelog"]
    sprints, bridge = tables["synced_sprints"], tables["sprint_issues"]
    both = completions(changelog, vocab) if completed is None else completed
    done = both.select("issue_key", "completed_date")
    velocity = dict(changelog=None, vocab=vocab, completed=done, work=work)
    # The result names that readers of the export expect.
    return {
        "velocity": r.velocity_by_team(issues, date_from=start, **velocity),
        "teamSummary": r.team_summary(issues, start, vocab, totals=totals),
        "recentTrend": r.recent_velocity_trend(issues, **velocity),
        "sprintProgress": s.active_sprints_progress(issues, sprints, vocab),
        "sprintAchievement": s.sprint_achievement(issues, bridge, sprints, vocab=vocab, totals=members),
        "sprintAchievementTimeline": s.sprint_achievement_timeline(issues, bridge, vocab=vocab, totals=members),
        "assigneeLoad": r.assignee_load(issues, vocab=vocab, totals=totals),
        "leaderboard": r.leaderboard(issues, date_from=start, vocab=vocab, totals=totals),
        "leaderboardPeriods.last_week": r.leaderboard_last_week(issues, **velocity),
        "leaderboardPeriods.last_3_weeks": r.leaderboard_last_3_weeks(issues, **velocity),
        "statusBreakdown": r.status_breakdown(issues, date_from=start, vocab=vocab, totals=totals),
        "individualVelocity": r.individual_velocity(issues, date_from=start, **velocity),
        "issues": r.issues_table(issues, None, date_from=start, vocab=vocab, completed=both),
        "sufficiency": r.latest_sufficiency(tables["sufficiency_snapshots"]),
        "activeSprintDetails": s.active_sprint_details(
            issues, sprints, tables["sprint_metadata"], vocab),
        "activeSprintIssues": s.active_sprint_issues(
            issues, sprints, None, as_of, vocab, completed=done),
        "sprintBurndown": s.sprint_daily_burndown(issues, sprints, changelog, vocab),
        "sprintMemberWorkload": s.sprint_member_workload(issues, sprints, vocab),
        "highPriorityIssues": s.high_priority_issues(issues, sprints, as_of, vocab),
        "stalledIssues": s.stalled_issues(issues, sprints, as_of, vocab=vocab),
    }
