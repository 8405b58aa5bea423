"""Delivery reports over issues, change history and the weekly aggregate.

Row lists end their sort keys with the issue key: rows that share a date or a rank, however many,
can then be divided between the tasks of the sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.expressions import (
    as_date, first_completed, iso_week_label, issue_filter, last_completed, priority_rank,
    round_sp, safe_pct, sort_if, sum_if, team_of, week_start,
)
from ..vocab import DEFAULT, Vocabulary


def issues_with_scores(issues: DataFrame, scores: DataFrame, ordered: bool = True) -> DataFrame:
    found = scores.select(
        F.col("issue_key").alias("key"), "complexity_reasoning", "clarity_score", "clarity_notes")
    rows = issues.join(found, "key", "left").select(
        *issues.columns, "complexity_reasoning", "clarity_score", "clarity_notes")
    return sort_if(rows, ordered, F.desc_nulls_last("created"), "key")


# ── leaderboards ────────────────────────────────────────────────────────────────────────────


def _ranking(rows: DataFrame, n: Column | None = None) -> DataFrame:
    return (
        rows.filter(F.col("assignee").isNotNull())
        .groupBy("assignee")
        .agg((F.count("*") if n is None else n).alias("issue_count"), round_sp(F.sum("reported_sp")).alias("total_sp"))
        .orderBy(F.desc_nulls_last("total_sp"), "assignee")
    )


def leaderboard(issues: DataFrame, board: str | None = None, date_from: object = None,
                vocab: Vocabulary = DEFAULT, totals: DataFrame | None = None) -> DataFrame:
    """Story points per assignee, all of them, dated by creation."""
    if totals is not None:
        return _ranking(totals.filter("in_period"), F.sum("n"))
    return _ranking(issues.filter(issue_filter(board=board, date_from=date_from, vocab=vocab)))


def _recent_ranking(issues: DataFrame, changelog: DataFrame | None, board: str | None,
                    weeks_back: int, vocab: Vocabulary, completed: DataFrame | None,
                    work: DataFrame | None = None) -> DataFrame:
    done = first_completed(changelog, vocab) if completed is None else completed
    # The newest week is a scalar subquery over every completion, with or without an issue row.
    newest = done.agg(F.max(week_start(F.col("completed_date")))).scalar()
    if work is not None and not board:
        return _ranking(work.filter(F.col("completed_date") >= F.date_sub(newest, 7 * weeks_back)), F.sum("n"))
    recent = done.filter(F.col("completed_date") >= F.date_sub(newest, 7 * weeks_back))
    rows = issues.filter(issue_filter(board=board, vocab=vocab))
    return _ranking(rows.join(recent, F.col("key") == F.col("issue_key")))


def leaderboard_last_week(issues: DataFrame, changelog: DataFrame | None, board: str | None = None,
                          vocab: Vocabulary = DEFAULT, completed: DataFrame | None = None,
                          work: DataFrame | None = None) -> DataFrame:
    """Completed story points per assignee in the newest completion week."""
    return _recent_ranking(issues, changelog, board, 0, vocab, completed, work)


def leaderboard_last_3_weeks(issues: DataFrame, changelog: DataFrame | None, board: str | None = None,
                             vocab: Vocabulary = DEFAULT, completed: DataFrame | None = None,
                             work: DataFrame | None = None) -> DataFrame:
    """The same from two weeks before the newest completion week."""
    return _recent_ranking(issues, changelog, board, 2, vocab, completed, work)


# ── the weekly aggregate ────────────────────────────────────────────────────────────────────


def _weekly(weekly: DataFrame, *keys: str) -> DataFrame:
    return (
        weekly.groupBy("week_start", *keys)
        .agg(F.sum("reported_sp").alias("reported_sp"), F.sum("issue_count").alias("issue_count"))
        .orderBy("week_start", *keys)
    )


def weekly_board_metrics(weekly: DataFrame) -> DataFrame:
    return _weekly(weekly, "board_name")


def weekly_assignee_metrics(weekly: DataFrame, board: str | None = None) -> DataFrame:
    rows = weekly if not board else weekly.filter(F.col("board_name") == board)
    return _weekly(rows, "assignee")


def weekly_total(weekly: DataFrame) -> DataFrame:
    return _weekly(weekly)


def avg_recent_velocity(weekly: DataFrame, n: int = 3) -> DataFrame:
    """Mean of the newest ``n`` weekly totals as one row; 0 without any."""
    newest = (
        weekly.groupBy("week_start").agg(F.sum("reported_sp").alias("total_sp"))
        .orderBy(F.desc("week_start")).limit(n)
    )
    return newest.agg(F.coalesce(F.avg("total_sp"), F.lit(0.0)).alias("avg_velocity"))


def sufficiency(weekly: DataFrame, future_sp: DataFrame) -> DataFrame:
    """Planned future work as a percentage of recent velocity; 0 without velocity."""
    velocity = F.col("avg_velocity")
    return (
        future_sp.select("future_sp")
        .withColumn("avg_velocity", avg_recent_velocity(weekly).scalar())
        .withColumn("sufficiency", F.coalesce(
            F.when(velocity > 0,
                   F.round(F.col("future_sp") / F.nullif(velocity, F.lit(0.0)) * 100, 1)),
            F.lit(0.0)))
    )


def latest_sufficiency(history: DataFrame) -> DataFrame:
    return history.orderBy(F.desc("snapshot_date")).limit(1)


def issue_count(issues: DataFrame) -> DataFrame:
    return issues.agg(F.count("*").alias("issue_count"))


def closed_sprint_ids(sprints: DataFrame) -> DataFrame:
    return sprints.filter(F.col("state") == "closed").select("sprint_id")


# ── velocity ────────────────────────────────────────────────────────────────────────────────


def work_totals(issues: DataFrame, completed: DataFrame, vocab: Vocabulary = DEFAULT) -> DataFrame:
    """Issues and story points by day of first completion, assignee and team: one join of issues and completions that
    the velocity reports and recent leaderboards of a whole deployment can take as their ``work``.

    ``sized`` and ``sized_sp`` are those of issues that have story points, which velocity counts.
    """
    sp, sized = F.col("reported_sp"), F.col("reported_sp") > 0
    rows = issues.filter(F.col("assignee").isNotNull()).join(completed, F.col("key") == F.col("issue_key"))
    return rows.groupBy("completed_date", "assignee", team_of(rule=vocab.team_rule).alias("team")).agg(
        F.count("*").alias("n"), F.sum(sp).alias("reported_sp"),
        F.count_if(sized).alias("sized"), F.sum(F.when(sized, sp)).alias("sized_sp"))


def _completed_work(issues: DataFrame, changelog: DataFrame | None, date_from: object, vocab: Vocabulary,
                    completed: DataFrame | None, work: DataFrame | None = None) -> DataFrame:
    """Completed issues with their week, or with ``work`` sums over ``n`` of them."""
    day = F.col("completed_date")
    if work is not None:
        rows = work.filter("sized > 0").select(
            day, "assignee", "team", F.col("sized_sp").alias("reported_sp"), F.col("sized").alias("n"))
        if date_from is not None:
            rows = rows.filter(day >= as_date(date_from))
    else:
        done = first_completed(changelog, vocab) if completed is None else completed
        if date_from is not None:
            done = done.filter(day >= as_date(date_from))
        sized = issues.filter(F.col("assignee").isNotNull() & (F.col("reported_sp") > 0))
        rows = sized.join(done, F.col("key") == F.col("issue_key")).select(
            day, "assignee", team_of(rule=vocab.team_rule).alias("team"), "reported_sp", F.lit(1).alias("n"))
    return rows.select(week_start(day).alias("week_start"), iso_week_label(day).alias("week_label"),
                       "assignee", "team", "reported_sp", "n")


def _velocity(work: DataFrame, ordered: bool, *keys: str) -> DataFrame:
    # The label is a function of the week, so it rides along instead of widening the key.
    rows = (
        work.groupBy("week_start", *keys)
        .agg(F.min("week_label").alias("week_label"), F.sum("reported_sp").alias("done_sp"),
             F.sum("n").alias("issue_count"))
        .select("week_start", "week_label", *keys, "done_sp", "issue_count")
    )
    return sort_if(rows, ordered, "week_start", *keys)


def velocity_by_team(issues: DataFrame, changelog: DataFrame | None, date_from: object = None,
                     vocab: Vocabulary = DEFAULT, completed: DataFrame | None = None,
                     ordered: bool = True, work: DataFrame | None = None) -> DataFrame:
    """Completed story points per week and team."""
    return _velocity(
        _completed_work(issues, changelog, date_from, vocab, completed, work), ordered, "team")


def individual_velocity(issues: DataFrame, changelog: DataFrame | None, date_from: object = None,
                        vocab: Vocabulary = DEFAULT, completed: DataFrame | None = None,
                        ordered: bool = True, work: DataFrame | None = None) -> DataFrame:
    """Completed story points per week, assignee and the team the work was done in."""
    return _velocity(
        _completed_work(issues, changelog, date_from, vocab, completed, work), ordered, "assignee", "team")


def recent_velocity_trend(issues: DataFrame, changelog: DataFrame | None,
                          vocab: Vocabulary = DEFAULT, completed: DataFrame | None = None,
                          ordered: bool = True, work: DataFrame | None = None) -> DataFrame:
    """Weekly velocity per team, from 8 weeks before the newest week on (up to 9 weeks)."""
    weekly = (
        _completed_work(issues, changelog, None, vocab, completed, work)
        .groupBy("week_start", "team").agg(F.sum("reported_sp").alias("done_sp"))
    )
    # One row per week and team: the calendar and the team rule bound what the window holds.
    newest = F.max("week_start").over(Window.partitionBy(F.lit(0)))
    rows = weekly.withColumn("_newest", newest).filter(
        F.col("week_start") >= F.date_sub("_newest", 56)).drop("_newest")
    return sort_if(rows, ordered, "week_start", "team")


# ── issue-only reports ──────────────────────────────────────────────────────────────────────


def issue_totals(issues: DataFrame, date_from: object = None, vocab: Vocabulary = DEFAULT) -> DataFrame:
    """Issues and story points by everything the issue-only reports group or filter by: one pass over the issues that
    ``leaderboard``, ``team_summary``, ``assignee_load`` and ``status_breakdown`` of a whole deployment
    can take as their ``totals``. It has a row per person, team and state, not per issue.

    ``in_period`` is what ``date_from`` keeps, ``recent`` what ``assignee_load`` does.
    """
    newest = issues.agg(F.max("created")).scalar()
    return issues.groupBy(
        team_of(rule=vocab.team_rule).alias("team"), "assignee", "status_category",
        F.coalesce(issue_filter(date_from=date_from, vocab=vocab), F.lit(False)).alias("in_period"),
        F.coalesce(F.col("created") >= newest - F.expr("INTERVAL 28 DAYS"), F.lit(False)).alias("recent"),
    ).agg(F.count("*").alias("n"), F.sum("reported_sp").alias("reported_sp"))


def team_summary(issues: DataFrame, date_from: object = None, vocab: Vocabulary = DEFAULT,
                 ordered: bool = True, totals: DataFrame | None = None) -> DataFrame:
    """Per team: issues, story points, done share and number of members.

    Members are counted from one row per (team, assignee), which also carries the sums: two
    aggregations instead of the expanded rows a distinct count beside sums would need.
    """
    sp = F.col("reported_sp")
    if totals is None:
        rows, team, n = issues.filter(issue_filter(date_from=date_from, vocab=vocab)), team_of(rule=vocab.team_rule), F.count("*")
    else:
        rows, team, n = totals.filter("in_period"), F.col("team"), F.sum("n")
    per_member = rows.groupBy(team.alias("team"), "assignee").agg(
        n.alias("n"), F.sum(sp).alias("sp"), sum_if(F.col("status_category") == vocab.done, sp).alias("done"))
    teams = per_member.groupBy("team").agg(
        F.sum("n").alias("total_issues"),
        round_sp(F.sum("sp")).alias("total_sp"),
        round_sp(F.sum("done")).alias("done_sp"),
        safe_pct(F.sum("done"), F.sum("sp")).alias("completion_pct"),
        F.count("assignee").alias("member_count"),
    )
    return sort_if(teams, ordered, "team")


def assignee_load(issues: DataFrame, team: str | None = None, vocab: Vocabulary = DEFAULT,
                  ordered: bool = True, totals: DataFrame | None = None) -> DataFrame:
    """Work per assignee and team created in the 4 weeks before the newest issue of any team."""
    category = F.col("status_category")
    if totals is None:
        newest = issues.agg(F.max("created")).scalar()
        recent = issues.filter(
            F.col("assignee").isNotNull()
            & (F.col("created") >= newest - F.expr("INTERVAL 28 DAYS"))
            & issue_filter(team=team, vocab=vocab))
        group, n, count_where = team_of(rule=vocab.team_rule), F.count("*"), F.count_if
    else:
        recent = totals.filter(F.col("recent") & F.col("assignee").isNotNull())
        group, n = F.col("team"), F.sum("n")
        count_where = lambda condition: F.sum(F.when(condition, F.col("n")).otherwise(0))
    rows = (
        recent.groupBy("assignee", group.alias("team"))
        .agg(n.alias("issue_count"),
             round_sp(F.sum("reported_sp")).alias("total_sp"),
             count_where(category == vocab.done).alias("done_count"),
             count_where(category == vocab.in_progress).alias("in_progress_count"))
    )
    return sort_if(rows, ordered, F.desc_nulls_last("total_sp"), "assignee", "team")


def _breakdown(issues: DataFrame, by: str, team: str | None, date_from: object,
               vocab: Vocabulary) -> DataFrame:
    return (
        issues.filter(issue_filter(team=team, date_from=date_from, vocab=vocab))
        .groupBy(by)
        .agg(F.count("*").alias("count"), round_sp(F.sum("reported_sp")).alias("sp"))
    )


def status_breakdown(issues: DataFrame, team: str | None = None, date_from: object = None,
                     vocab: Vocabulary = DEFAULT, ordered: bool = True, totals: DataFrame | None = None) -> DataFrame:
    if totals is None:
        rows = _breakdown(issues, "status_category", team, date_from, vocab)
    else:
        rows = totals.filter("in_period").groupBy("status_category").agg(
            F.sum("n").alias("count"), round_sp(F.sum("reported_sp")).alias("sp"))
    return sort_if(rows, ordered, F.desc("count"), "status_category")


def priority_breakdown(issues: DataFrame, team: str | None = None, date_from: object = None,
                       vocab: Vocabulary = DEFAULT) -> DataFrame:
    return _breakdown(issues, "priority", team, date_from, vocab).orderBy(
        priority_rank(F.col("priority"), vocab), "priority")


def issues_table(issues: DataFrame, changelog: DataFrame | None, team: str | None = None,
                 date_from: object = None, vocab: Vocabulary = DEFAULT,
                 ordered: bool = True, completed: DataFrame | None = None) -> DataFrame:
    """Detail rows with team, ISO week and the last completion day."""
    created = F.col("created")
    done = last_completed(changelog, vocab) if completed is None else completed.select(
        "issue_key", F.col("last_completed_date").alias("completed_date"))
    rows = issues.filter(issue_filter(team=team, date_from=date_from, vocab=vocab))
    dated = rows.join(done, F.col("key") == F.col("issue_key"), "left")
    return (
        sort_if(dated, ordered, F.desc_nulls_last("created"), "key")
        .select(
            "key", "summary", "status", "status_category", "priority", "assignee", "sprint_name",
            team_of(rule=vocab.team_rule).alias("team"),
            "reported_sp",
            created.cast("date").alias("created_date"),
            iso_week_label(created).alias("week_label"),
            "completed_date",
            "updated",
        )
    )


def sprint_column_sums(vocab: Vocabulary = DEFAULT) -> list[Column]:
    """Counts and story points by status category, shared by the sprint reports."""
    category, sp = F.col("status_category"), F.col("reported_sp")
    return [
        F.count("*").alias("total_issues"),
        F.count_if(category == vocab.done).alias("done_issues"),
        F.count_if(category == vocab.in_progress).alias("in_progress_issues"),
        F.count_if(category == vocab.todo).alias("todo_issues"),
        round_sp(F.sum(sp)).alias("total_sp"),
        round_sp(sum_if(category == vocab.done, sp)).alias("done_sp"),
        round_sp(sum_if(category == vocab.in_progress, sp)).alias("in_progress_sp"),
        round_sp(sum_if(category == vocab.todo, sp)).alias("todo_sp"),
    ]
