"""Metrics derived from the reports.

Windows here run over weekly rows of one team: their length is bounded by the calendar, not by
the number of issues. Joined averages are keyed by team; the team rule yields three teams, which
is the proven bound behind each broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.expressions import pct_or_zero, round_sp


def overall_kpis(team_summary: DataFrame, velocity: DataFrame) -> DataFrame:
    """All teams together, one row; without teams there is no row."""
    weekly = velocity.groupBy("week_start").agg(F.sum("done_sp").alias("sp"))
    mean = weekly.agg(F.coalesce(F.avg("sp"), F.lit(0.0))).scalar()
    total, done = F.sum("total_sp"), F.sum("done_sp")
    return team_summary.agg(
        total.alias("total_sp"), done.alias("done_sp"),
        pct_or_zero(done, total).alias("completion_pct"),
        F.sum("total_issues").alias("total_issues"),
        F.count("*").alias("_teams"),
    ).filter(F.col("_teams") > 0).drop("_teams").withColumn("avg_weekly_velocity", mean)


def _class(value: Column, limit: float, above: str, below: str, between: str) -> Column:
    return F.when(value > limit, above).when(value < -limit, below).otherwise(between)


def trend_class(recent: DataFrame) -> DataFrame:
    """Mean of the last 3 weeks against the first 3 present, per team."""
    by_team = Window.partitionBy("team")
    ranked = recent.select(
        "team", "done_sp",
        F.row_number().over(by_team.orderBy("week_start")).alias("first"),
        F.row_number().over(by_team.orderBy(F.desc("week_start"))).alias("last"),
    )
    older, newer = F.col("older_avg"), F.col("recent_avg")
    means = ranked.groupBy("team").agg(
        F.count("*").alias("weeks"),
        F.avg(F.when(F.col("last") <= 3, F.col("done_sp"))).alias("recent_avg"),
        F.avg(F.when(F.col("first") <= 3, F.col("done_sp"))).alias("older_avg"),
    )
    change = F.when(
        (F.col("weeks") >= 2) & (older > 0),
        (newer - older) / F.nullif(older, F.lit(0.0)) * 100).otherwise(0.0)
    return means.withColumn("change_pct", change).withColumn(
        "trend", _class(F.col("change_pct"), 5, "improving", "declining", "stable"))


def week_over_week(recent: DataFrame) -> DataFrame:
    """The last week of each team against the week before it."""
    by_team = Window.partitionBy("team")
    in_order = by_team.orderBy("week_start")
    rows = recent.select(
        "team",
        F.col("week_start").alias("last_week"),
        F.col("done_sp").alias("last_sp"),
        F.lag("week_start").over(in_order).alias("prev_week"),
        F.coalesce(F.lag("done_sp").over(in_order), F.lit(0.0)).alias("prev_sp"),
        F.row_number().over(by_team.orderBy(F.desc("week_start"))).alias("_from_end"),
    ).filter(F.col("_from_end") == 1)
    last, prev = F.col("last_sp"), F.col("prev_sp")
    both = F.col("prev_week").isNotNull()
    change = F.when(prev > 0, (last - prev) / F.nullif(prev, F.lit(0.0)) * 100).otherwise(0.0)
    return rows.select(
        "team", "last_week", "prev_week", "last_sp", "prev_sp",
        F.when(both, last - prev).otherwise(0.0).alias("diff_sp"),
        change.alias("change_pct"),
        _class(change, 10, "up", "down", "flat").alias("direction"),
    )


def team_velocity_stats(velocity: DataFrame) -> DataFrame:
    return velocity.groupBy("team").agg(
        F.sum("done_sp").alias("total_sp"), F.avg("done_sp").alias("avg_sp"))


def moving_average(velocity: DataFrame, n: int = 3) -> DataFrame:
    """Mean over ``n`` consecutive rows of a team; null until there are that many."""
    span = Window.partitionBy("team").orderBy("week_start").rowsBetween(1 - n, 0)
    mean = F.when(F.count("done_sp").over(span) == n, F.avg("done_sp").over(span))
    return velocity.select("week_start", "week_label", "team", "done_sp", mean.alias("moving_avg"))


def sprint_health(progress: DataFrame, on_track_from: float = 60) -> DataFrame:
    active = progress.filter(F.col("state") == "active")
    pct = pct_or_zero(F.col("done_sp"), F.col("total_sp"))
    return active.select(
        "sprint_name", "team", "total_sp", "done_sp", pct.alias("done_pct"),
        (pct >= on_track_from).alias("on_track"))


# ── achievement ─────────────────────────────────────────────────────────────────────────────


def achievement_kpis(achievement: DataFrame) -> DataFrame:
    planned, done = F.sum("planned_sp"), F.sum("done_sp")
    return achievement.agg(
        planned.alias("planned_sp"), done.alias("done_sp"),
        F.sum("carryover_sp").alias("carryover_sp"),
        F.sum("carryover_count").alias("carryover_count"),
        pct_or_zero(done, planned).alias("true_rate"),
    )


def achievement_by_sprint(achievement: DataFrame) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in ("planned_sp", "done_sp", "carryover_sp", "carryover_count")]
    return achievement.groupBy("sprint_name").agg(
        *sums, F.avg("achievement_pct").alias("achievement_pct")).orderBy("sprint_name")


def carryover_rate(achievement: DataFrame) -> DataFrame:
    share = F.col("carryover_sp") / F.nullif(F.col("planned_sp"), F.lit(0.0)) * 100
    return achievement.select(
        "sprint_name", "team", "planned_sp", "done_sp", "carryover_sp", "carryover_count",
        "achievement_pct", F.round(F.coalesce(share, F.lit(0.0)), 1).alias("carryover_pct"))


# ── load ────────────────────────────────────────────────────────────────────────────────────


def load_per_member(load: DataFrame) -> DataFrame:
    """Story points per distinct assignee over all teams, one row."""
    per_member = load.groupBy("assignee").agg(F.sum("total_sp").alias("sp"))
    total, members = F.coalesce(F.sum("sp"), F.lit(0.0)), F.count("assignee")
    return per_member.agg(
        total.alias("total_sp"), members.alias("members"),
        F.when(members > 0, total / F.nullif(members, F.lit(0))).otherwise(0.0).alias("sp_per_member"))


def team_load_class(load: DataFrame) -> DataFrame:
    """Load level of each team by story points per member; 40 fill the bar."""
    per_member = load.groupBy("team", "assignee").agg(
        F.sum("total_sp").alias("sp"), F.sum("issue_count").alias("n"))
    sums = per_member.groupBy("team").agg(
        F.sum("sp").alias("total_sp"), F.count("assignee").alias("members"),
        F.sum("n").alias("issues"))
    mean = F.coalesce(F.col("total_sp") / F.nullif(F.col("members"), F.lit(0)), F.lit(0.0))
    each = F.col("sp_per_member")
    return sums.withColumn("sp_per_member", mean).withColumn(
        "load_class",
        F.when(each >= 40, "overload").when(each >= 30, "high").when(each >= 20, "optimal")
        .when(each >= 10, "fair").otherwise("low"),
    ).withColumn("load_pct", F.least(each / 40 * 100, F.lit(100.0)))


def status_share(breakdown: DataFrame) -> DataFrame:
    """Each category's share of the story points. The total is a scalar subquery, not a window
    over everything, so no task has to hold all categories."""
    total = breakdown.agg(F.sum("sp")).scalar()
    return breakdown.select(
        "status_category", "sp",
        (F.col("sp") / F.nullif(total, F.lit(0.0)) * 100).alias("share_pct"))


# ── individual velocity ─────────────────────────────────────────────────────────────────────


def assignee_ranking(ind_vel: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` assignees with most completed work; a top-k, never a full sort."""
    return ind_vel.groupBy("assignee").agg(F.sum("done_sp").alias("total_sp")).orderBy(
        F.desc("total_sp"), "assignee").limit(k)


def assignee_mean_velocity(ind_vel: DataFrame) -> DataFrame:
    """Mean over the rows of each assignee, then the mean of those means, one row."""
    return ind_vel.groupBy("assignee").agg(F.avg("done_sp").alias("m")).agg(
        F.avg("m").alias("mean_velocity"))


def team_mean_velocity(ind_vel: DataFrame) -> DataFrame:
    """Mean over the rows of each (assignee, team), then per team: one row per team."""
    return ind_vel.groupBy("assignee", "team").agg(F.avg("done_sp").alias("m")).groupBy("team").agg(
        F.avg("m").alias("team_mean"))


def _selected(ind_vel: DataFrame, selected: Sequence[str] | None) -> DataFrame:
    return ind_vel if not selected else ind_vel.filter(F.col("assignee").isin(*selected))


def individual_kpis(ind_vel: DataFrame, selected: Sequence[str] | None = None) -> DataFrame:
    """Figures for the chosen assignees (nobody chosen means all) beside the overall mean."""
    per_assignee = _selected(ind_vel, selected).groupBy("assignee").agg(
        F.sum("done_sp").alias("sp"), F.avg("done_sp").alias("m"))
    return per_assignee.agg(
        F.count("assignee").alias("assignees"),
        F.sum("sp").alias("total_sp"),
        F.avg("m").alias("mean_individual_velocity"),
    ).withColumn("overall_mean", assignee_mean_velocity(ind_vel).scalar())


def _per_assignee_team(ind_vel: DataFrame, selected: Sequence[str] | None) -> DataFrame:
    return _selected(ind_vel, selected).groupBy("assignee", "team").agg(
        F.sum("done_sp").alias("total_sp"), F.sum("issue_count").alias("issue_count"),
        F.count("*").alias("active_weeks"), F.avg("done_sp").alias("_mean"),
    )


def _with_means(ind_vel: DataFrame, selected: Sequence[str] | None) -> DataFrame:
    """Per assignee and team, beside the team's and the overall mean over everybody.

    All three come from one aggregate. Every pair has an issue; saying so keeps the counts in each
    use of the aggregate, so their plans are equal and the work is done once.
    """
    pairs = _per_assignee_team(ind_vel, None).filter("issue_count > 0")
    by_team = pairs.groupBy("team").agg(F.avg("_mean").alias("team_mean"))
    by_assignee = pairs.groupBy("assignee").agg(
        (F.sum("total_sp") / F.sum("active_weeks")).alias("m"))
    return _selected(pairs, selected).join(
        F.broadcast(by_team), "team", "left",  # one row for each of three teams
    ).withColumn("_overall", by_assignee.agg(F.avg("m")).scalar())


def assignee_comparison(ind_vel: DataFrame, selected: Sequence[str] | None = None) -> DataFrame:
    """Weekly mean of each chosen assignee and team against the means; rounded after subtracting."""
    mean, team_mean, overall = F.col("_mean"), F.col("team_mean"), F.col("_overall")
    diff_overall = round_sp(mean - overall)
    return _with_means(ind_vel, selected).select(
        "assignee", "team",
        round_sp(mean).alias("weekly_mean"),
        round_sp(team_mean).alias("team_mean"),
        round_sp(mean - team_mean).alias("diff_team"),
        round_sp(overall).alias("overall_mean"),
        diff_overall.alias("diff_overall"),
        "total_sp", "issue_count",
        _class(diff_overall, 2, "above", "below", "near").alias("standing"),
    )


def assignee_summary(ind_vel: DataFrame, selected: Sequence[str] | None = None) -> DataFrame:
    """Totals per assignee and team; here the differences start from the rounded weekly mean."""
    weekly = round_sp(F.col("total_sp") / F.col("active_weeks"))
    team_mean, overall = round_sp(F.col("team_mean")), F.col("_overall")
    return _with_means(ind_vel, selected).select(
        "assignee", "team", "total_sp", "issue_count", "active_weeks",
        weekly.alias("weekly_mean"),
        team_mean.alias("team_mean"),
        round_sp(weekly - team_mean).alias("diff_team"),
        round_sp(overall).alias("overall_mean"),
        round_sp(weekly - overall).alias("diff_overall"),
    ).orderBy(F.desc("total_sp"), "assignee", "team")


OTHER_WEEKS = "other"


def velocity_pivot(ind_vel: DataFrame, labels: Sequence[str] | None = None) -> DataFrame:
    """Assignee × week matrix of story points, 0 where there is none, largest total first.

    Without labels the weeks are those of the data, which Spark looks up first; the calendar bounds
    them. With labels, points of any other week are in the column ``other``, so a row always adds
    up to the assignee's total.
    """
    if labels:
        listed = F.col("week_label").isin(*labels)
        ind_vel = ind_vel.withColumn("week_label", F.when(listed, F.col("week_label")).otherwise(OTHER_WEEKS))
    pivoted = ind_vel.groupBy("assignee").pivot("week_label", [*labels, OTHER_WEEKS] if labels else None)
    wide = pivoted.agg(F.sum("done_sp")).fillna(0.0)
    cells = [F.col(f"`{c}`") for c in wide.columns if c != "assignee"]
    total = F.aggregate(F.array(*cells), F.lit(0.0), lambda acc, x: acc + x) if cells else F.lit(0.0)
    return wide.orderBy(total.desc(), "assignee")


def weekly_by_assignee_team(ind_vel: DataFrame) -> DataFrame:
    return ind_vel.groupBy("assignee", "week_label", "team").agg(F.sum("done_sp").alias("done_sp"))


def sufficiency_level(latest: DataFrame) -> DataFrame:
    """Traffic light of the newest sufficiency figure."""
    pct = F.round("sufficiency", 1)
    return latest.select(
        "snapshot_date", "future_sp", "avg_velocity", pct.alias("sufficiency_pct"),
        F.when(pct < 70, "red").when(pct < 100, "yellow").otherwise("green").alias("level"))
