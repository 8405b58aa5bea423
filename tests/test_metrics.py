from __future__ import annotations

import datetime as dt

import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st

from sprintloom.operators import metrics as d, scoring as a
from tests.conftest import at, day, dicts, tuples

VELOCITY = "week_start date, week_label string, team string, done_sp double, issue_count bigint"
INDIVIDUAL = "week_start date, week_label string, assignee string, team string, done_sp double, issue_count bigint"
RECENT = "week_start date, team string, done_sp double"


def weeks(n, first="2025-01-06"):
    return [day(first) + dt.timedelta(weeks=i) for i in range(n)]


def recent(spark, **teams):
    rows = [(w, team, float(sp)) for team, sps in teams.items() for w, sp in zip(weeks(len(sps)), sps)]
    return spark.createDataFrame(rows, RECENT)


def test_overall_kpis(spark):
    teams = spark.createDataFrame([("A", 2, 10.0, 4.0), ("B", 1, 5.0, 1.0)],
                                  "team string, total_issues bigint, total_sp double, done_sp double")
    velocity = spark.createDataFrame(
        [(weeks(2)[0], "w", "A", 2.0, 1), (weeks(2)[0], "w", "B", 1.0, 1), (weeks(2)[1], "w", "A", 5.0, 1)], VELOCITY)
    assert dicts(d.overall_kpis(teams, velocity)) == [dict(
        total_sp=15.0, done_sp=5.0, completion_pct=33.3, total_issues=3, avg_weekly_velocity=4.0)]
    assert dicts(d.overall_kpis(teams, velocity.limit(0)))[0]["avg_weekly_velocity"] == 0.0
    assert d.overall_kpis(teams.limit(0), velocity).count() == 0


def test_trend_class(spark):
    got = {r["team"]: r for r in dicts(d.trend_class(recent(
        spark, up=[1, 1, 1, 2, 2, 2], down=[4, 4, 4, 3], flat=[10, 10, 10, 10.1], one=[7], two=[1, 3], zero=[0, 0, 0])))}
    assert (got["up"]["recent_avg"], got["up"]["change_pct"], got["up"]["trend"]) == (2.0, 100.0, "improving")
    assert got["down"]["trend"] == "declining" and got["flat"]["trend"] == "stable"
    assert (got["one"]["recent_avg"], got["one"]["change_pct"]) == (7.0, 0.0)
    assert got["two"]["change_pct"] == 0.0 and got["zero"]["change_pct"] == 0.0


def test_week_over_week(spark):
    got = {r["team"]: r for r in dicts(d.week_over_week(recent(
        spark, up=[1, 2, 3], down=[9, 10, 5], flat=[10, 11], one=[7], zero=[0, 5])))}
    assert (got["up"]["diff_sp"], got["up"]["change_pct"], got["up"]["direction"]) == (1.0, 50.0, "up")
    assert (got["down"]["direction"], got["flat"]["direction"]) == ("down", "flat")
    assert (got["one"]["last_sp"], got["one"]["prev_week"], got["one"]["diff_sp"]) == (7.0, None, 0.0)
    assert (got["zero"]["change_pct"], got["zero"]["diff_sp"]) == (0.0, 5.0)


@settings(max_examples=8, deadline=None)
@given(st.dictionaries(st.sampled_from("ABC"), st.lists(st.integers(0, 40), min_size=1, max_size=8), min_size=1))
def test_moving_average_property(spark, teams):
    rows = [(w, "w", t, sp / 2, 1) for t, sps in teams.items() for w, sp in zip(weeks(len(sps)), sps)]
    got = {(r["team"], r["week_start"]): r["moving_avg"] for r in dicts(
        d.moving_average(spark.createDataFrame(rows, VELOCITY)))}
    for team, sps in teams.items():
        rolled = pd.Series([s / 2 for s in sps]).rolling(3).mean()
        for week, value in zip(weeks(len(sps)), rolled):
            assert got[team, week] == (None if pd.isna(value) else pytest.approx(value))


def test_team_velocity_stats(spark):
    rows = [(w, "w", "A", sp, 1) for w, sp in zip(weeks(2), (1.0, 4.0))]
    assert tuples(d.team_velocity_stats(spark.createDataFrame(rows, VELOCITY))) == [("A", 5.0, 2.5)]


def test_sprint_health(spark):
    progress = spark.createDataFrame(
        [("S1", "A", "active", 10.0, 6.0), ("S1", "B", "active", 10.0, 5.99), ("S1", "C", "active", 0.0, 0.0),
         ("S2", "A", "future", 1.0, 1.0)], "sprint_name string, team string, state string, total_sp double, done_sp double")
    assert [(r["team"], r["done_pct"], r["on_track"]) for r in dicts(d.sprint_health(progress))] == [
        ("A", 60.0, True), ("B", 59.9, False), ("C", 0.0, False)]


def test_achievement_metrics(spark):
    df = spark.createDataFrame(
        [("S1", "A", 10.0, 5.0, 2.0, 1, 50.0), ("S1", "B", 5.0, 5.0, 0.0, 0, 100.0), ("S2", "A", 0.0, 0.0, 1.0, 1, None)],
        "sprint_name string, team string, planned_sp double, done_sp double, carryover_sp double, "
        "carryover_count bigint, achievement_pct double")
    assert tuples(d.achievement_kpis(df)) == [(15.0, 10.0, 3.0, 2, 66.7)]
    assert tuples(d.achievement_kpis(df.limit(0)))[0][-1] == 0.0
    assert tuples(d.achievement_by_sprint(df)) == [("S1", 15.0, 10.0, 2.0, 1, 75.0), ("S2", 0.0, 0.0, 1.0, 1, None)]
    assert [r["carryover_pct"] for r in dicts(d.carryover_rate(df))] == [20.0, 0.0, 0.0]


def test_load_metrics(spark):
    load = spark.createDataFrame(
        [("ann", "A", 2, 50.0), ("bob", "A", 1, 30.0), ("ann", "B", 1, 30.0), ("cy", "C", 1, 20.0), ("di", "D", 1, 10.0),
         ("ed", "E", 1, 9.5)], "assignee string, team string, issue_count bigint, total_sp double")
    assert tuples(d.load_per_member(load)) == [(149.5, 5, 29.9)]
    assert tuples(d.load_per_member(load.limit(0))) == [(0.0, 0, 0.0)]
    got = {r["team"]: (r["members"], r["sp_per_member"], r["load_class"], r["load_pct"]) for r in dicts(d.team_load_class(load))}
    assert got == {"A": (2, 40.0, "overload", 100.0), "B": (1, 30.0, "high", 75.0), "C": (1, 20.0, "optimal", 50.0),
                   "D": (1, 10.0, "fair", 25.0), "E": (1, 9.5, "low", 23.75)}


def test_status_share(spark):
    df = spark.createDataFrame([("完了", 3, 6.0), ("To Do", 1, 2.0)], "status_category string, count bigint, sp double")
    assert dict((r[0], r[2]) for r in tuples(d.status_share(df))) == {"完了": 75.0, "To Do": 25.0}


@pytest.fixture(scope="module")
def individual(spark):
    w1, w2 = weeks(2)
    return spark.createDataFrame([
        (w1, "2025-W02", "ann", "A", 2.0, 1), (w2, "2025-W03", "ann", "A", 5.0, 2), (w1, "2025-W02", "ann", "B", 1.0, 1),
        (w1, "2025-W02", "bob", "A", 8.0, 3)], INDIVIDUAL)


def test_means(individual):
    # ann: (2 + 5 + 1) / 3, bob: 8 — idle weeks do not count.
    assert tuples(d.assignee_mean_velocity(individual))[0][0] == pytest.approx((8 / 3 + 8) / 2)
    assert dict(tuples(d.team_mean_velocity(individual))) == {"A": (3.5 + 8) / 2, "B": 1.0}
    kpis = dicts(d.individual_kpis(individual, ["ann"]))[0]
    assert (kpis["assignees"], kpis["total_sp"]) == (1, 8.0)
    assert kpis["mean_individual_velocity"] == pytest.approx(8 / 3)
    assert kpis["overall_mean"] == pytest.approx(16 / 3)


def test_comparison_rounds_after_and_summary_before_subtracting(individual):
    comparison = {(r["assignee"], r["team"]): r for r in dicts(d.assignee_comparison(individual))}
    ann = comparison["ann", "A"]
    assert (ann["weekly_mean"], ann["team_mean"], ann["diff_team"], ann["overall_mean"], ann["diff_overall"]) == (
        3.5, 5.8, -2.3, 5.3, -1.8)
    assert [comparison[k]["standing"] for k in (("ann", "A"), ("ann", "B"), ("bob", "A"))] == ["near", "below", "above"]
    assert len(dicts(d.assignee_comparison(individual, ["bob"]))) == 1
    summary = dicts(d.assignee_summary(individual))
    assert [(r["assignee"], r["team"], r["total_sp"], r["active_weeks"]) for r in summary] == [
        ("bob", "A", 8.0, 1), ("ann", "A", 7.0, 2), ("ann", "B", 1.0, 1)]
    assert summary[1]["diff_team"] == -2.3  # 3.5 - 5.8


def test_ranking_pivot_and_weekly(individual):
    assert tuples(d.assignee_ranking(individual, 1)) == [("ann", 8.0)]
    pivot = d.velocity_pivot(individual, ["2025-W02", "2025-W03", "2025-W04"])
    assert pivot.columns == ["assignee", "2025-W02", "2025-W03", "2025-W04", "other"]
    assert tuples(pivot) == [("ann", 3.0, 5.0, 0.0, 0.0), ("bob", 8.0, 0.0, 0.0, 0.0)]
    # A week that is not listed is not lost.
    assert sorted(tuples(d.velocity_pivot(individual, ["2025-W02"]))) == [("ann", 3.0, 5.0), ("bob", 8.0, 0.0)]
    assert d.velocity_pivot(individual).columns == ["assignee", "2025-W02", "2025-W03"]
    assert len(tuples(d.weekly_by_assignee_team(individual))) == 4


@pytest.mark.parametrize("pct, level", [(69.94, "red"), (69.96, "yellow"), (99.9, "yellow"), (99.96, "green"), (150.0, "green")])
def test_sufficiency_level(make, pct, level):
    assert dicts(d.sufficiency_level(make.history((day("2025-01-01"), 1.0, 1.0, pct))))[0]["level"] == level


# ── scoring ─────────────────────────────────────────────────────────────────────────────────


def test_comment_threads_are_in_order(make):
    comments = make.comments(
        dict(id="3", body="last", created=at("2025-02-01")), dict(id="2", body="b", created=at("2025-01-10T08:00")),
        dict(id="1", body="a", author="bob", created=at("2025-01-10T08:00")), dict(id="9", issue_key="T-2", body="x"))
    assert sorted(tuples(a.comment_threads(comments))) == [
        ("T-1", "- bob: a\n- ann: b\n- ann: last"), ("T-2", "- ann: x")]


def test_prompts_fill_gaps(make):
    issues = make.issues(dict(key="a", assignee=None, description=None), dict(key="b", description="long 100% text"))
    got = {row[0]: row[1] for row in tuples(a.scoring_prompts(
        issues, make.comments(dict(id="1", issue_key="b")), "%s|%s|%s|%s|%s|%s|%s"))}
    assert got == {"a": "a|work|1.0|To Do|Unassigned|(no description)|(no comments)",
                   "b": "b|work|1.0|To Do|ann|long 100% text|- ann: hi"}


def test_scoring_survives_failures(spark):
    prompts = spark.createDataFrame([("a", "fine"), ("b", "boom"), ("c", "off")], "issue_key string, prompt string")

    def scorer(prompt):
        if prompt == "boom":
            raise RuntimeError("no answer")
        return "because", 7 if prompt == "off" else 1, "n"

    got = {r["issue_key"]: r for r in dicts(a.score_issues(prompts, scorer, "2025-01-01"))}
    assert (got["a"]["clarity_score"], got["a"]["analyzed_at"]) == (1.0, at("2025-01-01"))
    assert got["b"]["complexity_reasoning"] == "Analysis failed: no answer"
    assert got["b"]["clarity_score"] is None and got["b"]["clarity_notes"] is None
    assert got["c"]["complexity_reasoning"].startswith("Analysis failed: clarity score 7")


def test_mvp(make):
    issues = make.issues(dict(key="a", assignee="zoe", reported_sp=3.0), dict(key="b", assignee="ann", reported_sp=3.0))
    assert tuples(a.sprint_mvp(issues)) == [("ann", 3.0)]
