from __future__ import annotations

import pytest

from sprintloom.operators import reports as r, sprint_reports as s
from sprintloom.plans.dashboard import dashboard
from tests.conftest import at, day, dicts, tuples


@pytest.fixture(scope="module")
def issues(make):
    return make.issues(
        dict(key="a", reported_sp=2.0, status_category="完了", created=at("2025-01-06")),
        dict(key="b", reported_sp=3.0, assignee="bob", sprint_name="S1 ScrumB", created=at("2025-01-20")),
        dict(key="c", reported_sp=0.0, status_category="進行中", created=at("2025-02-01")),
        dict(key="d", reported_sp=5.0, assignee=None, board_name="AI Board", created=at("2025-02-02")),
        dict(key="e", reported_sp=1.5, assignee="bob", board_name="AI Board", status_category="完了",
             sprint_id=2, sprint_name=None, created=at("2025-02-03")),
        dict(key="f", reported_sp=None, assignee="cy", status_category=None, sprint_id=3, created=at("2025-01-06T10:00")))


@pytest.fixture(scope="module")
def changes(make):
    return make.changes(
        dict(issue_key="a", created=at("2025-01-08")), dict(issue_key="a", created=at("2025-03-03")),
        dict(issue_key="b", created=at("2025-01-22"), to_string="Resolved"),
        dict(issue_key="b", created=at("2025-01-22T18:00"), to_string="Closed"),
        dict(issue_key="c", created=at("2025-01-23")), dict(issue_key="d", created=at("2025-01-23")),
        dict(issue_key="e", created=at("2025-01-05")),
        # an issue that is not stored still sets the newest completion week
        dict(issue_key="gone", created=at("2025-02-05")))


def test_velocity_by_team(issues, changes):
    assert tuples(r.velocity_by_team(issues, changes)) == [
        (day("2024-12-30"), "2025-W01", "AI&Analytics", 1.5, 1),
        (day("2025-01-06"), "2025-W02", "A Scrum", 2.0, 1),
        (day("2025-01-20"), "2025-W04", "B Scrum", 3.0, 1)]
    assert len(tuples(r.velocity_by_team(issues, changes, "2025-01-09"))) == 1


def test_individual_velocity(issues, changes):
    got = [row[2:] for row in tuples(r.individual_velocity(issues, changes, day("2025-01-01")))]
    assert got == [("bob", "AI&Analytics", 1.5, 1), ("ann", "A Scrum", 2.0, 1), ("bob", "B Scrum", 3.0, 1)]


def test_given_completions_are_used(issues, changes, spark):
    done = spark.createDataFrame([("b", day("2025-05-05"))], "issue_key string, completed_date date")
    assert tuples(r.velocity_by_team(issues, None, completed=done))[0][0] == day("2025-05-05")


def test_leaderboards(issues, changes):
    assert tuples(r.leaderboard(issues)) == [("bob", 2, 4.5), ("ann", 2, 2.0), ("cy", 1, None)]
    assert tuples(r.leaderboard(issues, "Main Board", "2025-01-07")) == [("bob", 1, 3.0), ("ann", 1, 0.0)]
    # Newest completion week starts on 2025-02-03; two weeks earlier is 2025-01-20.
    assert tuples(r.leaderboard_last_week(issues, changes)) == []
    assert tuples(r.leaderboard_last_3_weeks(issues, changes)) == [("bob", 1, 3.0), ("ann", 1, 0.0)]
    assert tuples(r.leaderboard_last_3_weeks(issues, changes, "AI Board")) == []


def test_team_summary(issues):
    assert tuples(r.team_summary(issues)) == [
        ("A Scrum", 3, 2.0, 2.0, 100.0, 2), ("AI&Analytics", 2, 6.5, 1.5, 23.1, 1), ("B Scrum", 1, 3.0, 0.0, 0.0, 1)]
    assert [row[0] for row in tuples(r.team_summary(issues, "2025-02-02"))] == ["AI&Analytics"]
    only_zero = issues.filter("key = 'c'")
    assert tuples(r.team_summary(only_zero)) == [("A Scrum", 1, 0.0, 0.0, None, 1)]


def test_recent_trend_spans_nine_weeks_inclusive(make):
    weeks = ["2025-01-06", "2025-01-13", "2025-03-10", "2025-03-03"]
    issues = make.issues(*[dict(key=w) for w in weeks])
    changes = make.changes(*[dict(issue_key=w, created=at(w)) for w in weeks])
    assert [row[0] for row in tuples(r.recent_velocity_trend(issues, changes))] == [
        day("2025-01-13"), day("2025-03-03"), day("2025-03-10")]


def test_assignee_load_counts_back_from_the_newest_issue(issues):
    got = tuples(r.assignee_load(issues))
    # The window starts 2025-01-06 00:00, four weeks before 2025-02-03.
    assert got == [("bob", "B Scrum", 1, 3.0, 0, 0), ("ann", "A Scrum", 2, 2.0, 1, 1),
                   ("bob", "AI&Analytics", 1, 1.5, 1, 0), ("cy", "A Scrum", 1, None, 0, 0)]
    assert len(tuples(r.assignee_load(issues, "B Scrum"))) == 1


def test_breakdowns(issues, make):
    assert sorted(map(str, tuples(r.status_breakdown(issues)))) == sorted(map(str, [
        ("完了", 2, 3.5), ("To Do", 2, 8.0), ("進行中", 1, 0.0), (None, 1, None)]))
    mixed = make.issues(*[dict(key=str(i), priority=p) for i, p in enumerate(
        ["Low", "Highest", "Odd", "High", "High", None])])
    assert [row[:2] for row in tuples(r.priority_breakdown(mixed))][:3] == [("Highest", 1), ("High", 2), ("Low", 1)]


def test_issues_table_shows_the_last_completion(issues, changes):
    rows = dicts(r.issues_table(issues, changes))
    assert [row["key"] for row in rows] == ["e", "d", "c", "b", "f", "a"]
    assert rows[-1]["completed_date"] == day("2025-03-03") and rows[4]["completed_date"] is None
    assert (rows[0]["week_label"], rows[0]["created_date"]) == ("2025-W06", day("2025-02-03"))
    assert [row["key"] for row in dicts(r.issues_table(issues, changes, "全チーム", "2025-02-02"))] == ["e", "d"]


def test_issues_with_scores(issues, make):
    scores = make.scores(dict(issue_key="b", clarity_score=0.5, complexity_reasoning="why"))
    got = {row["key"]: row["clarity_score"] for row in dicts(r.issues_with_scores(issues, scores))}
    assert got["b"] == 0.5 and got["a"] is None and len(got) == 6


def test_weekly_family(make):
    weekly = make.weekly(
        dict(week_start=day("2025-01-06"), reported_sp=2.0), dict(week_start=day("2025-01-06"), assignee="bob"),
        dict(week_start=day("2025-01-06"), board_name="AI Board", reported_sp=4.0, issue_count=3),
        dict(week_start=day("2025-01-13")))
    assert tuples(r.weekly_board_metrics(weekly)) == [
        (day("2025-01-06"), "AI Board", 4.0, 3), (day("2025-01-06"), "Main Board", 3.0, 2), (day("2025-01-13"), "Main Board", 1.0, 1)]
    assert tuples(r.weekly_assignee_metrics(weekly, "AI Board")) == [(day("2025-01-06"), "ann", 4.0, 3)]
    assert len(tuples(r.weekly_assignee_metrics(weekly))) == 3
    assert tuples(r.weekly_total(weekly)) == [(day("2025-01-06"), 7.0, 5), (day("2025-01-13"), 1.0, 1)]


def test_sufficiency(make, spark):
    weekly = make.weekly(*[dict(week_start=day(f"2025-01-{d:02d}"), reported_sp=float(sp)) for d, sp in ((6, 90), (13, 1), (20, 2), (27, 4))])
    future = spark.createDataFrame([(5.0,)], "future_sp double")
    assert tuples(r.avg_recent_velocity(weekly)) == [(7.0 / 3,)]
    assert tuples(r.sufficiency(weekly, future)) == [(5.0, 7.0 / 3, 214.3)]
    assert tuples(r.sufficiency(weekly.limit(0), future)) == [(5.0, 0.0, 0.0)]
    history = make.history((day("2025-01-01"), 1.0, 1.0, 1.0), (day("2025-01-09"), 2.0, 2.0, 2.0))
    assert tuples(r.latest_sufficiency(history))[0][0] == day("2025-01-09")


# ── sprint reports ──────────────────────────────────────────────────────────────────────────


@pytest.fixture(scope="module")
def sprints(make):
    return make.sprints(
        dict(sprint_id=1, sprint_name="S1 ScrumA"), dict(sprint_id=2, sprint_name="S2", state="future"),
        dict(sprint_id=3, sprint_name="S3", state="closed", planned_sp_snapshot=10.0))


def test_achievement_and_carry_over(make):
    issues = make.issues(
        dict(key="done", reported_sp=4.0, status_category="完了"), dict(key="carried", reported_sp=2.0),
        dict(key="open", reported_sp=1.0), dict(key="zero", reported_sp=0.0),
        dict(key="unknown", reported_sp=3.0, status_category=None))
    bridge = make.bridge(
        ("S1", "done"), ("S2", "done"), ("S1", "carried"), ("S2", "carried"), ("S1", "open"), ("S1", "zero"),
        ("S2", "zero"), ("S1", "unknown"), ("S2", "unknown"), ("S2", "not stored"))
    sprints = make.sprints(dict(sprint_id=2, sprint_name="S2", planned_sp_snapshot=20.0))
    assert tuples(s.sprint_achievement(issues, bridge, sprints)) == [
        ("S1", "A Scrum", 4, 10.0, 4.0, 2.0, 1, 40.0), ("S2", "A Scrum", 3, 20.0, 4.0, 2.0, 1, 20.0)]
    assert tuples(s.sprint_achievement(issues, bridge, sprints, "B Scrum")) == []
    assert tuples(s.sprint_achievement_timeline(issues, bridge)) == [
        (day("2025-01-06"), "A Scrum", 19.0, 8.0, 4.0, 42.1)]
    zero_snapshot = make.sprints(dict(sprint_name="S1", planned_sp_snapshot=0.0))
    assert tuples(s.sprint_achievement(issues, bridge, zero_snapshot))[0][3:] == (0.0, 4.0, 2.0, 1, None)
    assert dict(tuples(s.sprint_total_sp(issues, bridge))) == {"S1": 10.0, "S2": 9.0}


def test_equal_sprint_names_repeat_the_row(make):
    twice = make.sprints(dict(sprint_id=1, sprint_name="S"), dict(sprint_id=2, sprint_name="S", planned_sp_snapshot=2.0))
    got = tuples(s.sprint_achievement(make.issues({}), make.bridge(("S", "T-1")), twice))
    assert sorted(row[3] for row in got) == [1.0, 2.0]


def test_registry(make, sprints):
    meta = make.metadata(dict(sprint_id=1, start_date="2025-01-01"), dict(sprint_id=9))
    got = {row["sprint_id"]: row for row in dicts(s.sprint_registry(sprints, meta))}
    assert set(got) == {1, 2, 3} and got[1]["start_date"] == "2025-01-01"
    assert got[3]["planned_sp_snapshot"] == 10.0 and got[3]["start_date"] is None


def test_running_sprints(issues, changes, sprints, make):
    assert tuples(s.active_sprints_progress(issues, sprints)) == [
        ("S1 ScrumA", "A Scrum", "active", 2, 1, 2.0, 2.0), ("S2", "AI&Analytics", "future", 1, 1, 1.5, 1.5),
        ("S1 ScrumA", "AI&Analytics", "active", 1, 0, 5.0, 0.0), ("S1 ScrumA", "B Scrum", "active", 1, 0, 3.0, 0.0)]
    meta = make.metadata(dict(start_date="2025-01-01", end_date="2025-01-14"))
    details = dicts(s.active_sprint_details(issues, sprints, meta))
    assert [d["team"] for d in details] == ["A Scrum", "AI&Analytics", "B Scrum"]
    assert (details[0]["start_date"], details[0]["in_progress_issues"], details[0]["todo_sp"]) == ("2025-01-01", 1, 0.0)
    assert tuples(s.sprint_daily_burndown(issues, sprints, changes)) == [
        ("S1 ScrumA", "A Scrum", day("2025-01-08"), 2.0, 1),
        ("S1 ScrumA", "B Scrum", day("2025-01-22"), 6.0, 2),  # closed twice that day
        ("S1 ScrumA", "A Scrum", day("2025-01-23"), 0.0, 1),
        ("S1 ScrumA", "AI&Analytics", day("2025-01-23"), 5.0, 1),
        ("S1 ScrumA", "A Scrum", day("2025-03-03"), 2.0, 1)]
    workload = dicts(s.sprint_member_workload(issues, sprints))
    assert [(w["team"], w["assignee"], w["total_sp"]) for w in workload] == [("A Scrum", "ann", 2.0), ("B Scrum", "bob", 3.0)]


def test_active_issue_lists(make, sprints):
    issues = make.issues(
        dict(key="top", priority="Highest", updated=at("2025-01-09")), dict(key="word", summary="優先 x", reported_sp=9.0),
        dict(key="high", priority="High"), dict(key="flag", flagged=True), dict(key="plain", updated=at("2025-01-08")),
        dict(key="done", priority="High", status_category="完了"), dict(key="null", priority="High", status_category=None),
        dict(key="other", priority="High", sprint_id=3))
    changes = make.changes(dict(issue_key="done", created=at("2025-01-09")), dict(issue_key="done", created=at("2025-01-08")))
    rows = {row["key"]: row for row in dicts(s.active_sprint_issues(issues, sprints, changes, "2025-01-10"))}
    assert list(rows)[:2] == ["top", "word"] and "other" not in rows
    assert (rows["done"]["completed_date"], rows["top"]["days_since_update"]) == (day("2025-01-08"), 1)
    assert [k for k, v in rows.items() if v["is_high_priority"]] == ["top", "word", "done", "high", "null"]
    assert [row["key"] for row in dicts(s.high_priority_issues(issues, sprints, "2025-01-10"))] == ["top", "high", "flag", "word"]
    assert [row["key"] for row in dicts(s.stalled_issues(issues, sprints, "2025-01-10"))] == ["word", "flag", "high"]
    assert len(dicts(s.stalled_issues(issues, sprints, "2025-01-10", days=1))) == 5


# ── every report on nothing ─────────────────────────────────────────────────────────────────


def test_reports_on_empty_tables(make):
    tables = {
        "issues": make.issues(), "issue_changelog": make.changes(), "synced_sprints": make.sprints(),
        "sprint_issues": make.bridge(), "sprint_metadata": make.metadata(), "sufficiency_snapshots": make.history()}
    for name, frame in dashboard(tables, "2025-01-10").items():
        assert frame.count() == 0, name
    for frame in (r.weekly_total(make.weekly()), r.weekly_board_metrics(make.weekly()),
                  r.weekly_assignee_metrics(make.weekly()), r.priority_breakdown(make.issues()),
                  r.issues_with_scores(make.issues(), make.scores()), r.closed_sprint_ids(make.sprints()),
                  s.sprint_registry(make.sprints(), make.metadata()), s.sprint_total_sp(make.issues(), make.bridge())):
        assert frame.count() == 0
    assert tuples(r.issue_count(make.issues())) == [(0,)]
    assert tuples(r.avg_recent_velocity(make.weekly())) == [(0.0,)]
