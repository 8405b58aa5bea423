from __future__ import annotations

import datetime as dt

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from sprintloom.functions import expressions as x
from sprintloom.vocab import TeamRule
from tests.conftest import at, day, dicts, tuples


def values(spark, expression, schema, *rows):
    return [r[0] for r in spark.createDataFrame(list(rows), schema).select(expression).collect()]


def test_team_rule_takes_first_match(spark):
    got = values(spark, x.team_of(), "board_name string, sprint_name string",
                 ("AI Board", "S1 ScrumB"), ("Main Board", "S1 ScrumB"), ("Main Board", "Scrum B 4"),
                 ("Main Board", "scrumb"), ("Main Board", None), (None, None))
    assert got == ["AI&Analytics", "B Scrum", "B Scrum", "A Scrum", "A Scrum", "A Scrum"]


def test_board_of_team():
    rule = TeamRule(main_board="M", ai_board="X")
    assert [rule.board_of(t) for t in (*rule.teams, None)] == ["M", "M", "X", None]


def test_week_and_label_match_the_iso_calendar(spark):
    days = [dt.date(2019, 12, 20) + dt.timedelta(days=i) for i in range(2300)]
    df = spark.createDataFrame([(d,) for d in days], "d date").select(
        "d", x.iso_week_label(F.col("d")), x.week_start(F.col("d")))
    for d, label, monday in tuples(df):
        year, week, weekday = d.isocalendar()
        assert label == f"{year}-W{week:02d}"
        assert monday == d - dt.timedelta(days=weekday - 1)


def test_safe_pct_rounds_half_up_and_survives_zero(spark):
    got = values(spark, x.safe_pct(F.col("n"), F.col("d")), "n double, d double",
                 (1.0, 3.0), (1.0, 0.0), (None, 2.0), (1.0, None), (0.125, 100.0), (0.25, 100.0))
    assert got == [33.3, None, None, None, 0.1, 0.3]


def test_high_priority_is_never_null(spark):
    got = values(spark, x.is_high_priority(F.col("s"), F.col("p")), "s string, p string",
                 ("緊急 x", "Low"), ("HotFix", "Low"), ("HOTFIX", None), (None, "High"), (None, None))
    assert got == [True, False, True, True, False]


def test_needs_attention_leaves_out_done_and_unknown_category(spark):
    df = spark.createDataFrame([
        ("a", "bug here", "Low", False, "To Do"), ("b", "bug here", "Low", False, "完了"),
        ("c", "bug here", "Low", False, None), ("d", "plain", "Low", True, "進行中"),
        ("e", "plain", "Low", None, "進行中"), ("f", None, "Highest", None, "進行中"),
    ], "key string, summary string, priority string, flagged boolean, status_category string")
    kept = df.filter(x.needs_attention(
        F.col("summary"), F.col("priority"), F.col("flagged"), F.col("status_category")))
    assert [r.key for r in kept.collect()] == ["a", "d", "f"]


def test_ranks(spark):
    rows = [("Highest",), ("High",), ("Medium",), ("Low",), ("Lowest",), ("Odd",), (None,)]
    assert values(spark, x.priority_rank(F.col("p")), "p string", *rows) == [1, 2, 3, 4, 5, 6, 6]
    got = values(spark, x.urgency_rank(F.col("p"), F.col("s")), "p string, s string",
                 ("Highest", ""), ("High", ""), ("Low", "優先"), (None, "緊急"), ("Low", "hotfix"))
    assert got == [1, 2, 2, 2, 3]


def test_issue_filter(make):
    issues = make.issues(
        dict(key="a", created=at("2025-01-01")), dict(key="b", sprint_name="S1 ScrumB"),
        dict(key="c", board_name="AI Board"))

    def keys(**given_):
        return [r.key for r in issues.filter(x.issue_filter(**given_)).collect()]

    assert keys() == keys(team="全チーム") == ["a", "b", "c"]
    assert keys(team="B Scrum") == ["b"]
    assert keys(board="Main Board", date_from="2025-01-02") == ["b"]
    assert keys(team="'; DROP TABLE issues; --") == []
    assert len(keys(date_from=dt.date(2025, 1, 1))) == 3


def test_period_start_never_reaches_behind_the_floor(spark):
    got = spark.range(1).select(
        x.period_start("2026-03-01", 28, "2025-12-08"), x.period_start("2026-03-01", 180, "2025-12-08"),
        x.period_start("2026-03-01", 0, "2025-12-08")).first()
    assert list(got) == [day("2026-02-01"), day("2025-12-08"), day("2025-12-08")]


def test_days_since_update_counts_calendar_days(spark):
    got = values(spark, x.days_since_update(F.col("u"), x.as_date("2025-01-10")), "u timestamp_ntz",
                 (at("2025-01-09T23:59:59"),), (at("2025-01-11T00:00:00"),), (None,))
    assert got == [1, -1, None]


def test_split_sprint_names_examples(spark):
    got = values(spark, x.split_sprint_names(F.col("n")), "n string",
                 ("S1, S2",), (" S1 ,  S2,",), ("チーム（コウ、ジョン）, S2",), ("a,b",), ("   ",), (None,), ("　S9　, x",))
    assert got == [["S1", "S2"], ["S1", "S2,"], ["チーム（コウ、ジョン）", "S2"], ["a,b"], [], [], ["S9", "x"]]


def test_strip_knows_every_white_space_character(spark):
    texts = [a + "x y" + b for a in ("", *x.WHITESPACE) for b in ("", *x.WHITESPACE)] + ["", *x.WHITESPACE, None]
    assert len(x.WHITESPACE) == 29
    got = values(spark, x.strip(F.col("n")), "n string", *[(t,) for t in texts])
    assert got == [t if t is None else t.strip() for t in texts]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab, \t　\x1c、", max_size=12), min_size=1, max_size=40))
def test_split_sprint_names_property(spark, texts):
    got = values(spark, x.split_sprint_names(F.col("n")), "n string", *[(t,) for t in texts])
    assert got == [[p.strip() for p in t.split(", ") if p.strip()] for t in texts]


def test_first_and_last_completion(make):
    changes = make.changes(
        dict(created=at("2025-01-12T08:00")), dict(created=at("2025-01-10T23:00")),
        dict(to_string="開発完了", created=at("2025-01-01")), dict(field="Sprint", created=at("2025-01-01")),
        dict(issue_key="T-2", to_string="完了", created=at("2025-02-01")),
        dict(issue_key="T-3", to_string=None))
    assert sorted(tuples(x.first_completed(changes))) == [
        ("T-1", day("2025-01-10")), ("T-2", day("2025-02-01"))]
    assert dict(tuples(x.last_completed(changes)))["T-1"] == day("2025-01-12")


def test_other_sprint_count(make):
    bridge = make.bridge(("S1", "a"), ("S2", "a"), ("S3", "a"), ("S1", "b"))
    got = {(r["sprint_name"], r["issue_key"]): r["other_sprint_count"] for r in dicts(x.other_sprint_count(bridge))}
    assert got == {("S1", "a"): 2, ("S2", "a"): 2, ("S3", "a"): 2, ("S1", "b"): 0}


def test_conditional_sums(spark):
    df = spark.createDataFrame([(True, 1.0), (False, 2.0), (None, 4.0)], "c boolean, v double")
    assert tuples(df.agg(x.sum_if(F.col("c"), F.col("v")), x.count_if(F.col("c")))) == [(1.0, 1)]


def test_planned_value_prefers_a_zero_snapshot(spark):
    got = values(spark, x.planned_value(F.col("s"), F.col("c")), "s double, c double",
                 (0.0, 5.0), (None, 5.0))
    assert got == [0.0, 5.0]
