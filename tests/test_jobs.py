"""Exports, plans and balance."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sprintloom.functions import skew
from sprintloom.functions.expressions import other_sprint_count
from sprintloom.operators import metrics, reports, scoring, sprint_reports
from sprintloom.plans.dashboard import dashboard, shared_completions, shared_memberships, shared_totals, shared_work
from sprintloom.plans.sync import run_scoring
from sprintloom.session import shared_dir, written
from sprintloom.sinks.export import csv_export, dashboard_export
from sprintloom.sources.tables import TableStore
from tests.conftest import at, day, plan, tuples


@pytest.fixture
def conf(spark):
    changed = []

    def set_(**values):
        for name, value in values.items():
            name = "spark.sql." + name.replace("__", ".")
            spark.conf.set(name, value)
            changed.append(name)
    yield set_
    for name in changed:
        spark.conf.unset(name)


def parts(path):
    return sorted(Path(path).glob("part-*"))


def test_dashboard_export(make, tmp_path):
    issues = make.issues(dict(key="a", status_category="完了"), dict(key="b"))
    tables = {
        "issues": issues, "issue_changelog": make.changes(dict(issue_key="a")), "synced_sprints": make.sprints({}),
        "sprint_issues": make.bridge(("S1 ScrumA", "a")), "sprint_metadata": make.metadata({}),
        "sufficiency_snapshots": make.history((day("2025-01-01"), 1.0, 1.0, 1.0))}
    results = dashboard(tables, "2025-01-20", "2025-01-01")
    folders = dashboard_export(results, str(tmp_path), "2025-01-20", "2025-01-01")
    assert len(folders) == 21
    read = {Path(f).name: [json.loads(line) for p in parts(f) for line in p.read_text("utf-8").splitlines()] for f in folders}
    assert read["velocity"] == [dict(week_start="2025-01-06", week_label="2025-W02", team="A Scrum", done_sp=1.0, issue_count=1)]
    assert read["meta"] == [dict(exportedAt="2025-01-20", dashboardStart="2025-01-01")]
    assert read["sufficiency"][0]["snapshot_date"] == "2025-01-01"
    assert [row["completed_date"] for row in read["activeSprintIssues"]] == ["2025-01-10", None]
    assert read["issues"][0]["updated"].startswith("2025-01-06")
    assert len(read["stalledIssues"]) == 1


def test_four_results_share_one_pass_over_the_issues(spark, make, tmp_path, conf):
    make.issues(*[dict(key=f"K{i}", assignee=("ann", "bob", None)[i % 3], sprint_name=("S ScrumA", "S ScrumB", None)[i % 4 % 3], reported_sp=(None, 1.0, 2.5)[i % 3],
                       status_category=("完了", "進行中", "To Do", None)[i % 4], created=None if i == 7 else at(f"2025-0{i % 4 + 1}-{i % 27 + 1:02d}"))
                  for i in range(60)]).write.parquet(str(tmp_path / "issues"))
    issues = spark.read.parquet(str(tmp_path / "issues"))
    tables = {"issues": issues, "issue_changelog": make.changes(), "synced_sprints": make.sprints(), "sprint_issues": make.bridge(),
              "sprint_metadata": make.metadata(), "sufficiency_snapshots": make.history()}
    plain = dashboard(tables, "2025-05-01", "2025-02-01")
    shared = dashboard(tables, "2025-05-01", "2025-02-01", totals=shared_totals(issues, "2025-02-01"))
    for name in ("leaderboard", "teamSummary", "statusBreakdown", "assigneeLoad"):
        assert tuples(shared[name]) == tuples(plain[name]) != [], name
        assert "/issues" not in plan(shared[name])
    conf(adaptive__enabled="false")
    text = plan(reports.issue_totals(issues, "2025-02-01"))
    wide = [scan for scan in re.findall(r"FileScan parquet \[([^\]]*)\]", text) if scan.count("#") > 1]
    assert len(wide) == 1 and "description" not in text  # the other scan finds the newest creation time


def test_seven_results_share_one_join_of_the_bridge_and_one_of_the_completions(spark, make, tmp_path):
    make.issues(*[dict(key=f"K{i}", assignee=("ann", "bob", None)[i % 3], sprint_name=("S ScrumA", "S ScrumB", None)[i % 4 % 3], reported_sp=(None, 1.0, 2.5, 0.0)[i % 4],
                       status_category=("完了", "To Do", None)[i % 5 % 3], created=None if i == 7 else at(f"2025-0{i % 4 + 1}-{i % 27 + 1:02d}"))
                  for i in range(60)]).write.parquet(str(tmp_path / "issues"))
    make.bridge(*[(f"S{j}", f"K{i}") for i in range(60) for j in range(i % 3)], ("S9", None), ("S9", "other")).write.parquet(str(tmp_path / "bridge"))
    issues, bridge = spark.read.parquet(str(tmp_path / "issues")), spark.read.parquet(str(tmp_path / "bridge"))
    changes = make.changes(*[dict(issue_key=f"K{i % 50}", created=None if i == 11 else at(f"2025-0{i % 3 + 1}-{i % 28 + 1:02d}")) for i in range(0, 70, 2)],
                           dict(issue_key="K11", created=None), dict(issue_key="gone", created=at("2025-04-20")))
    tables = {"issues": issues, "issue_changelog": changes, "synced_sprints": make.sprints(dict(sprint_name="S0", planned_sp_snapshot=9.0)),
              "sprint_issues": bridge, "sprint_metadata": make.metadata(), "sufficiency_snapshots": make.history()}
    plain = dashboard(tables, "2025-05-01", "2025-02-01")
    completed = shared_completions(changes)
    shared = dashboard(tables, "2025-05-01", "2025-02-01", completed=completed, members=shared_memberships(issues, bridge),
                       work=shared_work(issues, completed))
    for name in ("velocity", "recentTrend", "individualVelocity", "leaderboardPeriods.last_week", "leaderboardPeriods.last_3_weeks",
                 "sprintAchievement", "sprintAchievementTimeline"):
        assert tuples(shared[name]) == tuples(plain[name]), name
        assert shared[name].dtypes == plain[name].dtypes and (tuples(shared[name]) or "leaderboard" in name), name
        assert "/issues" not in plan(shared[name]) and "/bridge" not in plan(shared[name])


def test_csv_has_header_and_mark_in_every_part(spark, tmp_path):
    df = spark.createDataFrame([("完了, \"x\"", 1.5, day("2025-01-01")), (None, 2.0, None)], "a string, b double, c date")
    csv_export(df.repartition(2), str(tmp_path / "m"))
    for part in parts(tmp_path / "m"):
        assert part.read_bytes().startswith(b"\xef\xbb\xbfa,b,c\n")
    text = "".join(p.read_text("utf-8-sig") for p in parts(tmp_path / "m"))
    assert '"完了, ""x""",1.5,2025-01-01' in text
    csv_export(df, str(tmp_path / "plain"), bom=False)
    assert parts(tmp_path / "plain")[0].read_bytes().startswith(b"a,b,c")


def test_shared_folder_comes_from_the_session(spark):
    assert shared_dir(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
    assert shared_dir(spark, "x") != shared_dir(spark, "x")
    df = written(spark.range(3), "numbers")
    assert df.count() == 3 and "FileScan" in plan(df)


# ── plans ───────────────────────────────────────────────────────────────────────────────────


@pytest.fixture(scope="module")
def stored(spark, make, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stored")
    make.issues({}).write.parquet(f"{folder}/issues")
    make.changes({}).write.parquet(f"{folder}/changes")
    return spark.read.parquet(f"{folder}/issues"), spark.read.parquet(f"{folder}/changes")


def test_filters_and_columns_reach_the_scans(stored):
    text = plan(reports.velocity_by_team(*stored))
    assert "EqualTo(field,status)" in text and "In(to_string" in text
    assert "GreaterThan(reported_sp,0.0)" in text and "IsNotNull(assignee)" in text
    assert "ReadSchema: struct<issue_key:string,field:string,to_string:string,created:timestamp_ntz>" in text
    assert "description" not in text and "summary" not in text


def test_velocity_shuffles_history_after_partial_aggregation(stored, conf):
    conf(autoBroadcastJoinThreshold="-1")
    text = plan(reports.velocity_by_team(*stored, ordered=False))
    assert text.count("Exchange hashpartitioning") == 3  # history, issues, final groups
    history = text[text.index("hashpartitioning(issue_key"):]
    assert history.index("partial_min") > 0


def test_no_report_uses_a_cross_join_or_python(stored, make):
    issues, changes = stored
    tables = {"issues": issues, "issue_changelog": changes, "synced_sprints": make.sprints({}),
              "sprint_issues": make.bridge(), "sprint_metadata": make.metadata(), "sufficiency_snapshots": make.history()}
    for name, frame in dashboard(tables, "2025-01-20").items():
        text = plan(frame)
        assert "Cartesian" not in text and "BroadcastNestedLoop" not in text, name
        assert "Python" not in text and "Pandas" not in text, name


# ── one issue or sprint with a third of all rows ────────────────────────────────────────────


def test_hot_issue_is_divided_and_results_stay_whole(spark, conf):
    conf(autoBroadcastJoinThreshold="-1", adaptive__coalescePartitions__enabled="false", shuffle__partitions="16")
    hot = spark.range(6000).select(F.concat(F.lit("S"), F.col("id")).alias("sprint_name"), F.lit("hot").alias("issue_key"))
    cold = spark.range(12000).select(F.concat(F.lit("S"), F.col("id") % 40).alias("sprint_name"),
                                     F.concat(F.lit("K"), F.floor(F.col("id") / 3)).alias("issue_key"))
    bridge = hot.unionByName(cold)
    joined = skew.counted_join(bridge, None, skew.key_counts(bridge), "sprint_name")
    where = joined.withColumn("task", F.spark_partition_id()).groupBy("issue_key").agg(
        F.count_distinct("task").alias("tasks"), F.count("*").alias("rows"))
    spread = {r.issue_key: (r.tasks, r.rows) for r in where.collect()}
    assert spread["hot"] == (16, 6000) and max(t for k, (t, _) in spread.items() if k != "hot") == 1
    got = other_sprint_count(bridge)
    expected = bridge.join(bridge.groupBy("issue_key").agg((F.count("*") - 1).alias("other_sprint_count")), "issue_key")
    assert got.exceptAll(expected.select(*got.columns)).count() == 0 and got.count() == 18000


def test_hot_sprint_is_split_by_the_join(spark, tmp_path, conf):
    issues = spark.range(60000).select(
        F.concat(F.lit("K"), F.col("id")).alias("key"), F.lit("Main Board").alias("board_name"),
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 500 + 2).cast("int").alias("sprint_id"),
        F.lit("S").alias("sprint_name"), F.sha2(F.col("id").cast("string"), 512).alias("summary"),
        F.lit("ann").alias("assignee"), F.lit(1.0).alias("reported_sp"), F.lit("To Do").alias("status"),
        F.lit("To Do").alias("status_category"), F.lit("High").alias("priority"), F.lit(False).alias("flagged"),
        F.lit("2025-01-01").cast("timestamp_ntz").alias("updated"))
    issues.repartition(8).write.parquet(str(tmp_path / "i"))
    spark.range(600).select(F.col("id").cast("int").alias("sprint_id"), F.lit("S").alias("sprint_name"),
                            F.lit("active").alias("state")).write.parquet(str(tmp_path / "s"))
    conf(autoBroadcastJoinThreshold="-1", adaptive__skewJoin__skewedPartitionThresholdInBytes="100KB",
         adaptive__advisoryPartitionSizeInBytes="100KB", adaptive__skewJoin__skewedPartitionFactor="2",
         shuffle__partitions="16")
    report = sprint_reports.stalled_issues(
        spark.read.parquet(str(tmp_path / "i")), spark.read.parquet(str(tmp_path / "s")), "2025-02-01")
    assert len(report.collect()) == 60000
    assert "skew=true" in plan(report)


def test_a_thread_of_any_length_is_one_row_one_prompt_and_one_score(spark, make):
    comments = spark.range(24_000).select(
        F.lpad(F.col("id").cast("string"), 5, "0").alias("id"),
        F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("K"), F.col("id") % 60)).alias("issue_key"),
        F.lit("ann").alias("author"), F.col("id").cast("string").alias("body"),
        F.when(F.col("id") >= 10, F.lit("2025-01-01").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("id").cast("int"))).alias("created"))
    threads = {r.issue_key: r.thread for r in scoring.comment_threads(comments).collect()}
    assert len(threads) == 31 and threads["hot"] == "\n".join(f"- ann: {i}" for i in range(0, 24_000, 2))
    prompts = scoring.scoring_prompts(make.issues(dict(key="hot"), dict(key="none")), comments)
    scores = scoring.score_issues(prompts, lambda p: ("r", 0.5, str(len(p))), "2025-01-01").collect()
    assert sorted(r.issue_key for r in scores) == ["hot", "none"]


def test_a_hot_hour_of_one_issue_spreads_over_tasks(spark, conf):
    """20,000 comments, most of them at the very same time, come from a bulk import."""
    conf(adaptive__coalescePartitions__enabled="false", shuffle__partitions="16")
    comments = spark.range(20_300).select(
        F.lpad((F.col("id") * 7919 % 100_003).cast("string"), 6, "0").alias("id"),
        F.when(F.col("id") < 20_000, "hot").otherwise(F.concat(F.lit("K"), F.col("id") % 9)).alias("issue_key"), F.lit("ann").alias("author"),
        F.col("id").cast("string").alias("body"),
        F.when(F.col("id") % 50 > 0, F.lit("2025-01-01 10:00:00").cast("timestamp_ntz")).when(F.col("id") % 100 > 0, F.lit("2025-01-01 10:00:09").cast("timestamp_ntz")).alias("created"))
    divided = scoring._divided(comments.filter("created is not null"))
    sizes = divided.groupBy("issue_key", "slice").count().filter("issue_key = 'hot'").collect()
    assert len(sizes) > 100 and max(r["count"] for r in sizes) < 2000
    tasks = divided.repartition("issue_key", "hour", "slice").groupBy("issue_key", F.spark_partition_id()).count().filter("issue_key = 'hot'").collect()
    assert len(tasks) == 16 and max(r["count"] for r in tasks) < 4000
    wanted = {}
    for r in sorted(comments.collect(), key=lambda r: (r.created is not None, r.created, r.id) if r.created else (False, at("1970-01-01"), r.id)):
        wanted.setdefault(r.issue_key, []).append(f"- ann: {r.body}")
    assert {r.issue_key: r.thread for r in scoring.comment_threads(comments).collect()} == {k: "\n".join(v) for k, v in wanted.items()}


def test_scoring_run_stores_one_newest_score_per_issue(spark, make, tmp_path):
    store = TableStore(spark, str(tmp_path))
    store.write("issues", make.issues(dict(key="a"), dict(key="b")))
    store.write("issue_comments", make.comments(dict(id="1", issue_key="a")))
    store.write("ai_scores", make.scores(
        dict(issue_key="a", complexity_reasoning="zzz old", analyzed_at=at("2025-01-01")),
        dict(issue_key="b", complexity_reasoning="newer", analyzed_at=at("2026-01-01")),
        dict(issue_key="gone", complexity_reasoning="kept", analyzed_at=at("2025-01-01"))))
    scores = run_scoring(store, lambda p: ("new", 0.5, "n"), "2025-06-01")
    assert sorted((r.issue_key, r.complexity_reasoning) for r in scores.collect()) == [("a", "new"), ("b", "newer"), ("gone", "kept")]


def test_only_changed_prompts_are_scored_again(spark, make, tmp_path):
    store, asked = TableStore(spark, str(tmp_path / "s")), tmp_path / "asked"
    asked.mkdir()

    def scorer(prompt):
        key = re.search(r"key: (\S+)", prompt)[1]
        (asked / f"{key}-{uuid.uuid4().hex}").touch()
        if key == "bad" and "now good" not in prompt:
            raise ValueError("no answer")
        return key, 0.5, str(len(prompt))

    def run(at_):
        for f in asked.iterdir():
            f.unlink()
        rows = {r.issue_key: (r.complexity_reasoning, str(r.analyzed_at.date())) for r in run_scoring(store, scorer, at_).collect()}
        return sorted(f.name.split("-")[0] for f in asked.iterdir()), rows

    store.write("issues", make.issues(*[dict(key=k) for k in ("a", "b", "bad")]))
    store.write("issue_comments", make.comments(dict(id="1", issue_key="a")))
    calls, rows = run("2025-06-01")
    assert calls == ["a", "b", "bad"] and rows["bad"][0].startswith("Analysis failed")
    assert run("2025-06-02")[0] == ["bad"]  # a failure is tried again
    store.upsert("issue_comments", make.comments(dict(id="2", issue_key="b")))
    store.upsert("issues", make.issues(dict(key="bad", summary="now good")))
    calls, rows = run("2025-06-03")
    assert calls == ["b", "bad"] and rows == {"a": ("a", "2025-06-01"), "b": ("b", "2025-06-03"), "bad": ("bad", "2025-06-03")}
    assert run("2025-06-04") == ([], rows)


def test_calls_keep_the_pace(spark):
    now, slept = [0.0], []

    def sleep(seconds):
        slept.append(seconds)
        now[0] += seconds

    pace = scoring.Pace(15, burst=2, clock=lambda: now[0], sleep=sleep)
    times = []
    for _ in range(6):
        pace.take()
        times.append(now[0])
    assert times == [0, 0, 4, 8, 12, 16]
    now[0] += 60  # a pause saves up a burst and no more
    slept.clear()
    for _ in range(3):
        pace.take()
    assert slept == [4]
    with pytest.raises(ValueError):
        scoring.Pace(0)
    prompts = spark.createDataFrame([(f"K{i}", "p") for i in range(8)], "issue_key string, prompt string")
    scores = scoring.score_issues(prompts, lambda p: ("r", 0.5, "n"), "2025-01-01", calls_a_minute=60_000, tasks=3)
    assert scores.rdd.getNumPartitions() == 3 and len(scores.collect()) == 8


@pytest.mark.parametrize("build,expected", [
    (lambda i, c: reports.leaderboard_last_3_weeks(i, c), [1, 1]),
    (lambda i, c: reports.recent_velocity_trend(i, c), [1, 1]),
    (lambda i, c: metrics.week_over_week(reports.recent_velocity_trend(i, c, ordered=False)), [1, 1]),
    (lambda i, c: metrics.assignee_summary(reports.individual_velocity(i, c, ordered=False)), [1, 1]),
    (lambda i, c: metrics.assignee_comparison(reports.individual_velocity(i, c, ordered=False)), [1, 1]),
])
def test_each_table_is_shuffled_once(stored, conf, build, expected):
    conf(autoBroadcastJoinThreshold="-1", adaptive__enabled="false")
    text = plan(build(*stored))
    # A reused exchange is printed as such, without what lies below it.
    found = [len(re.findall(rf"FileScan parquet [^\n]*{name}", text)) for name in ("/issues", "/changes")]
    assert found == expected


def test_hot_day_does_not_end_in_one_sort_task(spark, make, conf):
    conf(adaptive__coalescePartitions__enabled="false")
    issues = spark.range(4000).select(
        *[F.lit(None).cast(f.dataType).alias(f.name) if f.name not in ("key", "created") else
          (F.concat(F.lit("K"), F.col("id")) if f.name == "key" else F.lit(at("2025-01-01")).cast("timestamp_ntz")).alias(f.name)
          for f in make.issues().schema.fields])
    done = reports.issues_table(issues, make.changes())
    tasks = done.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(tasks) >= 3 and max(r["count"] for r in tasks) < 3000
    assert len(tuples(done)) == 4000


def test_prompts_in_pieces_are_scored_as_whole_ones(spark, make):
    class ReadsPieces:
        """Scores a prompt by its digest without holding it."""

        def __call__(self, prompt):
            return self.read([prompt])

        def read(self, pieces):
            digest, longest = hashlib.md5(), 0
            for piece in pieces:
                digest.update(piece.encode())
                longest = max(longest, len(piece))
            return digest.hexdigest(), 0.5, str(longest)

    hours = spark.range(9_000).select(
        F.lpad(F.col("id").cast("string"), 5, "0").alias("id"), F.lit("hot").alias("issue_key"), F.lit("ann").alias("author"),
        F.when(F.col("id") % 50 > 0, F.col("id").cast("string")).alias("body"),
        F.when(F.col("id") >= 10, F.lit("2025-01-01").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("id").cast("int"))).alias("created"))
    comments = hours.unionByName(make.comments(dict(id="1", issue_key="b"), dict(id="2", issue_key="b", body=None), dict(id="3", issue_key="nobody"),
                                               dict(id="4", issue_key=None), dict(id="5", issue_key="silent", body=None)))
    issues = make.issues(dict(key="hot"), dict(key="hot", description="other"), dict(key="b"), dict(key="b"), dict(key=None),
                         dict(key="none", summary=None, description="100% %s"), dict(key="silent"))
    template = "50%%|%s|%s|%s|%s|%s|%s|%s|%n%%end"
    whole = scoring.scoring_prompts(issues, comments, template)
    pieces = scoring.scoring_prompts(issues, comments, template, pieces=True)
    wanted = sorted((r.issue_key or "", hashlib.md5(r.prompt.encode()).hexdigest()) for r in whole.collect())
    for scorer in (ReadsPieces(), lambda prompt: ReadsPieces()(prompt)):
        for given in (whole, pieces):
            scores = scoring.score_issues(given, scorer, "2025-01-01").collect()
            assert sorted((r.issue_key or "", r.complexity_reasoning) for r in scores) == wanted
    longest = [int(r.clarity_notes) for r in scoring.score_issues(pieces, ReadsPieces(), "2025-01-01").collect() if r.issue_key == "hot"]
    assert len(longest) == 2 and max(longest) < 1000 < max(len(r.prompt) for r in whole.collect())

    class Refuses(ReadsPieces):
        def read(self, pieces):
            next(pieces)
            raise ValueError("no")

    refused = scoring.score_issues(pieces, Refuses(), "2025-01-01", calls_a_minute=60_000, tasks=2).collect()
    assert len(refused) == 7 and {r.complexity_reasoning for r in refused} == {"Analysis failed: no"}
    with pytest.raises(ValueError):
        scoring.scoring_prompts(issues, comments, "%1$s", pieces=True)


def test_pieces_that_cannot_be_read_are_no_score():
    def batches():
        yield pd.DataFrame([("a", "1", "head", "tail"), ("a", "1", "line", None)], columns=["issue_key", "prompt_id", "piece", "behind"])
        raise OSError("lost")

    with pytest.raises(OSError):
        for _, _, pieces, _ in scoring._joined(batches()):
            scoring._score(pieces, lambda p: ("r", 0.5, "n"))


def test_scoring_run_writes_no_prompts(spark, make, tmp_path):
    store = TableStore(spark, str(tmp_path))
    store.write("issues", make.issues(dict(key="a", description="PLAIN" * 9), dict(key="b")))
    run_scoring(store, lambda p: ("new", 0.5, "n"), "2025-06-01")
    labels = {p.name.rsplit("-", 1)[0] for p in (tmp_path / "_work").iterdir()}
    assert labels and not any(label.startswith("prompts") for label in labels)
    stored = {r.issue_key: r.digest for r in store.read("scored_prompts").collect()}
    prompts = scoring.scoring_prompts(store.read("issues"), store.read("issue_comments")).collect()
    assert stored == {r.issue_key: hashlib.sha256(r.prompt.encode()).hexdigest() for r in prompts}
