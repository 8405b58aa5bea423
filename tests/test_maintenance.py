from __future__ import annotations

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from sprintloom import schemas
from sprintloom.operators import maintenance as m
from sprintloom.sources.raw import sprints_to_sync
from tests.conftest import at, day, dicts, plan, tuples


def by(df, key):
    return {r[key]: r for r in dicts(df)}


# ── upsert family ───────────────────────────────────────────────────────────────────────────


def test_upsert_inserts_then_replaces(make):
    empty = make.issues()
    first = m.upsert(empty, make.issues(dict(
        key="TEST-1", board_name="Test Board", sprint_name="Sprint 1", summary="Original Summary",
        assignee="User 1", reported_sp=3.0, priority="Medium")), ["key"])
    second = m.upsert(first, make.issues(dict(
        key="TEST-1", summary="Updated Summary", assignee="User 2", reported_sp=8.0,
        status="In Progress", status_category="進行中", flagged=True, updated=at("2025-01-07"))), ["key"])
    row, = dicts(second)
    assert (row["summary"], row["reported_sp"], row["assignee"]) == ("Updated Summary", 8.0, "User 2")
    assert row["flagged"] is True


def test_upsert_with_empty_batch_changes_nothing(make):
    target = make.issues(dict(key="a"), dict(key="b"))
    assert sorted(tuples(m.upsert(target, make.issues(), ["key"]))) == sorted(tuples(target))


def test_upsert_matches_columns_by_name(make):
    batch = make.issues(dict(key="a", summary="s", status="x"))
    shuffled = batch.select(*reversed(batch.columns))
    row, = dicts(m.upsert(make.issues(), shuffled, ["key"]))
    assert (row["summary"], row["status"]) == ("s", "x")


def test_upsert_does_not_shuffle_the_target_for_a_small_batch(spark, tmp_path_factory):
    tmp_path = tmp_path_factory.mktemp("up")
    folder = str(tmp_path / "target")
    spark.range(60_000).select(F.concat(F.lit("K"), F.col("id")).alias("key"), F.sha2(F.col("id").cast("string"), 256).alias("summary"),
                               F.lit("2025-01-05").cast("timestamp_ntz").alias("updated")).repartition(4).write.parquet(folder)
    batch = spark.createDataFrame([("K5", "new", at("2025-02-01")), ("K7", "late", at("2025-01-01")), ("N", "new", at("2025-02-01"))],
                                  "key string, summary string, updated timestamp_ntz")
    batch.write.parquet(str(tmp_path / "batch"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100KB")  # far less than the target
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        target = spark.read.parquet(folder)
        merged = m.upsert(target, spark.read.parquet(str(tmp_path / "batch")), ["key"])
        lines = plan(merged).splitlines()
        depth = lambda line: len(line) - len(line.lstrip(" :+-*()0123456789"))
        scans = [i for i, line in enumerate(lines) if "FileScan" in line and "/target" in line]
        assert len(scans) == 2
        for at_line in scans:  # what a scan's rows go through on their way up: a broadcast join before any exchange
            above, level = [], depth(lines[at_line])
            for line in reversed(lines[:at_line]):
                if depth(line) < level:
                    above.append(line.strip(" :+-*()0123456789"))
                    level = depth(line)
            first = next(x for x in above if "Join" in x or "Exchange" in x)
            assert first.startswith("BroadcastHashJoin") and ("LeftSemi" in first or "LeftAnti" in first)
        rows = {r.key: r.summary for r in merged.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    old = {r.key: r.summary for r in target.collect()}
    assert rows == {**old, "K5": "new", "N": "new"}


def _points(pairs):
    return {tuple(r)[:-2]: tuple(r)[-2:] for r in pairs}


def test_weekly_sums_give_back_what_they_took(make):
    """Tenths have no exact double; decimal sums leave no trace, and null points stay null."""
    before = make.issues(dict(key="a", reported_sp=0.1), dict(key="b", reported_sp=0.2), dict(key="c", reported_sp=None, assignee="bob"))
    batch = make.issues(dict(key="b", reported_sp=0.7, assignee="bob"), dict(key="c", reported_sp=None, assignee=None), dict(key="d", reported_sp=None))
    state = m.weekly_sums(before)
    after = m.add_weekly(state, m.weekly_sums(m.signed_rows(m.merge_pairs(before, batch, ["key"]))))
    got = {r.assignee: (r.reported_sp, r.issue_count) for r in m.weekly_of_sums(after).collect()}
    assert got == {"ann": (0.1, 2), "bob": (0.7, 1)}
    back = m.add_weekly(after, m.weekly_sums(m.signed_rows(m.merge_pairs(m.upsert(before, batch, ["key"]), before, ["key"]))))
    assert _points(tuples(m.weekly_of_sums(back).filter("assignee = 'bob'"))) == {(day("2025-01-06"), "Main Board", "bob"): (None, 1)}


def test_a_membership_goes_with_its_last_statement(make):
    stored, changes = make.issues(dict(key="a", sprint_name="S1"), dict(key="b", sprint_name="S1")), make.changes(
        dict(id="1", issue_key="a", field="Sprint", from_string="S0", to_string="S1, S2"))
    state = m.membership_counts(stored, changes)
    moved = m.merge_pairs(stored, make.issues(dict(key="a", sprint_name="S3"), dict(key="b", sprint_name="S3")), ["key"])
    added = m.merge_pairs(changes, make.changes(dict(id="2", issue_key="a", field="Sprint", from_string="S1", to_string="S3")), ["id"])
    after = m.add_memberships(state, m.membership_counts(m.signed_rows(moved), m.signed_rows(added)))
    assert sorted(tuples(after)) == [("S0", "a", 1), ("S1", "a", 2), ("S2", "a", 1), ("S3", "a", 2), ("S3", "b", 1)]


def test_an_altered_completion_is_computed_again(make):
    history = make.changes(dict(id="1", issue_key="a", created=at("2025-01-01")), dict(id="2", issue_key="a", created=at("2025-01-09")),
                           dict(id="3", issue_key="b", created=at("2025-01-05")))
    batch = make.changes(dict(id="1", issue_key="a", created=at("2025-01-01"), to_string="Open"), dict(id="3", issue_key="b", created=at("2025-01-05"), to_string="Open"),
                         dict(id="4", issue_key="c", created=at("2025-02-01")))
    pairs, after = m.merge_pairs(history, batch, ["id"]), m.upsert(history, batch, ["id"])
    times = m.add_completions(m.completion_times(history), m.completion_delta(pairs, after))
    assert sorted((r.issue_key, r.first_done, r.last_done, r.n_done) for r in times.collect()) == [
        ("a", at("2025-01-09"), at("2025-01-09"), 1), ("c", at("2025-02-01"), at("2025-02-01"), 1)]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abc"), st.integers(1, 28), st.integers(0, 9)), max_size=12),
       st.lists(st.tuples(st.sampled_from("bcd"), st.integers(1, 28), st.integers(0, 9)), max_size=12))
def test_upsert_property(make, old, new):
    def rows(items):
        return [dict(key=k, updated=at(f"2025-01-{d:02d}"), reported_sp=float(sp)) for k, d, sp in items]

    def latest(items):
        best = {}
        for k, d, sp in items:
            best[k] = max(best.get(k, (0, 0)), (d, sp))
        return best

    target = m.upsert(make.issues(), make.issues(*rows(old)), ["key"])
    once = m.upsert(target, make.issues(*rows(new)), ["key"])
    got = {r["key"]: (r["updated"].day, int(r["reported_sp"])) for r in dicts(once)}
    expected = latest(old)
    for k, (d, sp) in latest(new).items():  # a newer stored row stays, the batch wins ties
        if k not in expected or d >= expected[k][0]:
            expected[k] = (d, sp)
    assert got == expected
    twice = m.upsert(once, make.issues(*rows(new)), ["key"])
    assert sorted(map(str, tuples(twice))) == sorted(map(str, tuples(once)))


def test_replace_columns_keeps_what_the_batch_lacks(make, spark):
    target = make.sprints(dict(sprint_id=1, planned_sp_snapshot=50.0, state="future"), dict(sprint_id=2))
    batch = spark.createDataFrame(
        [(1, None, "S1", "active"), (3, "AI Board", "S3", "future")],
        "sprint_id int, board_name string, sprint_name string, state string")
    got = by(m.replace_columns(target, batch, ["sprint_id"], {"synced_at": "2025-05-05"}), "sprint_id")
    assert got[1]["planned_sp_snapshot"] == 50.0 and got[1]["state"] == "active"
    assert got[1]["board_name"] is None  # a listed null replaces
    assert got[1]["synced_at"] == at("2025-01-01") and got[3]["synced_at"] == at("2025-05-05")
    assert got[2]["state"] == "active" and set(got) == {1, 2, 3}


def test_insert_ignore(make):
    pairs = m.insert_ignore(make.bridge(("S1", "a")), make.bridge(("S1", "a"), ("S2", "a"), ("S2", "a")),
                            ["sprint_name", "issue_key"])
    assert sorted(tuples(pairs)) == [("S1", "a"), ("S2", "a")]
    rows = m.insert_ignore(make.sprints(dict(sprint_id=1, state="old")),
                           make.sprints(dict(sprint_id=1), dict(sprint_id=2), dict(sprint_id=2)), ["sprint_id"])
    assert sorted((r["sprint_id"], r["state"]) for r in dicts(rows)) == [(1, "old"), (2, "active")]


# ── priorities ──────────────────────────────────────────────────────────────────────────────


def test_priorities_are_raised(make):
    issues = make.issues(
        dict(key="urgent", summary="緊急 x"), dict(key="fix", summary="DeBUG it"),
        dict(key="type", issuetype="BUG"), dict(key="jp", issuetype="バグ"),
        dict(key="top", summary="障害", priority="Highest"), dict(key="null", summary="障害", priority=None),
        dict(key="plain"), dict(key="empty", summary=None, issuetype=None), dict(key="high", summary="優先", priority="High"))
    got = {k: r["priority"] for k, r in by(m.recalculate_priorities(issues), "key").items()}
    assert got == dict(urgent="High", fix="High", type="High", jp="High", top="Highest", null=None,
                       plain="Medium", empty="Medium", high="High")
    assert tuples(m.priority_changes(issues)) == [(4,)]
    assert tuples(m.priority_changes(m.recalculate_priorities(issues))) == [(0,)]


# ── snapshots ───────────────────────────────────────────────────────────────────────────────


def test_snapshot_is_written_once(make, spark):
    want = spark.createDataFrame([(1, 50.0), (99999, 7.0)], "sprint_id int, planned_sp double")
    registry, rejects = m.create_snapshots(make.sprints(dict(sprint_id=1), dict(sprint_id=2)), want, "2025-01-01")
    got = by(registry, "sprint_id")
    assert (got[1]["planned_sp_snapshot"], got[1]["snapshot_created_at"]) == (50.0, at("2025-01-01"))
    assert got[2]["planned_sp_snapshot"] is None and set(got) == {1, 2} and rejects.count() == 0
    again = spark.createDataFrame([(1, 60.0)], "sprint_id int, planned_sp double")
    registry, rejects = m.create_snapshots(registry, again, "2025-02-02")
    assert by(registry, "sprint_id")[1]["planned_sp_snapshot"] == 50.0
    assert tuples(rejects) == [(1, 60.0, "Snapshot already exists for sprint 1")]


def test_transition_snapshots(make, spark):
    before = make.sprints(dict(sprint_id=1, state="future"), dict(sprint_id=2, state="active"),
                          dict(sprint_id=3, state="future", planned_sp_snapshot=9.0),
                          dict(sprint_id=4, state="active"))
    now = make.sprints(dict(sprint_id=1, sprint_name="A"), dict(sprint_id=2, sprint_name="B"),
                       dict(sprint_id=3, sprint_name="C"), dict(sprint_id=4, sprint_name="D", state="closed"),
                       dict(sprint_id=5, sprint_name="E"), dict(sprint_id=6, sprint_name="F", state="future"))
    totals = spark.createDataFrame([(n, 5.0) for n in "ABCDF"], "sprint_name string, total_sp double")
    got = by(m.transition_snapshots(before, now, totals, "2025-01-03"), "sprint_id")
    # 5 was never seen before and has no issues; 2 was active already; 3 had its snapshot.
    assert {k: r["planned_sp_snapshot"] for k, r in got.items()} == {1: 5.0, 2: None, 3: 9.0, 4: None, 5: 0.0, 6: None}
    assert got[1]["snapshot_created_at"] == at("2025-01-03")


def test_backfill_and_coverage(make, spark):
    sprints = make.sprints(dict(sprint_id=1, sprint_name="A", state="closed"), dict(sprint_id=2, sprint_name="B"),
                           dict(sprint_id=3, sprint_name="C", planned_sp_snapshot=1.0),
                           dict(sprint_id=4, sprint_name="D", state="future"))
    assert tuples(m.snapshot_coverage(sprints, make.metadata({}))) == [(1, 3, 2, 1)]
    totals = spark.createDataFrame([("A", 4.0)], "sprint_name string, total_sp double")
    filled = m.backfill_snapshots(sprints, totals, "2025-01-03")
    assert {r["sprint_id"]: r["planned_sp_snapshot"] for r in dicts(filled)} == {1: 4.0, 2: 0.0, 3: 1.0, 4: None}
    assert tuples(m.snapshot_coverage(filled)) == [(3, 3, 0)]


# ── derived tables ──────────────────────────────────────────────────────────────────────────


def test_weekly_metrics(make):
    issues = make.issues(
        dict(key="a", created=at("2025-01-05T23:00"), reported_sp=2.0), dict(key="b", reported_sp=1.5),
        dict(key="c", created=at("2025-01-12")), dict(key="d", assignee=None), dict(key="e", board_name=None))
    assert sorted(map(str, tuples(m.weekly_metrics(issues)))) == sorted(map(str, [
        (day("2024-12-30"), "Main Board", "ann", 2.0, 1), (day("2025-01-06"), "Main Board", "ann", 2.5, 2),
        (day("2025-01-06"), None, "ann", 1.0, 1)]))


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b"]), st.none() | st.sampled_from(["", " ", "S1", "S2 "])), max_size=5),
       st.lists(st.tuples(st.sampled_from(["a", "b", "x"]), st.sampled_from(["Sprint", "status"]),
                          st.none() | st.text(alphabet="S1, 　、", max_size=8),
                          st.none() | st.text(alphabet="S2, 　、", max_size=8)), max_size=12))
def test_sprint_issues_is_the_set_of_all_memberships(make, current, history):
    def names(text):
        return [p.strip() for p in (text or "").split(", ") if p.strip()]

    expected = {(s, k) for k, s in current if s}
    expected |= {(n, k) for k, f, a, b in history if f == "Sprint" for n in names(a) + names(b)}
    got = m.sprint_issues(
        make.issues(*[dict(key=k, sprint_name=s) for k, s in current]),
        make.changes(*[dict(issue_key=k, field=f, from_string=a, to_string=b) for k, f, a, b in history]))
    rows = tuples(got)
    assert set(rows) == expected and len(rows) == len(expected)


def test_evolve_schema(make):
    old = make.issues(dict(key="a")).drop("issuetype", "flagged", "description").withColumn("extra", F.lit(1))
    new = m.evolve_schema(old, schemas.ISSUES, schemas.COLUMN_DEFAULTS["issues"])
    row = new.first()
    assert new.columns == [*schemas.ISSUES.fieldNames(), "extra"]
    assert (row.issuetype, row.flagged, row.description, row.extra) == ("", False, None, 1)


# ── run log and sufficiency ─────────────────────────────────────────────────────────────────


def test_run_log_and_summary(make, spark):
    source = spark.createDataFrame(
        [(1, "A", "closed"), (2, "B", "active"), (3, None, "future"), (4, "D", "odd")],
        "sprint_id int, sprint_name string, state string")
    selected = sprints_to_sync(source, make.sprints(dict(sprint_id=1, state="closed")))
    log = m.run_log(source, selected, make.issues(dict(key="a", sprint_id=2), dict(key="b", sprint_id=2)),
                    make.comments(dict(id="1", issue_key="a"), dict(id="2", issue_key="a"), dict(id="3", issue_key="zz")))
    got = by(log, "sprint_id")
    assert {k: r["outcome"] for k, r in got.items()} == {1: "skipped", 2: "synced", 3: "error", 4: "ignored"}
    assert (got[2]["issues"], got[2]["comments"]) == (2, 2)
    assert tuples(m.sync_summary(log)) == [(2, 2, 1, 1)]
    assert tuples(m.sync_summary(log.limit(0))) == [(0, 0, 0, 0)]


def test_sufficiency_update_adds_then_replaces(make, spark):
    weekly = make.weekly(*[dict(week_start=day(d), reported_sp=sp) for d, sp in (
        ("2025-01-06", 100.0), ("2025-01-13", 3.0), ("2025-01-20", 4.0), ("2025-01-27", 5.0))])
    future = spark.createDataFrame([(6.0,)], "future_sp double")
    history = make.history((day("2025-01-01"), 1.0, 1.0, 100.0))
    added = m.sufficiency_update(history, future, weekly, "2025-02-01")
    assert sorted(tuples(added))[1] == (day("2025-02-01"), 6.0, 4.0, 150.0)
    replaced = m.sufficiency_update(history, future, weekly.limit(0), "2025-01-01")
    assert tuples(replaced) == [(day("2025-01-01"), 6.0, 0.0, 0.0)]
