from __future__ import annotations

import json
import random

import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from sprintloom import schemas
from sprintloom.functions.richtext import BLOCK_TYPES, plain_text, rich_text_to_plain
from sprintloom.functions.expressions import completions
from sprintloom.plans.sync import rebuild_derived, run_sync
from sprintloom.sources import raw as src
from sprintloom.sources.tables import TableStore, all_issues, month_of, read_table
from sprintloom.streaming.incremental import incremental_ingest
from sprintloom.operators import maintenance as m, sprint_reports
from tests.conftest import at, day, dicts, plan, tuples

SP = schemas.STORY_POINTS_FIELD


def paragraph(*texts):
    return {"type": "paragraph", "content": [{"type": "text", "text": t} for t in texts]}


FULL = {
    "key": "T-1",
    "fields": {
        "summary": "Do it", "assignee": {"displayName": "Ann", "mail": "x"}, SP: 2.5,
        "status": {"name": "Done", "statusCategory": {"name": "完了"}}, "priority": {"name": "High"},
        "issuetype": {"name": "Bug"}, "resolution": {"name": "Fixed"}, "flagged": [{"value": "Impediment"}],
        "created": "2025-01-01T09:30:00.000+0900", "updated": "2025-01-02T00:00:00.000Z",
        "description": {"type": "doc", "content": [
            {"type": "heading", "content": [{"type": "text", "text": "Title"}]},
            {"type": "bulletList", "content": [
                {"type": "listItem", "content": [paragraph("one")]},
                {"type": "listItem", "content": [paragraph("two", "three")]}]},
            {"type": "codeBlock", "content": [{"type": "text", "text": "x = 1"}]},
            {"type": "panel", "content": [paragraph("a"), paragraph("b")]}]},
        "comment": {"comments": [
            {"id": "10", "author": {"displayName": "Bob"}, "body": {"type": "doc", "content": [paragraph("hey")]},
             "created": "2025-01-01T10:00:00.000+0900"},
            {"id": "11", "body": "plain", "created": "2025-01-01T11:00:00.000+0900"}]},
    },
    "changelog": {"histories": [
        {"id": "7", "author": {"displayName": "Ann"}, "created": "2025-01-02T08:00:00.000+0900", "items": [
            {"field": "status", "fromString": "To Do", "toString": "Done"},
            {"field": "Sprint", "toString": "S1, S2"},
            {"field": "Sprint", "toString": "S1, S2"}]},
        {"id": "8", "created": "2025-01-03T08:00:00.000+0900", "items": []}]},
}
BARE = {"key": "T-2", "fields": {"created": "2025-01-05T00:00:00", "updated": None}}


def line(issue, sprint_id=1, name="S1 ScrumA", board="Main Board"):
    return json.dumps({"board_name": board, "sprint_id": sprint_id, "sprint_name": name, "issue": issue})


@pytest.fixture
def land(tmp_path):
    def write(*lines, name="part-0.json"):
        folder = tmp_path / "landed"
        folder.mkdir(exist_ok=True)
        (folder / name).write_text("\n".join(lines), encoding="utf-8")
        return str(folder)
    return write


def test_issue_fields(spark, land):
    raw = src.read_raw_issues(spark, land(line(FULL), line(BARE)))
    full, bare = sorted(dicts(src.ingest_issues(raw)), key=lambda r: r["key"])
    assert full == dict(
        key="T-1", board_name="Main Board", sprint_id=1, sprint_name="S1 ScrumA", summary="Do it",
        assignee="Ann", reported_sp=2.5, status="Done", status_category="完了", priority="High",
        issuetype="Bug", resolution="Fixed", flagged=True, created=at("2025-01-01T09:30"),
        updated=at("2025-01-02"), description="Title\none\ntwo\nthree\nx = 1\nab")
    assert bare == dict(
        key="T-2", board_name="Main Board", sprint_id=1, sprint_name="S1 ScrumA", summary="",
        assignee=None, reported_sp=0.0, status="", status_category="", priority="", issuetype="",
        resolution=None, flagged=False, created=at("2025-01-05"), updated=None, description="")
    assert src.ingest_issues(raw).schema.simpleString() == schemas.ISSUES.simpleString()


def test_context_can_be_given(spark, land):
    raw = src.read_raw_issues(spark, land(line(BARE)))
    row = src.ingest_issues(raw, "AI Board", 9, "S9").first()
    assert (row.board_name, row.sprint_id, row.sprint_name) == ("AI Board", 9, "S9")


@pytest.mark.parametrize("flag, expected", [
    (True, True), (False, False), ("", False), ("false", True), (0, False), (1, True), ([], False),
    ([0], True), ({}, False), ({"a": 1}, True), (None, False)])
def test_flag_of_any_type(spark, land, flag, expected):
    raw = src.read_raw_issues(spark, land(line({"key": "T", "fields": {"flagged": flag}})))
    assert src.ingest_issues(raw).first().flagged is expected


def test_comments_and_changelog(spark, land):
    raw = src.read_raw_issues(spark, land(line(FULL), line(BARE)))
    assert tuples(src.ingest_comments(raw)) == [
        ("10", "T-1", "Bob", "hey", at("2025-01-01T10:00")),
        ("11", "T-1", "Unknown", "plain", at("2025-01-01T11:00"))]
    changes = tuples(src.ingest_changelog(raw))
    assert [c[0] for c in changes] == ["T-1_7_0", "T-1_7_1", "T-1_7_2"]
    assert changes[0][1:] == ("T-1", "Ann", "status", "To Do", "Done", at("2025-01-02T08:00"))
    assert changes[1][4] is None


def test_no_documents_give_empty_typed_frames(spark, land):
    raw = src.read_raw_issues(spark, land(line(BARE)))
    for got, schema in ((src.ingest_comments(raw), schemas.ISSUE_COMMENTS),
                        (src.ingest_changelog(raw), schemas.ISSUE_CHANGELOG)):
        assert got.count() == 0 and got.schema.simpleString() == schema.simpleString()


# ── rich text ───────────────────────────────────────────────────────────────────────────────

_leaf = st.one_of(
    st.none().map(lambda _: (None, "")),
    st.text(max_size=6).map(lambda t: (t, t)),
    st.text(max_size=6).map(lambda t: ({"type": "text", "text": t}, t)),
    st.integers().map(lambda i: (i, str(i))))


def _node(children):
    def build(kind, parts):
        separator = "\n" if kind in BLOCK_TYPES or kind == "list" else ""
        text = separator.join(t for _, t in parts)
        nodes = [n for n, _ in parts]
        return (nodes, text) if kind == "list" else ({"type": kind, "content": nodes}, text)
    kinds = st.sampled_from([*sorted(BLOCK_TYPES), "panel", "mention", "list"])
    return st.builds(build, kinds, st.lists(children, max_size=4))


@settings(max_examples=200, deadline=None)
@given(st.recursive(_leaf, _node, max_leaves=25))
def test_plain_text_property(pair):
    tree, text = pair
    assert plain_text(tree) == text


def test_plain_text_has_no_depth_limit():
    tree = {"type": "text", "text": "deep"}
    for _ in range(50_000):
        tree = {"type": "panel", "content": [tree]}
    assert plain_text(tree) == "deep"


def test_rich_text_column(spark):
    rows = [(json.dumps(FULL["fields"]["description"]),), (None,), ("just words",), ("[broken",),
            ('["a", {"type": "text", "text": "b"}]',)]
    got = [r[0] for r in rich_text_to_plain(spark.createDataFrame(rows, "d string"), "d").collect()]
    assert got == ["Title\none\ntwo\nthree\nx = 1\nab", "", "just words", "[broken", "a\nb"]


def test_a_string_that_looks_like_a_tree_stays_a_string(spark, land):
    texts = ["[1, 2]", "[]", '{"type": "text", "text": "x"}', '"quoted"', "null", ""]
    raw = src.read_raw_issues(spark, land(*[line({"key": f"T-{i}", "fields": {"description": t}}) for i, t in enumerate(texts)]))
    assert [r.description for r in src.ingest_issues(raw).orderBy("key").collect()] == texts


def test_a_tree_too_deep_for_the_parser_does_not_end_the_job(spark):
    deep = "[" * 200_000 + "]" * 200_000
    assert rich_text_to_plain(spark.createDataFrame([(deep,)], "d string"), "d").first().d == deep


# ── rejects ─────────────────────────────────────────────────────────────────────────────────


def test_rejects_are_listed_and_never_stored(spark, land, pages, tmp_path):
    good, cut = line(issue("a", 3), 2, "S2 ScrumA"), line(issue("b", 5), 2, "S2 ScrumA")[:150]
    keyless = line({"fields": {SP: 8}}, 2, "S2 ScrumA")
    raw = src.read_raw_issues(spark, land(good, cut, keyless, "no json at all", line("[" * 5000, 2), name="1.json"))
    rejects = dicts(src.ingest_rejects(raw))
    assert sorted(r["reason"] for r in rejects) == ["no issue key", "no issue key", "unreadable line", "unreadable line"] or sorted(
        r["reason"] for r in rejects) == ["no issue key"] + ["unreadable line"] * 3
    assert {cut, "no json at all"} <= {r["line"] for r in rejects}
    store = TableStore(spark, str(tmp_path / "store"))
    assert tuples(run_sync(store, raw, pages(), "2025-01-20")) == [(1, 1, 0, 4)]
    assert [r.key for r in store.read("issues").collect()] == ["a"]
    other = TableStore(spark, str(tmp_path / "other"))
    for turn in range(2):
        incremental_ingest(other, land(good, cut, keyless, name=f"{turn}.json"), str(tmp_path / "ckpt"))
        assert [r.key for r in other.read("issues").collect()] == ["a"]


# ── sprints ─────────────────────────────────────────────────────────────────────────────────

PAGES = [
    {"board_name": "Main Board", "page": 0, "values": [
        {"id": 1, "name": "S1 ScrumA", "state": "closed", "startDate": "2025-01-01T00:00:00Z",
         "endDate": "2025-01-14T00:00:00Z", "completeDate": "2025-01-14T00:00:00Z"},
        {"id": 2, "name": "S2 ScrumA", "state": "active", "startDate": "2025-01-15T00:00:00Z"}]},
    {"board_name": "Main Board", "page": 1, "values": [
        {"id": 3, "name": "S3 ScrumA", "state": "future"}, {"id": 4, "name": "odd"}]},
]


@pytest.fixture
def pages(spark, tmp_path):
    def write(content=PAGES):
        path = tmp_path / "pages.json"
        path.write_text("\n".join(json.dumps(p) for p in content))
        return src.read_raw_sprints(spark, str(path))
    return write


def test_sprint_list_is_newest_first(pages):
    rows = dicts(src.sprint_list(pages()))
    assert [r["sprint_id"] for r in rows] == [4, 3, 2, 1]
    assert [r["state"] for r in rows] == ["", "future", "active", "closed"]
    assert rows[1]["start_date"] is None


def test_sprints_to_sync(pages, make):
    source = src.sprint_list(pages())
    known = make.sprints(dict(sprint_id=1, state="closed"), dict(sprint_id=2, state="closed"))
    assert sorted(r.sprint_id for r in src.sprints_to_sync(source, known).collect()) == [2, 3]
    assert len(src.sprints_to_sync(source, known, full=True).collect()) == 3
    # Stored as active, closed since: read it once more.
    before = make.sprints(dict(sprint_id=1, state="active"))
    assert 1 in [r.sprint_id for r in src.sprints_to_sync(source, before).collect()]


def test_future_sprint_sp(spark, land, make):
    folder = land(line({"key": "a", "fields": {SP: 3}}, 3), line({"key": "b", "fields": {}}, 3),
                  line({"key": "c", "fields": {SP: 5}}, 2))
    raw = src.read_raw_issues(spark, folder)
    future = make.sprints(dict(sprint_id=3, state="future"), dict(sprint_id=2, state="active"))
    assert tuples(src.future_sprint_sp(raw, future)) == [(3.0,)]
    assert tuples(src.future_sprint_sp(raw, make.sprints())) == [(0.0,)]


def test_a_document_landed_again_counts_once_per_board(spark, land, make):
    old, new = {"key": "a", "fields": {SP: 3, "updated": "2025-01-01T00:00:00"}}, {"key": "a", "fields": {SP: 5, "updated": "2025-01-02T00:00:00"}}
    raw = src.read_raw_issues(spark, land(line(new, 3), line(old, 3), line(new, 3), line(old, 3, board="B")))
    future = make.sprints(dict(sprint_id=3, state="future"))
    assert tuples(src.future_sprint_sp(raw, future)) == [(8.0,)]


# ── stored tables, sync and streaming ───────────────────────────────────────────────────────


def test_all_issues_and_read_table(spark, make, tmp_path):
    make.issues(dict(key="a"), dict(key="c", created=at("2025-02-01")), dict(key="b"),
                dict(key="n", created=None)).write.parquet(str(tmp_path / "t"))
    issues = read_table(spark, str(tmp_path / "t"), schemas.ISSUES)
    assert [r.key for r in all_issues(issues).collect()] == ["c", "a", "b", "n"]


def files(folder):
    return {str(p) for p in folder.rglob("part-*.parquet")}


def test_store_replaces_whole_tables(spark, make, tmp_path):
    store = TableStore(spark, str(tmp_path))
    assert store.read("issues").count() == 0
    store.write("issues", make.issues(dict(key="a")))
    # The table may be read by the very job that replaces it.
    store.write("issues", store.read("issues").unionByName(make.issues(dict(key="b", created=at("2025-04-01")))))
    assert sorted(r.key for r in store.read("issues").collect()) == ["a", "b"] and store.parts("issues") == ["m2025-01", "m2025-04"]
    store.write("issues", make.issues(dict(key="c", created=None)))
    assert [r.key for r in store.read("issues").collect()] == ["c"] and store.parts("issues") == ["none"]
    assert store.write("issues", make.issues()).count() == 0
    # Plain Parquet folders that any reader understands, nothing else.
    store.write("issues", make.issues(dict(key="d")))
    assert spark.read.parquet(str(tmp_path / "issues")).count() == 1 and not list(tmp_path.glob("_batch/*"))


def test_store_does_not_need_the_success_marker(spark, make, tmp_path):
    conf, name = spark._jsc.hadoopConfiguration(), "mapreduce.fileoutputcommitter.marksuccessfuljobs"
    conf.set(name, "false")
    try:
        assert TableStore(spark, str(tmp_path)).write("issues", make.issues(dict(key="a"))).count() == 1
    finally:
        conf.unset(name)


def test_upsert_leaves_the_files_of_other_months_alone(spark, make, tmp_path):
    store = TableStore(spark, str(tmp_path))
    store.write("issue_changelog", make.changes(
        *[dict(id=f"{m}-{i}", created=at(f"2025-{m:02d}-05")) for m in range(1, 7) for i in range(3)]))
    before = files(tmp_path / "issue_changelog")
    batch = make.changes(dict(id="3-1", to_string="new", created=at("2025-03-05")), dict(id="x", created=at("2025-03-09")))
    table = store.upsert("issue_changelog", batch)
    after = files(tmp_path / "issue_changelog")
    assert {f for f in before if "2025-03" not in f} == {f for f in after if "2025-03" not in f} and before != after
    assert table.count() == 19 and table.filter("to_string = 'new'").count() == 1
    for again in (make.changes(), batch):  # nothing to change: no file is written
        store.upsert("issue_changelog", again)
        assert files(tmp_path / "issue_changelog") == after


def test_an_issue_stays_in_its_part_when_its_creation_time_is_corrected(spark, make, tmp_path):
    store = TableStore(spark, str(tmp_path))
    store.write("issues", make.issues(dict(key="a"), dict(key="b")))
    store.upsert("issues", make.issues(dict(key="a", created=at("2025-07-01"), summary="moved"), dict(key="n", created=at("2025-07-02"))))
    assert sorted((r.key, r.summary) for r in store.read("issues").collect()) == [("a", "moved"), ("b", "work"), ("n", "work")]
    assert store.parts("issues") == ["m2025-01", "m2025-07"]


class Lost(Exception):
    """The writer has ended."""


@pytest.mark.parametrize("tables_done", [0, 1, 2])
def test_a_batch_counts_once_whenever_its_writer_ends(spark, make, tmp_path, monkeypatch, tables_done):
    store = TableStore(spark, str(tmp_path))
    store.commit({t: store.parted(t, rows) for t, rows in (
        ("issues", make.issues(dict(key="a"), dict(key="z", created=at("2025-09-01")))), ("issue_comments", make.comments(dict(id="1"))))}, "0")
    new = {"issues": make.issues(dict(key="a", summary="new"), dict(key="b")), "issue_comments": make.comments(dict(id="1", body="new"), dict(id="2"))}

    def send(writer):
        writer.commit({t: writer.merged(t, rows)[0] for t, rows in new.items()}, "1")

    replaced, done = TableStore._replace_parts, []

    def dying(self, table, folder, whole):
        if len(done) == tables_done:
            if table == "issue_comments":  # in the midst of replacing: the old part has gone
                self._delete("issue_comments/part=m2025-01")
            raise Lost
        done.append(table)
        replaced(self, table, folder, whole)

    monkeypatch.setattr(TableStore, "_replace_parts", dying)
    if tables_done < 2:
        with pytest.raises(Lost):
            send(store)
    monkeypatch.undo()
    after = TableStore(spark, str(tmp_path))
    assert after.recover() == (tables_done < 2)
    for _ in range(2):
        send(after)  # the stream sends the batch again
        assert sorted((r.key, r.summary) for r in after.read("issues").collect()) == [("a", "new"), ("b", "work"), ("z", "work")]
        assert sorted((r.id, r.body) for r in after.read("issue_comments").collect()) == [("1", "new"), ("2", "hi")]


def test_a_batch_that_was_not_staged_whole_is_dropped(spark, make, tmp_path):
    store = TableStore(spark, str(tmp_path))
    store.write("issues", make.issues(dict(key="a")))
    store.parted("issues", make.issues(dict(key="b"))).write.partitionBy("part").parquet(str(tmp_path / "_batch" / "7" / "issues"))
    (tmp_path / "_batch" / "7" / "ready").mkdir()
    assert store.recover() == 0 and [r.key for r in store.read("issues").collect()] == ["a"]
    store.written(spark.range(2), "x")
    store.clear_work()
    assert not (tmp_path / "_work").exists() and not list(tmp_path.glob("_batch/*"))


def test_stored_history_is_grouped_by_field_in_each_file(spark, make, tmp_path):
    rows = [dict(issue_key=f"K{i}", field=("status", "Sprint", "rank")[i % 3], created=at(f"2025-0{i % 2 + 1}-01")) for i in range(60)]
    TableStore(spark, str(tmp_path)).write("issue_changelog", make.changes(*rows).repartition(2))
    found = sorted(files(tmp_path / "issue_changelog"))
    assert len(found) == 2
    for file in found:
        fields = pq.ParquetFile(file).read(columns=["field"]).column("field").to_pylist()
        assert fields == sorted(fields)


def test_store_adds_columns_to_old_parts(spark, make, tmp_path):
    store = TableStore(spark, str(tmp_path))
    old = make.issues(dict(key="a"), dict(key="c", created=at("2025-05-05"))).drop("issuetype")
    old.withColumn("part", month_of("created")).write.partitionBy("part").parquet(str(tmp_path / "issues"))
    assert sorted((r.key, r.issuetype) for r in store.read("issues").collect()) == [("a", ""), ("c", "")]
    store.upsert("issues", make.issues(dict(key="b", issuetype="Bug")))
    assert sorted((r.key, r.issuetype) for r in store.read("issues").collect()) == [("a", ""), ("b", "Bug"), ("c", "")]


def issue(key, sp, status="To Do", updated="2025-01-16T00:00:00"):
    names = {"To Do": "To Do", "Done": "完了"}
    return {"key": key, "fields": {
        "summary": "バグ " + key, SP: sp, "status": {"name": status, "statusCategory": {"name": names[status]}},
        "priority": {"name": "Low"}, "assignee": {"displayName": "Ann"}, "created": "2025-01-15T00:00:00",
        "updated": updated, "comment": {"comments": [{"id": "c" + key, "body": "x", "created": updated}]}}}


def test_sync_run(spark, land, pages, tmp_path):
    store = TableStore(spark, str(tmp_path / "store"))
    raw = src.read_raw_issues(spark, land(
        line(issue("a", 3), 2, "S2 ScrumA"), line(issue("b", 5), 2, "S2 ScrumA"),
        line(issue("a", 3), 1), line(issue("f", 8), 3, "S3 ScrumA"), line(issue("z", 1), 4, "odd")))
    assert tuples(run_sync(store, raw, pages(), "2025-01-20")) == [(4, 4, 0, 0)]

    issues = {r["key"]: r for r in dicts(store.read("issues"))}
    assert set(issues) == {"a", "b", "f"}  # the sprint in an unknown state is not read
    assert issues["a"]["sprint_id"] == 1   # fetched twice unchanged: the lower sprint id is kept
    assert {r["priority"] for r in issues.values()} == {"High"}
    sprints = {r["sprint_id"]: r for r in dicts(store.read("synced_sprints"))}
    assert sprints[2]["planned_sp_snapshot"] == 5.0
    assert sprints[2]["snapshot_created_at"] == at("2025-01-15")
    assert sprints[1]["planned_sp_snapshot"] is None
    meta = {r["sprint_id"]: r for r in dicts(store.read("sprint_metadata"))}
    assert meta[1]["start_date"] == "2025-01-01" and meta[1]["created_at"] == at("2025-01-20")
    assert store.read("weekly_metrics").first().reported_sp == 16.0
    assert tuples(store.read("sufficiency_snapshots")) == [(day("2025-01-20"), 8.0, 16.0, 50.0)]

    # Second run: sprint 1 is skipped, the snapshot stays, the history row is replaced.
    later = src.read_raw_issues(spark, land(
        line(issue("b", 7, "Done", "2025-01-18T00:00:00"), 2, "S2 ScrumA"), line(issue("a", 99), 1)))
    assert tuples(run_sync(store, later, pages(), "2025-01-20")) == [(1, 1, 1, 0)]
    issues = {r["key"]: r for r in dicts(store.read("issues"))}
    assert (issues["b"]["reported_sp"], issues["b"]["status"], issues["a"]["reported_sp"]) == (7.0, "Done", 3.0)
    sprints = {r["sprint_id"]: r for r in dicts(store.read("synced_sprints"))}
    assert sprints[2]["planned_sp_snapshot"] == 5.0
    assert store.read("sufficiency_snapshots").count() == 1


def test_a_sprint_on_two_boards_is_one_sprint(spark, land, pages, tmp_path):
    both = [{**p, "board_name": b} for p in PAGES for b in ("Main Board", "Other")] * 2
    raw = src.read_raw_issues(spark, land(*[
        line(issue(k, 3), 2, "S2 ScrumA", b) for k in "ab" for b in ("Main Board", "Other")] * 2))
    store = TableStore(spark, str(tmp_path / "store"))
    for _ in range(2):
        assert tuples(run_sync(store, raw, pages(both), "2025-01-20"))[0][0] == 2
        shared = [r for r in dicts(store.read("synced_sprints")) if r["sprint_id"] == 2]
        assert [(r["board_name"], r["planned_sp_snapshot"]) for r in shared] == [("Other", 6.0)]
        assert store.read("sprint_metadata").filter("sprint_id = 2").count() == 1
        progress = dicts(sprint_reports.active_sprints_progress(store.read("issues"), store.read("synced_sprints")))
        assert [(r["total_issues"], r["total_sp"]) for r in progress] == [(2, 6.0)]


def test_a_late_file_does_not_undo_a_newer_state(spark, land, tmp_path):
    store = TableStore(spark, str(tmp_path / "store"))
    incremental_ingest(store, land(line(issue("a", 5, updated="2025-01-05T00:00:00")), name="1.json"), str(tmp_path / "ckpt"))
    incremental_ingest(store, land(line(issue("a", 2, updated="2025-01-02T00:00:00")), name="2.json"), str(tmp_path / "ckpt"))
    assert [r.reported_sp for r in store.read("issues").collect()] == [5.0]
    incremental_ingest(store, land(line(issue("a", 6, updated="2025-01-05T00:00:00")), name="3.json"), str(tmp_path / "ckpt"))
    assert [r.reported_sp for r in store.read("issues").collect()] == [6.0]


def test_incremental_ingest_reads_each_file_once(spark, land, tmp_path):
    store = TableStore(spark, str(tmp_path / "store"))
    folder = land(line(issue("a", 1)), line(issue("b", 2)), name="1.json")
    incremental_ingest(store, folder, str(tmp_path / "ckpt"))
    assert store.read("issues").count() == 2 and store.read("issue_comments").count() == 2
    land(line(issue("b", 9, updated="2025-01-19T00:00:00")), line(issue("c", 4)), name="2.json")
    incremental_ingest(store, folder, str(tmp_path / "ckpt"))
    assert sorted((r.key, r.reported_sp) for r in store.read("issues").collect()) == [
        ("a", 1.0), ("b", 9.0), ("c", 4.0)]
    before = files(tmp_path / "store")
    incremental_ingest(store, folder, str(tmp_path / "ckpt"))
    assert files(tmp_path / "store") == before


def document(key, sp, sprint, updated, created, assignee, *histories):
    return {"key": key, "fields": {
        "summary": key, SP: sp, "status": {"name": "Done", "statusCategory": {"name": "完了"}}, "assignee": assignee and {"displayName": assignee},
        "created": created, "updated": updated}, "changelog": {"histories": [
            {"id": i, "created": t, "items": [{"field": f, "fromString": a, "toString": b}]} for i, t, f, a, b in histories]}}, sprint


def test_derived_tables_equal_their_rebuild_after_random_batches(spark, land, tmp_path):
    """Issues change sprint, week, points and assignee, histories grow, and now and then an entry is altered."""
    rng, store, folder = random.Random(12), TableStore(spark, str(tmp_path / "store")), None
    history = {}
    for turn in range(4):
        lines = []
        for _ in range(12):
            key = f"K{rng.randrange(9)}"
            own = history.setdefault(key, {})
            own[f"{key}-{len(own)}"] = (f"2025-{rng.randrange(1, 5):02d}-{rng.randrange(1, 28):02d}T00:00:00", *rng.choice([
                ("status", "To Do", "Done"), ("status", "Done", "To Do"), ("Sprint", "S1, S2", "S3"), ("Sprint", None, " S1 ,S4"), ("Sprint", "", "S2")]))
            if turn == 3 and rng.random() < 0.5:
                old = rng.choice(sorted(own))
                own[old] = (own[old][0], "status", "To Do", rng.choice(["Done", "Open"]))
            issue_, sprint = document(
                key, rng.choice([None, 0.5, 1.25, 3]), rng.choice(["S1", "S2", "S5"]), f"2025-06-{turn + 1:02d}T00:00:{rng.randrange(60):02d}",
                f"2025-0{rng.randrange(1, 3)}-{rng.randrange(1, 28):02d}T00:00:00", rng.choice([None, "ann", "bob"]), *[(i, *h) for i, h in own.items()])
            lines.append(line(issue_, rng.randrange(1, 4), sprint))
        folder = land(*lines, name=f"{turn}.json")
        incremental_ingest(store, folder, str(tmp_path / "ckpt"))
        issues, changes = store.read("issues"), store.read("issue_changelog")
        order = lambda rows: sorted(map(str, rows))
        for table, rebuilt in (("weekly_metrics", m.weekly_metrics(issues)), ("sprint_issues", m.sprint_issues(issues, changes)),
                               ("completions", completions(changes))):
            assert order(tuples(store.read(table).select(*rebuilt.columns))) == order(tuples(rebuilt)), (turn, table)
        states = {t: order(tuples(store.read(t))) for t in ("weekly_sums", "memberships", "completion_times")}
        rebuild_derived(store)
        assert {t: order(tuples(store.read(t))) for t in states} == states


def test_a_batch_rewrites_the_weeks_and_issues_it_concerns(spark, land, tmp_path):
    store = TableStore(spark, str(tmp_path / "store"))
    rows = [document(f"K{i}", 1, "S1", "2025-06-01T00:00:00", f"2025-0{i}-15T00:00:00", "ann", (f"h{i}", f"2025-0{i}-06T00:00:00", "status", "", "Done")) for i in range(1, 7)]
    incremental_ingest(store, land(*[line(d, 1, s) for d, s in rows], name="1.json"), str(tmp_path / "ckpt"))
    tables = ("issues", "issue_changelog", "weekly_sums", "memberships", "completion_times")
    before = {t: files(tmp_path / "store" / t) for t in tables}
    assert all(len(f) == 6 for f in before.values())
    changed, sprint = document("K3", 5, "S2", "2025-06-02T00:00:00", "2025-03-15T00:00:00", "bob", ("h3", "2025-03-06T00:00:00", "status", "", "Done"),
                               ("h9", "2025-06-02T00:00:00", "status", "", "Done"))
    incremental_ingest(store, land(line(changed, 1, sprint), name="2.json"), str(tmp_path / "ckpt"))
    for table in tables:
        month = "2025-06" if table == "issue_changelog" else "2025-03"
        assert {f for f in before[table] ^ files(tmp_path / "store" / table) if month not in f} == set(), table
    assert sorted(tuples(store.read("sprint_issues")))[-1] == ("S2", "K3") and store.read("sprint_issues").count() == 6
    assert [str(r.last_completed_date) for r in store.read("completions").filter("issue_key = 'K3'").collect()] == ["2025-06-02"]


def test_documents_land_compressed_in_short_files(spark, monkeypatch):
    from fixtures import model
    monkeypatch.setattr(model, "LANDED_LINES", 400)
    t = model.Model(spark, "/root/testdata/sf0.001")
    landed = spark.read.text(t.landed).withColumn("file", F.input_file_name())
    assert landed.select("value").exceptAll(t.raw_text).isEmpty() and t.raw_text.exceptAll(landed.select("value")).isEmpty()
    files = landed.groupBy("file").count().collect()
    assert len(files) > 1 and all(r.file.endswith(".lz4") and r["count"] <= 400 for r in files)


def test_a_batch_of_unique_keys_for_new_parts_is_neither_sorted_nor_joined(spark, make, tmp_path, monkeypatch):
    plans, write = {}, TableStore.written
    monkeypatch.setattr(TableStore, "written", lambda store, df, label: plans.__setitem__(label, plan(df)) or write(store, df, label))
    store = TableStore(spark, str(tmp_path))
    rows, pairs = store.merged("issues", make.issues(dict(key="T-1"), dict(key="T-2"), dict(key=None)))
    assert sorted(plans) == ["issues-batch", "issues-repeated"]
    assert "Aggregate" not in plans["issues-batch"] and "Join" not in plans["issues-batch"] + plan(pairs) + plan(rows)
    assert sorted(r.key for r in rows.collect()) == ["T-1", "T-2"] and [r.old for r in pairs.collect()] == [None, None]
    store.commit({"issues": rows})
    again = make.issues(dict(key="T-1", summary="old", updated=at("2025-01-07")), dict(key="T-1", summary="new", updated=at("2025-01-08")),
                        dict(key="T-3"))
    store.commit({"issues": store.merged("issues", again)[0]})
    assert sorted((r.key, r.summary) for r in store.read("issues").collect()) == [("T-1", "new"), ("T-2", "work"), ("T-3", "work")]
