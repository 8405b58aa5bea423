"""One query per operator, over the model tables of ``fixtures.model``."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from fixtures.model import AS_OF, EPOCH, Model, rich_document
from sprintloom import schemas
from sprintloom.functions import expressions as x
from sprintloom.functions.richtext import rich_text_to_plain
from sprintloom.operators import (
    maintenance as m, metrics as d, reports as r, scoring as a, sprint_reports as s,
)
from sprintloom.plans.dashboard import dashboard, shared_completions, shared_memberships, shared_totals, shared_work
from sprintloom.plans.sync import run_scoring
from sprintloom.session import shared_dir
from sprintloom.sinks.export import csv_export, dashboard_export
from sprintloom.sources import raw as src
from sprintloom.sources.tables import TableStore, all_issues
from sprintloom.streaming.incremental import incremental_ingest

WATERMARK = "2000-12-25"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(build: Callable[[Model], DataFrame]) -> Callable[[Model], DataFrame]:
    QUERIES[build.__name__] = lambda spark, sf_dir: build(Model(spark, sf_dir))
    return build


def simple(**builders: Callable[[Model], DataFrame]) -> None:
    for name, build in builders.items():
        QUERIES[name] = lambda spark, sf_dir, build=build: build(Model(spark, sf_dir))


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Sums of non-terminating fractions differ in their last bit with the order of addition."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


# ── sources and ingest ──────────────────────────────────────────────────────────────────────

simple(
    all_issues=lambda t: all_issues(t.described_issues),
    ingest_issues=lambda t: src.ingest_issues(t.raw_issues),
    ingest_comments=lambda t: src.ingest_comments(t.raw_issues),
    ingest_changelog=lambda t: src.ingest_changelog(t.raw_issues),
    sprint_list=lambda t: src.sprint_list(t.raw_sprints),
    sprints_to_sync=lambda t: src.sprints_to_sync(t.source_sprints, t.sprints),
    future_sprint_sp=lambda t: src.future_sprint_sp(t.raw_issues, t.sprints),
    # The same documents and pages landed twice over for each of two boards.
    future_sprint_sp_two_boards=lambda t: src.future_sprint_sp(_on_two_boards(t.raw_issues), t.sprints),
    unique_sprints=lambda t: src.unique_sprints(src.sprint_list(_on_two_boards(t.raw_sprints))),
    sprints_to_sync_two_boards=lambda t: src.sprints_to_sync(
        src.sprint_list(_on_two_boards(t.raw_sprints)).select("board_name", "sprint_id", "sprint_name", "state"),
        t.sprints),
    ingest_issues_damaged=lambda t: src.ingest_issues(src.readable(t.damaged_issues)).select("key", "summary", "updated"),
)


def _on_two_boards(raw: DataFrame) -> DataFrame:
    boards = F.array(F.lit("Main Board"), F.lit("Second Board"))
    both = raw.withColumn("board_name", F.explode(boards))
    return both.union(both)


@query
def ingest_rejects(t: Model) -> DataFrame:
    """Rejected lines by reason, with the key that can still be read from a line that was cut off."""
    return src.ingest_rejects(t.damaged_issues).select(
        "reason", F.when(F.col("line").isNull(), F.col("sprint_id")).alias("sprint_id"),
        F.nullif(F.regexp_extract("line", '"key":"([^"]*)"', 1), F.lit("")).alias("key"))


@query
def rich_text_to_plain_documents(t: Model) -> DataFrame:
    trees = t.raw("documents").select(
        "doc_id", F.to_json(rich_document(F.col("text"))).alias("text"))
    return rich_text_to_plain(trees, "text")


@query
def incremental_ingest_issues(t: Model) -> DataFrame:
    root = shared_dir(t.spark, "incremental")
    store = TableStore(t.spark, f"{root}/tables")
    incremental_ingest(store, t.landed, f"{root}/stream")
    changes = store.read("issue_changelog").groupBy("issue_key").agg(F.count("*").alias("n_changes"))
    notes = store.read("issue_comments").groupBy("issue_key").agg(F.count("*").alias("n_comments"))
    return store.read("issues").join(
        changes.withColumnRenamed("issue_key", "key"), "key", "left",
    ).join(notes.withColumnRenamed("issue_key", "key"), "key", "left")


# ── sinks ───────────────────────────────────────────────────────────────────────────────────


def _dashboard(t: Model, whole: bool = False) -> dict[str, DataFrame]:
    """All results; what several share is written first, for the ``whole`` dashboard also what only two or five need."""
    tables = {
        "issues": t.issues, "issue_changelog": t.changelog, "synced_sprints": t.sprints,
        "sprint_issues": t.bridge, "sprint_metadata": t.metadata,
        "sufficiency_snapshots": t.history,
    }
    completed = shared_completions(t.changelog)
    more = dict(members=shared_memberships(t.issues, t.bridge), work=shared_work(t.issues, completed)) if whole else {}
    return dashboard(tables, AS_OF, EPOCH, completed=completed, totals=shared_totals(t.issues, EPOCH), **more)


@query
def dashboard_export_counts(t: Model) -> DataFrame:
    folder = shared_dir(t.spark, "dashboard")
    results = _dashboard(t, whole=True)
    dashboard_export(results, folder, AS_OF, EPOCH)
    counts = [
        t.spark.read.text(f"{folder}/{name}").agg(F.count("*").alias("n_rows"))
        .select(F.lit(name).alias("result"), "n_rows")
        for name in results
    ]
    return reduce(DataFrame.unionByName, counts)


def _exported(t: Model, *names: str) -> DataFrame:
    """Results read back from their JSON, dates and times as the text that was written."""
    folder = shared_dir(t.spark, "dashboard")
    results = {name: frame for name, frame in _dashboard(t).items() if name in names}
    dashboard_export(results, folder, AS_OF, EPOCH)
    kinds = {"date": "string", "timestamp_ntz": "string"}
    frames = []
    for name, frame in results.items():
        schema = ", ".join(f"{c} {kinds.get(kind, kind)}" for c, kind in frame.dtypes)
        frames.append(t.spark.read.schema(schema).json(f"{folder}/{name}"))
    return reduce(DataFrame.unionByName, frames)


def _csv(t: Model, result: DataFrame) -> DataFrame:
    folder = shared_dir(t.spark, "csv")
    csv_export(result, folder)
    schema = ", ".join(f"{c} {kind}" for c, kind in result.dtypes)
    return t.spark.read.schema(schema).option("header", True).option(
        "enforceSchema", True).option("escape", '"').csv(folder)


@query
def dashboard_totals(t: Model) -> DataFrame:
    """The four results that share one pass over the issues, as one list."""
    found = _dashboard(t)
    number = lambda c: F.col(c).cast("double")
    return reduce(DataFrame.unionByName, [found[name].select(
        F.lit(name).alias("result"), F.coalesce(F.col(key), F.lit("")).alias("item"), number(count).alias("count"), number(points).alias("points"))
        for name, key, count, points in (("leaderboard", "assignee", "issue_count", "total_sp"), ("teamSummary", "team", "total_issues", "done_sp"),
                                         ("statusBreakdown", "status_category", "count", "sp"), ("assigneeLoad", "assignee", "done_count", "total_sp"))])


simple(
    dashboard_export_velocity=lambda t: _exported(t, "velocity"),
    dashboard_export_issues=lambda t: _exported(t, "issues"),
    dashboard_export_active_issues=lambda t: _exported(t, "activeSprintIssues"),
    csv_export_velocity=lambda t: _csv(t, r.velocity_by_team(t.issues, t.changelog)),
    csv_export_individual=lambda t: _csv(t, r.individual_velocity(t.issues, t.changelog)),
    csv_export_issues=lambda t: _csv(t, r.issues_table(t.issues, t.changelog)),
)


# ── table maintenance ───────────────────────────────────────────────────────────────────────


@query
def upsert(t: Model) -> DataFrame:
    """Stored: issues up to the watermark, as created. Batch: everything touched since, the
    newest state beside an older copy of it."""
    stored = t.issues.filter(F.col("created") < WATERMARK).withColumns({
        "status": F.lit("To Do"), "status_category": F.lit("To Do")})
    touched = t.issues.filter(F.col("updated") >= WATERMARK)
    older = touched.withColumns({
        "status": F.lit("To Do"), "updated": F.col("updated") - F.expr("INTERVAL 1 DAY")})
    return m.upsert(stored, older.unionByName(touched), ["key"])


@query
def replace_columns(t: Model) -> DataFrame:
    closed = t.sprints.filter(F.col("state") == "closed").select("sprint_id")
    stored = t.metadata.join(closed, "sprint_id", "left_semi")
    batch = t.metadata.select(
        "sprint_id", F.upper("sprint_name").alias("sprint_name"), "start_date",
        F.lit(None).cast("string").alias("end_date"),
        F.lit(AS_OF).cast("timestamp_ntz").alias("updated_at"))
    return m.replace_columns(stored, batch, ["sprint_id"], {"created_at": AS_OF})


@query
def insert_ignore(t: Model) -> DataFrame:
    current = t.issues.filter(F.col("sprint_name").isNotNull()).select(
        "sprint_name", F.col("key").alias("issue_key"))
    history = t.changelog.filter(F.col("field") == "Sprint").select(
        F.explode(x.split_sprint_names(F.col("to_string"))).alias("sprint_name"), "issue_key")
    return m.insert_ignore(current, history, ["sprint_name", "issue_key"])


def _planned(t: Model) -> DataFrame:
    return t.issues.groupBy("sprint_id").agg(F.sum("reported_sp").alias("planned_sp"))


@query
def split_sprint_names(t: Model) -> DataFrame:
    names = x.split_sprint_names(F.col("to_string"))
    return t.changelog.select(
        "id", F.size(names).alias("n_names"), F.array_join(names, "|").alias("names"))


@query
def evolve_schema(t: Model) -> DataFrame:
    old = t.issues.drop("issuetype", "flagged")
    return m.evolve_schema(old, schemas.ISSUES, schemas.COLUMN_DEFAULTS["issues"])


def _run_log(t: Model) -> DataFrame:
    selected = src.sprints_to_sync(t.source_sprints, t.sprints)
    issues = t.issues.join(selected.select("sprint_id"), "sprint_id", "left_semi")
    keys = issues.select(F.col("key").alias("issue_key"))
    comments = t.comments.join(keys, "issue_key", "left_semi")
    return m.run_log(t.source_sprints, selected, issues, comments)


simple(
    recalculate_priorities=lambda t: m.recalculate_priorities(t.issues).select(
        "key", "summary", "issuetype", "priority"),
    priority_changes=lambda t: m.priority_changes(t.issues),
    create_snapshots=lambda t: m.create_snapshots(t.sprints, _planned(t), AS_OF)[0],
    create_snapshots_rejects=lambda t: m.create_snapshots(t.sprints, _planned(t), AS_OF)[1],
    weekly_metrics=lambda t: t.weekly,
    sprint_issues=lambda t: t.bridge,
    transition_snapshots=lambda t: m.transition_snapshots(
        t.sprints, t.registry_now, t.sprint_totals, AS_OF),
    backfill_snapshots=lambda t: m.backfill_snapshots(t.sprints, t.sprint_totals, AS_OF),
    snapshot_coverage=lambda t: m.snapshot_coverage(t.sprints, t.metadata),
    run_log=_run_log,
    sync_summary=lambda t: m.sync_summary(_run_log(t)),
    sufficiency_update=lambda t: m.sufficiency_update(t.history, t.future_sp, t.weekly, AS_OF),
)



def _issue_batch(t: Model) -> tuple[DataFrame, DataFrame]:
    """Stored issues, of which those touched since the watermark had another sprint, owner and size, and the batch's pairs."""
    touched = F.col("updated") >= WATERMARK
    stored = t.issues.filter(F.col("created") < WATERMARK).withColumns({
        "sprint_name": F.when(touched, "S0 ScrumA").otherwise(F.col("sprint_name")),
        "assignee": F.when(touched, "before").otherwise(F.col("assignee")),
        "reported_sp": F.when(touched, F.col("reported_sp") + 1.5).otherwise(F.col("reported_sp"))})
    return stored, m.merge_pairs(stored, t.issues.filter(touched), ["key"])


def _change_batch(t: Model) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The history up to the watermark, the pairs of a batch that brings the whole history of every issue changed since, and
    the history afterwards. One entry in a hundred was altered."""
    late = t.changelog.filter(F.col("created") >= WATERMARK).select("issue_key").distinct()
    columns = schemas.ISSUE_CHANGELOG.fieldNames()
    altered = F.coalesce(F.crc32(F.col("id").cast("binary")) % 100 == 0, F.lit(False))
    batch = t.changelog.join(late, "issue_key", "left_semi").select(*columns)
    early = t.changelog.filter(F.col("created") < WATERMARK)
    # Only entries that may have been altered need to meet the issues changed since.
    met = early.filter(altered).join(late.withColumn("late", F.lit(True)), "issue_key", "left").withColumn(
        "to_string", F.when(F.col("late") & (F.col("field") == "status"), "Done").when(F.col("late"), "S0 ScrumA").otherwise(
            F.col("to_string")))
    stored = early.filter(~altered).select(*columns).unionByName(met.select(*columns))
    return stored, m.merge_pairs(stored, m.newest_per_key(batch, ["id"]), ["id"]), m.upsert(stored, batch, ["id"])


@query
def weekly_metrics_incremental(t: Model) -> DataFrame:
    stored, pairs = _issue_batch(t)
    return m.weekly_of_sums(m.add_weekly(m.weekly_sums(stored), m.weekly_sums(m.signed_rows(pairs))))


@query
def sprint_issues_incremental(t: Model) -> DataFrame:
    stored, pairs = _issue_batch(t)
    history, changes, _ = _change_batch(t)
    state = m.membership_counts(stored, history)
    return m.add_memberships(state, m.membership_counts(m.signed_rows(pairs), m.signed_rows(changes))).drop("n")


@query
def completions_incremental(t: Model) -> DataFrame:
    history, changes, after = _change_batch(t)
    return m.completions_of_times(m.add_completions(m.completion_times(history), m.completion_delta(changes, after)))


# ── column expressions ──────────────────────────────────────────────────────────────────────

_today = x.as_date


@query
def sum_if_count_if(t: Model) -> DataFrame:
    done = F.col("status_category") == "完了"
    return t.issues.groupBy("board_name").agg(
        x.sum_if(done, F.col("reported_sp")).alias("done_sp"), x.count_if(done).alias("done_issues"))


@query
def safe_pct(t: Model) -> DataFrame:
    return t.issues.groupBy("sprint_id").agg(
        F.sum("reported_sp").alias("total"),
        x.sum_if(F.col("status_category") == "To Do", F.col("reported_sp")).alias("part"),
    ).select("sprint_id", x.safe_pct(F.col("total"), F.col("part")).alias("pct"))


simple(
    team_of=lambda t: t.issues.select("key", x.team_of().alias("team")),
    first_completed=lambda t: x.first_completed(t.changelog),
    last_completed=lambda t: x.last_completed(t.changelog),
    iso_week_label=lambda t: t.issues.select(
        "key", x.iso_week_label(F.col("created")).alias("week_label")),
    week_start=lambda t: t.issues.select("key", x.week_start(F.col("created")).alias("week_start")),
    other_sprint_count=lambda t: x.other_sprint_count(t.bridge),
    is_high_priority=lambda t: t.issues.select(
        "key", x.is_high_priority(F.col("summary"), F.col("priority")).alias("is_high_priority")),
    days_since_update=lambda t: t.issues.select(
        "key", x.days_since_update(F.col("updated"), _today(AS_OF)).alias("days")),
    priority_rank=lambda t: t.issues.select(
        "key", x.priority_rank(F.col("priority")).alias("rank"),
        x.urgency_rank(F.col("priority"), F.col("summary")).alias("list_rank"),
        x.urgency_rank(F.col("priority")).alias("urgency_rank")),
    issue_filter=lambda t: t.issues.filter(
        x.issue_filter("B Scrum", "Main Board", "1997-06-01")).select("key", "created"),
    needs_attention=lambda t: t.issues.filter(x.needs_attention(
        F.col("summary"), F.col("priority"), F.col("flagged"), F.col("status_category"))).select("key"),
    planned_value=lambda t: t.sprints.join(t.sprint_totals, "sprint_name", "left").select(
        "sprint_id", x.planned_value(F.col("planned_sp_snapshot"), F.col("total_sp")).alias("planned_sp")),
)

# ── reports ─────────────────────────────────────────────────────────────────────────────────

simple(
    issues_with_scores=lambda t: r.issues_with_scores(t.described_issues, t.scores),
    leaderboard=lambda t: r.leaderboard(t.issues),
    leaderboard_main_board=lambda t: r.leaderboard(t.issues, "Main Board", "1998-01-01"),
    leaderboard_last_week=lambda t: r.leaderboard_last_week(t.issues, t.changelog),
    leaderboard_last_3_weeks=lambda t: r.leaderboard_last_3_weeks(t.issues, t.changelog, "Main Board"),
    weekly_board_metrics=lambda t: r.weekly_board_metrics(t.weekly),
    weekly_assignee_metrics=lambda t: r.weekly_assignee_metrics(t.weekly, "AI Board"),
    weekly_assignee_metrics_all=lambda t: r.weekly_assignee_metrics(t.weekly),
    weekly_total=lambda t: r.weekly_total(t.weekly),
    latest_sufficiency=lambda t: r.latest_sufficiency(t.history),
    issue_count=lambda t: r.issue_count(t.issues),
    closed_sprint_ids=lambda t: r.closed_sprint_ids(t.sprints),
    avg_recent_velocity=lambda t: r.avg_recent_velocity(t.weekly),
    sufficiency=lambda t: r.sufficiency(t.weekly, t.future_sp),
    velocity_by_team=lambda t: r.velocity_by_team(t.issues, t.changelog),
    velocity_by_team_since=lambda t: r.velocity_by_team(t.issues, t.changelog, "1999-03-03"),
    individual_velocity=lambda t: r.individual_velocity(t.issues, t.changelog),
    team_summary=lambda t: r.team_summary(t.issues),
    recent_velocity_trend=lambda t: r.recent_velocity_trend(t.issues, t.changelog),
    active_sprints_progress=lambda t: s.active_sprints_progress(t.issues, t.sprints),
    assignee_load=lambda t: r.assignee_load(t.issues),
    assignee_load_team=lambda t: r.assignee_load(t.issues, "A Scrum"),
    status_breakdown=lambda t: r.status_breakdown(t.issues),
    priority_breakdown=lambda t: r.priority_breakdown(t.issues, "B Scrum", "1996-01-01"),
    priority_breakdown_all=lambda t: r.priority_breakdown(t.issues),
    issues_table=lambda t: r.issues_table(t.issues, t.changelog),
    sprint_achievement=lambda t: s.sprint_achievement(t.issues, t.bridge, t.sprints),
    sprint_achievement_team=lambda t: s.sprint_achievement(t.issues, t.bridge, t.sprints, "B Scrum"),
    sprint_achievement_timeline=lambda t: s.sprint_achievement_timeline(t.issues, t.bridge),
    sprint_registry=lambda t: s.sprint_registry(t.sprints, t.metadata),
    sprint_total_sp=lambda t: s.sprint_total_sp(t.issues, t.bridge),
    sprint_total_sp_partly_stored=lambda t: s.sprint_total_sp(
        t.issues.filter(F.col("created") < "1998-01-01"), t.bridge),
    active_sprint_details=lambda t: s.active_sprint_details(t.issues, t.sprints, t.metadata),
    active_sprint_issues=lambda t: s.active_sprint_issues(t.issues, t.sprints, t.changelog, AS_OF),
    sprint_daily_burndown=lambda t: s.sprint_daily_burndown(t.issues, t.sprints, t.changelog),
    sprint_member_workload=lambda t: s.sprint_member_workload(t.issues, t.sprints),
    high_priority_issues=lambda t: s.high_priority_issues(t.issues, t.sprints, AS_OF),
    stalled_issues=lambda t: s.stalled_issues(t.issues, t.sprints, AS_OF),
)

# ── derived metrics ─────────────────────────────────────────────────────────────────────────


def _velocity(t: Model) -> DataFrame:
    return r.velocity_by_team(t.issues, t.changelog, ordered=False)


def _individual(t: Model) -> DataFrame:
    return r.individual_velocity(t.issues, t.changelog, ordered=False)


def _recent(t: Model) -> DataFrame:
    return r.recent_velocity_trend(t.issues, t.changelog, ordered=False)


def _cells(pivot: DataFrame) -> DataFrame:
    """The matrix turned back into rows: its columns are the weeks of the data, which no fixed SQL can list."""
    return pivot.unpivot("assignee", [c for c in pivot.columns if c != "assignee"], "week_label", "done_sp")


def _achievement(t: Model) -> DataFrame:
    return s.sprint_achievement(t.issues, t.bridge, t.sprints, ordered=False)


simple(
    overall_kpis=lambda t: d.overall_kpis(r.team_summary(t.issues, ordered=False), _velocity(t)),
    trend_class=lambda t: d.trend_class(_recent(t)),
    week_over_week=lambda t: d.week_over_week(_recent(t)),
    team_velocity_stats=lambda t: d.team_velocity_stats(_velocity(t)),
    moving_average=lambda t: d.moving_average(_velocity(t)),
    sprint_health=lambda t: d.sprint_health(s.active_sprints_progress(t.issues, t.sprints, ordered=False)),
    achievement_kpis=lambda t: d.achievement_kpis(_achievement(t)),
    achievement_by_sprint=lambda t: rounded(
        d.achievement_by_sprint(_achievement(t)), "achievement_pct"),
    carryover_rate=lambda t: d.carryover_rate(_achievement(t)),
    load_per_member=lambda t: d.load_per_member(r.assignee_load(t.issues, ordered=False)),
    team_load_class=lambda t: d.team_load_class(r.assignee_load(t.issues, ordered=False)),
    status_share=lambda t: d.status_share(r.status_breakdown(t.issues, ordered=False)),
    assignee_ranking=lambda t: d.assignee_ranking(_individual(t)),
    assignee_mean_velocity=lambda t: rounded(
        d.assignee_mean_velocity(_individual(t)), "mean_velocity"),
    team_mean_velocity=lambda t: rounded(d.team_mean_velocity(_individual(t)), "team_mean"),
    individual_kpis=lambda t: rounded(
        d.individual_kpis(_individual(t)), "mean_individual_velocity", "overall_mean"),
    assignee_comparison=lambda t: d.assignee_comparison(_individual(t)),
    velocity_pivot=lambda t: _cells(d.velocity_pivot(_individual(t))),
    velocity_pivot_some_weeks=lambda t: d.velocity_pivot(_individual(t), ["1995-W40", "1996-W01"]),
    weekly_by_assignee_team=lambda t: d.weekly_by_assignee_team(_individual(t)),
    assignee_summary=lambda t: d.assignee_summary(_individual(t)),
    period_start=lambda t: r.velocity_by_team(
        t.issues, t.changelog, x.period_start(AS_OF, 180, "2001-03-01")),
    sufficiency_level=lambda t: d.sufficiency_level(r.latest_sufficiency(t.history)),
)

# ── scoring ─────────────────────────────────────────────────────────────────────────────────


class LengthScorer:
    """Stand-in for a real scorer: longer prompts are clearer, urgent ones are refused."""

    def __call__(self, prompt: str) -> tuple[str, float, str]:
        return self.read([prompt])

    def read(self, pieces: Iterable[str]) -> tuple[str, float, str]:
        length, last = 0, ""
        for piece in pieces:
            if "緊急" in last + piece:
                raise ValueError("urgent tickets are not scored")
            length, last = length + len(piece), piece[-1:] or last
        return f"length={length}", min(length, 4096) / 4096, "by length"


length_scorer = LengthScorer()


simple(
    comment_threads=lambda t: a.comment_threads(t.comments),
    scoring_prompts=lambda t: a.scoring_prompts(t.described_issues, t.comments),
    score_issues=lambda t: a.score_issues(
        a.scoring_prompts(t.described_issues, t.comments), length_scorer, AS_OF),
    sprint_mvp=lambda t: a.sprint_mvp(t.issues),
)


@query
def comment_threads_long(t: Model) -> DataFrame:
    """Threads of a third of the change history each, as size and digest."""
    threads = a.comment_threads(t.long_comments)
    return threads.select("issue_key", F.length("thread").alias("n_chars"), F.md5("thread").alias("digest"))


@query
def score_issues_long(t: Model) -> DataFrame:
    return a.score_issues(a.scoring_prompts(t.described_issues, t.long_comments, pieces=True), length_scorer, AS_OF)


@query
def run_scoring_scores(t: Model) -> DataFrame:
    store = TableStore(t.spark, shared_dir(t.spark, "scoring"))
    for table, rows in (("issues", t.described_issues), ("issue_comments", t.comments), ("ai_scores", t.scores)):
        store.write(table, rows)
    return run_scoring(store, length_scorer, AS_OF)
