"""One sync run: landed documents to new table versions, all sprints in one job per table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.expressions import as_timestamp
from ..operators import maintenance as m
from ..operators.scoring import Scorer, score_issues, scoring_prompts
from ..operators.sprint_reports import sprint_total_sp
from ..schemas import CORRUPT
from ..sources import raw as src
from ..sources.tables import TableStore, month_of
from ..vocab import DEFAULT, Vocabulary


def store_documents(store: TableStore, documents: DataFrame, vocab: Vocabulary = DEFAULT, batch: str | None = None) -> None:
    """Merge one batch of raw documents into issues, comments and change history, and what it changes into the
    weekly sums, the sprint memberships and the completions, all in one commit.

    An issue fetched for several sprints keeps its newest state; between equal states the lowest
    sprint id wins, which is the one a newest-first walk over the sprints would write last.
    A batch that is merged again finds nothing to change.
    """
    store.recover()
    documents = src.readable(documents)
    newest = [F.col("updated"), -F.col("sprint_id")]
    issues, issue_pairs = store.merged("issues", m.recalculate_priorities(src.ingest_issues(documents), vocab), newest)
    comments, _ = store.merged("issue_comments", src.ingest_comments(documents, vocab))
    changes, change_pairs = store.merged("issue_changelog", src.ingest_changelog(documents, vocab))

    before, after = m.signed_rows(issue_pairs, stored=True), m.signed_rows(change_pairs, stored=True)
    # A document brings its issue's history, so every entry's issue is in the batch. What is kept per issue lies in its part.
    places = issue_pairs.select(F.col("new.key").alias("issue_key"), F.col("new.part").alias("part"))
    placed = lambda rows: rows.join(places, "issue_key", "left").withColumn("part", F.coalesce("part", F.lit("none")))
    weekly = m.weekly_sums(before).withColumn("part", month_of("week_start"))
    history = None
    if not m.altered_issues(change_pairs).isEmpty():
        ids = change_pairs.select(F.col("new.id").alias("id"))
        history = store.read("issue_changelog").join(ids, "id", "left_anti").unionByName(change_pairs.select("new.*").drop("part"))
    store.commit({
        "issues": issues, "issue_comments": comments, "issue_changelog": changes,
        "weekly_sums": store.changed("weekly_sums", weekly, m.add_weekly),
        "memberships": store.changed("memberships", placed(m.membership_counts(before, after)), m.add_memberships),
        "completion_times": store.changed(
            "completion_times", placed(m.completion_delta(change_pairs, history, vocab)), m.add_completions),
    }, batch)


def rebuild_derived(store: TableStore) -> None:
    """Compute weekly sums, memberships and completions from the stored issues and history, for tables that were
    written by other means than ``store_documents``."""
    issues, changelog = store.read("issues"), store.read("issue_changelog")
    part = store.rows_with_part("issues").select(F.col("key").alias("issue_key"), "part")
    placed = lambda rows: rows.join(part, "issue_key", "left").withColumn("part", F.coalesce("part", F.lit("none")))
    tables = {
        "weekly_sums": m.weekly_sums(issues).withColumn("part", month_of("week_start")),
        "memberships": placed(m.membership_counts(issues, changelog)),
        "completion_times": placed(m.completion_times(changelog)),
    }
    store.commit(tables, whole=list(tables))


def run_sync(store: TableStore, raw_issues: DataFrame, raw_sprints: DataFrame, as_of: object,
             full: bool = False, vocab: Vocabulary = DEFAULT) -> DataFrame:
    """Bring every stored table up to date and return the run's one-row summary.

    The documents' tables are replaced in one commit and the sprints' in another. A run that ends in between is
    repeated: the first commit then changes nothing and the second is made. No step's lineage reaches
    behind stored files, and a lost executor costs only its own tasks.
    """
    source = src.unique_sprints(src.sprint_list(raw_sprints))
    store.recover()
    before = store.read("synced_sprints")
    selected = src.sprints_to_sync(source, before, full, vocab)
    wanted = raw_issues.join(selected.select("sprint_id"), "sprint_id", "left_semi")
    # The JSON is parsed once, five steps read the result.
    documents = store.written(src.readable(wanted).drop(CORRUPT), "documents")
    store_documents(store, documents, vocab)
    issues, bridge, weekly = (store.read(t) for t in ("issues", "sprint_issues", "weekly_metrics"))

    now = as_timestamp(as_of)
    dated = selected.select(
        "sprint_id", "sprint_name", F.left("start_date", F.lit(10)).alias("start_date"),
        F.left("end_date", F.lit(10)).alias("end_date"), now.alias("updated_at"))
    metadata = m.replace_columns(
        store.read("sprint_metadata"), dated, ["sprint_id"], {"created_at": str(as_of)})

    seen = selected.select(
        "sprint_id", "board_name", "sprint_name", "state", now.alias("synced_at"))
    registry = m.replace_columns(before, seen, ["sprint_id"]).join(
        source.select("sprint_id", "start_date"), "sprint_id", "left")
    taken_at = F.coalesce(F.col("s.start_date").cast("timestamp_ntz"), now)
    # Only sprints that start now need a total; the others' memberships are not joined.
    starting = registry.filter("state = 'active'").join(
        before.filter("state = 'active'").select("sprint_id"), "sprint_id", "left_anti").select("sprint_name")
    members = bridge.join(starting, "sprint_name", "left_semi")
    sprints = m.transition_snapshots(before, registry, sprint_total_sp(issues, members), taken_at)

    waiting = src.future_sprint_sp(raw_issues, source)
    history = m.sufficiency_update(store.read("sufficiency_snapshots"), waiting, weekly, as_of)
    tables = {"sprint_metadata": metadata, "synced_sprints": sprints, "sufficiency_snapshots": history}
    # The log compares with the registry as it was, so it is taken before that is replaced.
    log = store.written(m.run_log(source, selected, src.ingest_issues(documents), src.ingest_comments(documents)), "log")
    store.commit({t: store.parted(t, rows) for t, rows in tables.items()}, whole=list(tables))
    return m.sync_summary(log, src.ingest_rejects(raw_issues))


def run_scoring(store: TableStore, scorer: Scorer, at: object, calls_a_minute: float | None = None, tasks: int = 1) -> DataFrame:
    """Score the stored issues whose prompt was not scored before, keep the newest score of each, and return the stored scores.

    An issue is scored again when its prompt's digest differs from that of its last score, or when that failed. The scores
    are written before they are merged, so a scorer is not called again for a step that is repeated.
    See ``score_issues`` for ``calls_a_minute`` and ``tasks``.
    """
    store.recover()
    prompts = scoring_prompts(store.read("issues"), store.read("issue_comments")).withColumn("digest", F.sha2("prompt", 256))
    due = prompts.join(store.read("scored_prompts").select("issue_key", "digest"), ["issue_key", "digest"], "left_anti")
    fresh = store.written(score_issues(due, scorer, at, calls_a_minute, tasks, keep=["digest"]), "scores")
    known = fresh.filter("clarity_score is not null").select("issue_key", "analyzed_at", "digest")
    store.commit({"ai_scores": store.merged("ai_scores", fresh)[0], "scored_prompts": store.merged("scored_prompts", known)[0]})
    return store.read("ai_scores")
