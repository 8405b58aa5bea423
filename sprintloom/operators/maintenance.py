"""Table maintenance: each operator computes the new content of a table.

Nothing is updated in place; the caller writes the result as a new version.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.expressions import (
    as_date, as_timestamp, contains_any, is_done_change, strip, week_start,
)
from ..vocab import DEFAULT, Vocabulary
from .reports import avg_recent_velocity


def newest_per_key(rows: DataFrame, keys: Sequence[str], order_by: Sequence[str | Column] | None = None) -> DataFrame:
    """One row per key, rows without a whole key left out: the one with the greatest ordering, remaining columns
    break ties. The ordering defaults to ``updated``, ``analyzed_at`` or ``created``, the first that is present.

    A maximum over a struct is combined before the shuffle, so a key repeated very often in one
    batch costs its task one row per input partition.
    """
    rows = rows.filter(reduce(and_, [F.col(k).isNotNull() for k in keys]))
    order = [F.col(c) if isinstance(c, str) else c for c in _ordering(rows, keys, order_by)]
    rank = F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(order)])
    rest = [c for c in rows.columns if c not in keys]
    if not rest:
        return rows.distinct()
    best = F.max(F.struct(rank.alias("_rank"), *rest)).alias("_best")
    return rows.groupBy(*keys).agg(best).select(
        *[F.col(c) if c in keys else F.col(f"_best.{c}") for c in rows.columns]
    )


def _ordering(rows: DataFrame, keys: Sequence[str], order_by: Sequence[str | Column] | None) -> Sequence[str | Column]:
    if order_by is None:
        return [c for c in ("updated", "analyzed_at", "created") if c in rows.columns][:1] or keys[:1]
    return order_by


def merge_pairs(target: DataFrame, batch: DataFrame, keys: Sequence[str],
                order_by: Sequence[str | Column] | None = None) -> DataFrame:
    """``old, new`` for each row of a batch with unique keys: the stored row, null if there is none, and the row
    that is to stand. A stored row that is newer by the first ordering stays; between equals the batch wins.

    The target meets the batch's keys in a semi join, so a batch that Spark can broadcast costs one
    scan of the target and no shuffle of it; only the rows that match go on.
    """
    first = _ordering(batch, keys, order_by)[0]
    first = F.col(first) if isinstance(first, str) else first
    found = target.join(batch.select(*keys), list(keys), "left_semi")
    old = found.select(*[F.col(k).alias(f"_{k}") for k in keys], first.alias("_old"), F.struct(*target.columns).alias("old"))
    new = batch.select(*keys, first.alias("_new"), F.struct(*target.columns).alias("_given"))
    both = new.join(old, reduce(and_, [F.col(k) == F.col(f"_{k}") for k in keys]), "left")
    newer = F.coalesce(F.col("_old") > F.col("_new"), F.col("_new").isNull() & F.col("_old").isNotNull())
    return both.select("old", F.when(F.col("old").isNotNull() & newer, F.col("old")).otherwise(F.col("_given")).alias("new"))


def upsert(target: DataFrame, updates: DataFrame, keys: Sequence[str],
           order_by: Sequence[str | Column] | None = None) -> DataFrame:
    """Replace matching rows by the batch and add the new ones, columns matched by name.

    A key repeated inside the batch keeps its newest row, see ``newest_per_key``; see ``merge_pairs`` for what
    happens to a stored row that is newer. All other rows of the target pass through an anti join
    against the batch's keys: a small batch is broadcast and the target is neither shuffled nor sorted.
    """
    batch = newest_per_key(updates, keys, order_by)
    standing = target.join(batch.select(*keys), list(keys), "left_anti")
    return standing.select(*target.columns).unionByName(merge_pairs(target, batch, keys, order_by).select("new.*"))


def replace_columns(target: DataFrame, updates: DataFrame, keys: Sequence[str],
                    defaults: Mapping[str, object] | None = None) -> DataFrame:
    """Insert or replace only the columns the batch has; others keep what the table holds.

    New rows take ``defaults`` for columns the batch lacks. Of rows that repeat a key the greatest,
    column by column, counts.
    """
    defaults = defaults or {}
    listed = set(updates.columns)
    updates = newest_per_key(updates, keys, keys[:1])
    t = target.withColumn("_in_target", F.lit(True)).alias("t")
    u = updates.withColumn("_in_batch", F.lit(True)).alias("u")
    on = [F.col(f"t.{k}") == F.col(f"u.{k}") for k in keys]

    def column(name: str) -> Column:
        old, dtype = F.col(f"t.{name}"), target.schema[name].dataType
        if name in keys:
            return F.coalesce(old, F.col(f"u.{name}")).cast(dtype)
        if name in listed:
            return F.when(F.col("u._in_batch"), F.col(f"u.{name}").cast(dtype)).otherwise(old)
        if name in defaults:
            return F.when(F.col("t._in_target"), old).otherwise(F.lit(defaults[name]).cast(dtype))
        return old

    return t.join(u, on, "full_outer").select(*[column(c).alias(c) for c in target.columns])


def insert_ignore(target: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add rows whose key the table lacks; a key repeated among them is taken once."""
    rest = [c for c in rows.columns if c not in keys]
    if rest:
        one = rows.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_row")).select(
            *keys, *[F.col(f"_row.{c}") for c in rest])
    else:
        one = rows.distinct()
    fresh = one.join(target.select(*keys), list(keys), "left_anti")
    return target.unionByName(fresh.select(*target.columns))


# ── priorities ──────────────────────────────────────────────────────────────────────────────


def _to_raise(vocab: Vocabulary) -> Column:
    # A null priority makes the inequality null, so such a row is never raised.
    summary = F.col("summary")
    return ~F.col("priority").isin(*vocab.urgent_priorities) & (
        contains_any(summary, vocab.raise_words)
        | contains_any(F.lower(summary), vocab.raise_words_any_case)
        | F.lower(F.col("issuetype")).isin(*vocab.raise_types)
    )


def recalculate_priorities(issues: DataFrame, vocab: Vocabulary = DEFAULT) -> DataFrame:
    """Raise urgent-worded and defect issues to High unless they already rank that high."""
    raised = F.when(_to_raise(vocab), F.lit(vocab.raised_priority)).otherwise(F.col("priority"))
    return issues.withColumn("priority", raised)


def priority_changes(issues: DataFrame, vocab: Vocabulary = DEFAULT) -> DataFrame:
    """Number of rows ``recalculate_priorities`` changes."""
    return issues.agg(F.count_if(_to_raise(vocab)).alias("changed"))


# ── sprint snapshots ────────────────────────────────────────────────────────────────────────


def _with_snapshot(sprints: DataFrame, take: Column, value: Column, at: Column) -> list[Column]:
    return [
        F.when(take, value).otherwise(F.col("s.planned_sp_snapshot")).alias(c)
        if c == "planned_sp_snapshot"
        else F.when(take, at).otherwise(F.col("s.snapshot_created_at")).alias(c)
        if c == "snapshot_created_at"
        else F.col(f"s.{c}")
        for c in sprints.columns
    ]


def create_snapshots(sprints: DataFrame, totals: DataFrame, at: object) -> tuple[DataFrame, DataFrame]:
    """Write-once planned story points: (new registry, rejected requests).

    ``totals`` holds (sprint_id, planned_sp). A request for a sprint that already has a snapshot
    is rejected; one for an unknown sprint changes nothing.
    """
    s, t = sprints.alias("s"), totals.alias("t")
    same = F.col("s.sprint_id") == F.col("t.sprint_id")
    take = F.col("t.planned_sp").isNotNull() & F.col("s.planned_sp_snapshot").isNull()
    registry = s.join(t, same, "left").select(
        *_with_snapshot(sprints, take, F.col("t.planned_sp"), as_timestamp(at)))
    rejects = t.join(s, same & F.col("s.planned_sp_snapshot").isNotNull()).select(
        "t.sprint_id", "t.planned_sp",
        # Fixed value: the message that callers of the registry look for.
        F.concat(F.lit("Snapshot already exists for sprint "),
                 F.col("t.sprint_id").cast("string")).alias("reason"),
    )
    return registry, rejects


def _snapshot_where(sprints: DataFrame, totals: DataFrame, wanted: Column, at: Column) -> DataFrame:
    """Snapshot the wanted sprints that have none; a sprint without issues is planned at 0."""
    s, t = sprints.alias("s"), totals.alias("t")
    take = wanted & F.col("s.planned_sp_snapshot").isNull()
    value = F.coalesce(F.col("t.total_sp"), F.lit(0.0))
    return s.join(t, F.col("s.sprint_name") == F.col("t.sprint_name"), "left").select(
        *_with_snapshot(sprints, take, value, at))


def transition_snapshots(prev: DataFrame, new: DataFrame, totals: DataFrame, at: object) -> DataFrame:
    """New registry with a snapshot for each sprint that has just become active.

    ``totals`` holds (sprint_name, total_sp). Snapshots already taken are carried over.
    """
    p, n = prev.alias("p"), new.alias("n")
    carried = n.join(p, F.col("n.sprint_id") == F.col("p.sprint_id"), "left").select(
        *[F.coalesce(F.col(f"n.{c}"), F.col(f"p.{c}")).alias(c)
          if c in ("planned_sp_snapshot", "snapshot_created_at") else F.col(f"n.{c}")
          for c in new.columns],
        F.col("p.state").alias("_before"),
    )
    started = (F.col("s.state") == "active") & ~F.col("s._before").eqNullSafe("active")
    return _snapshot_where(carried, totals, started, as_timestamp(at)).drop("_before")


def backfill_snapshots(sprints: DataFrame, totals: DataFrame, at: object) -> DataFrame:
    """Snapshot every active or closed sprint that has none, at today's total."""
    wanted = F.col("s.state").isin("active", "closed")
    return _snapshot_where(sprints, totals, wanted, as_timestamp(at))


def snapshot_coverage(sprints: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    counts = sprints.agg(
        F.count("planned_sp_snapshot").alias("snapshots"),
        F.count_if(F.col("state").isin("active", "closed")).alias("active_or_closed"),
    ).withColumn("missing", F.col("active_or_closed") - F.col("snapshots"))
    if metadata is None:
        return counts
    return counts.withColumn("metadata_records", metadata.agg(F.count("*")).scalar())


# ── derived tables ──────────────────────────────────────────────────────────────────────────


def weekly_metrics(issues: DataFrame) -> DataFrame:
    return (
        issues.filter(F.col("assignee").isNotNull())
        .groupBy(week_start(F.col("created")).alias("week_start"), "board_name", "assignee")
        .agg(F.sum("reported_sp").alias("reported_sp"), F.count("*").alias("issue_count"))
    )


def sprint_issues(issues: DataFrame, changelog: DataFrame) -> DataFrame:
    """Every (sprint, issue) pair that holds now or held at some time.

    Both name lists of a history row are joined by their own separator and split once; stripping
    and dropping blanks happen after the explode, where they are part of the generated code. The
    distinct is combined on the map side, so a much-edited issue shuffles each pair once per task.
    """
    current = issues.filter(F.col("sprint_name") != "").select(
        "sprint_name", F.col("key").alias("issue_key"))
    both = F.concat_ws(", ", "from_string", "to_string")
    history = (
        changelog.filter(F.col("field") == "Sprint")
        .select(F.explode(F.split(both, ", ")).alias("name"), "issue_key")
        .select(strip(F.col("name")).alias("sprint_name"), "issue_key")
        .filter(F.col("sprint_name") != "")
    )
    return current.unionByName(history).distinct()


# ── derived tables, kept up to date by what a batch changes ───────────────────────────────────


def signed_rows(pairs: DataFrame, stored: bool = False) -> DataFrame:
    """The rows that ``merge_pairs`` takes out, with ``sign`` -1, and puts in, with 1; pairs that are alike give none.

    Pairs that are ``stored`` are read once for the rows that go and once for those that come, each time only the
    columns that are used; others are computed once.
    """
    changed = pairs.filter(~F.col("old").eqNullSafe(F.col("new")))
    if stored:
        gone, come = (changed.filter(f"{row} is not null").select(f"{row}.*", F.lit(sign).alias("sign")) for row, sign in (("old", -1), ("new", 1)))
        return gone.unionByName(come)
    both = F.array(F.struct(F.lit(-1).alias("sign"), F.col("old").alias("row")), F.struct(F.lit(1).alias("sign"), F.col("new").alias("row")))
    return changed.select(F.explode(both).alias("_e")).filter("_e.row is not null").select("_e.row.*", "_e.sign")


def weekly_sums(rows: DataFrame) -> DataFrame:
    """Story points and issues by week, board and assignee of ``rows``, which may have a ``sign``.

    Sums are decimal, so what was added can be taken out again without a trace; points are rounded to six digits.
    """
    sign = F.col("sign") if "sign" in rows.columns else F.lit(1)
    points = F.expr("try_cast(reported_sp AS DECIMAL(28,6))")
    return (
        rows.filter(F.col("assignee").isNotNull())
        .groupBy(week_start(F.col("created")).alias("week_start"), "board_name", "assignee")
        .agg(F.sum(F.when(sign > 0, points).otherwise(-points)).alias("points"),
             F.sum(F.when(points.isNotNull(), sign).otherwise(0)).alias("n_points"),
             F.sum(sign).alias("issue_count"))
        .withColumn("points", F.coalesce(F.col("points"), F.lit(0)).cast("decimal(38,6)"))
        .filter("issue_count <> 0 OR n_points <> 0 OR points <> 0")
    )


def add_weekly(state: DataFrame, delta: DataFrame) -> DataFrame:
    """``weekly_sums`` after a batch: sums without an issue go."""
    both = state.select(*delta.columns).unionByName(delta)
    return both.groupBy(*[c for c in delta.columns if c not in ("points", "n_points", "issue_count")]).agg(
        F.sum("points").cast("decimal(38,6)").alias("points"), F.sum("n_points").alias("n_points"),
        F.sum("issue_count").alias("issue_count")).filter("issue_count <> 0")


def weekly_of_sums(state: DataFrame) -> DataFrame:
    """``weekly_metrics`` as ``weekly_sums`` has it."""
    points = F.when(F.col("n_points") > 0, F.col("points").cast("double"))
    return state.select("week_start", "board_name", "assignee", points.alias("reported_sp"), "issue_count")


def membership_counts(issues: DataFrame, changelog: DataFrame) -> DataFrame:
    """How often each (sprint, issue) pair is stated, now or in history; rows may have a ``sign``."""
    sign = lambda rows: F.col("sign") if "sign" in rows.columns else F.lit(1).alias("sign")
    current = issues.filter(F.col("sprint_name") != "").select("sprint_name", F.col("key").alias("issue_key"), sign(issues))
    both = F.concat_ws(", ", "from_string", "to_string")
    history = (
        changelog.filter(F.col("field") == "Sprint")
        .select(F.explode(F.split(both, ", ")).alias("name"), "issue_key", sign(changelog))
        .select(strip(F.col("name")).alias("sprint_name"), "issue_key", "sign")
        .filter(F.col("sprint_name") != "")
    )
    return current.unionByName(history).groupBy("sprint_name", "issue_key").agg(
        F.sum("sign").alias("n")).filter("n <> 0")


def add_memberships(state: DataFrame, delta: DataFrame) -> DataFrame:
    """``membership_counts`` after a batch: a pair that nothing states any more goes."""
    both = state.select(*delta.columns).unionByName(delta)
    return both.groupBy(*[c for c in delta.columns if c != "n"]).agg(F.sum("n").alias("n")).filter("n <> 0")


def completion_times(changelog: DataFrame, vocab: Vocabulary = DEFAULT) -> DataFrame:
    """First and last time each issue reached a done status, and how often: all three can be merged."""
    done = changelog.filter(is_done_change(vocab) & F.col("issue_key").isNotNull())
    return done.groupBy("issue_key").agg(
        F.min("created").alias("first_done"), F.max("created").alias("last_done"), F.count("*").alias("n_done"))


def altered_issues(changes: DataFrame) -> DataFrame:
    """``issue_key`` of stored history entries that the pairs ``changes`` replace by others."""
    return changes.filter(F.col("old").isNotNull() & ~F.col("old").eqNullSafe(F.col("new"))).select(
        F.explode(F.array("old.issue_key", "new.issue_key")).alias("issue_key")).filter("issue_key is not null").distinct()


def completion_delta(changes: DataFrame, history: DataFrame | None = None, vocab: Vocabulary = DEFAULT) -> DataFrame:
    """What the pairs ``changes`` of the change history do to ``completion_times``.

    Entries that are new are merged. A tracker does not alter entries as a rule; one that was altered may have been
    an issue's first or last, so such issues, and no others, are computed again from ``history``, the
    new content of the history, and are ``renewed``. Without ``history`` no entry may be altered.
    """
    added = completion_times(changes.filter("old is null").select("new.*"), vocab).withColumn("renewed", F.lit(False))
    if history is None:
        return added
    altered = altered_issues(changes)
    times = completion_times(history.join(altered, "issue_key", "left_semi"), vocab)
    again = altered.join(times, "issue_key", "left").withColumns({"n_done": F.coalesce("n_done", F.lit(0)), "renewed": F.lit(True)})
    return added.join(altered, "issue_key", "left_anti").unionByName(again)


def add_completions(state: DataFrame, delta: DataFrame) -> DataFrame:
    """``completion_times`` after a batch's ``completion_delta``."""
    columns = [c for c in delta.columns if c != "renewed"]
    stay = state.select(*columns).join(delta.filter("renewed").select("issue_key"), "issue_key", "left_anti")
    return stay.unionByName(delta.drop("renewed")).groupBy(*[c for c in columns if not c.endswith("_done")]).agg(
        F.min("first_done").alias("first_done"), F.max("last_done").alias("last_done"),
        F.sum("n_done").alias("n_done")).filter("n_done > 0")


def completions_of_times(state: DataFrame) -> DataFrame:
    """``completions`` as ``completion_times`` has them."""
    return state.select("issue_key", F.col("first_done").cast("date").alias("completed_date"),
                        F.col("last_done").cast("date").alias("last_completed_date"))


def evolve_schema(df: DataFrame, schema: T.StructType,
                  defaults: Mapping[str, object] | None = None) -> DataFrame:
    """Add the columns an older table lacks, with their defaults, in schema order.

    Columns the schema does not know are kept behind the others.
    """
    defaults = defaults or {}
    known = [
        F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns
        else F.lit(defaults.get(f.name)).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ]
    return df.select(*known, *[c for c in df.columns if c not in schema.fieldNames()])


# ── sync run ────────────────────────────────────────────────────────────────────────────────


def run_log(source: DataFrame, selected: DataFrame, issues: DataFrame, comments: DataFrame) -> DataFrame:
    """One row per source sprint: outcome plus the rows this run took in.

    ``issues`` and ``comments`` are the run's ingested rows. They are counted per issue and then
    per sprint before any join, so neither side carries raw rows into it. ``error`` marks a
    selected sprint whose source row has no name.
    """
    # An issue fetched for two sprints brings each of its comments twice.
    per_issue = comments.groupBy("issue_key").agg(F.count_distinct("id").alias("n_comments"))
    # An issue landed twice for a sprint, or for two boards, is one issue of it.
    keys = issues.select("sprint_id", "key").distinct().withColumn("n_issues", F.lit(1))
    loaded = (
        keys.join(per_issue, F.col("key") == F.col("issue_key"), "left")
        .groupBy("sprint_id")
        .agg(F.sum("n_issues").alias("issues"),
             F.coalesce(F.sum("n_comments"), F.lit(0)).alias("comments"))
    )
    picked = selected.select("sprint_id").withColumn("_selected", F.lit(True))
    outcome = (
        F.when(F.col("_selected") & F.col("sprint_name").isNull(), "error")
        .when(F.col("_selected"), "synced")
        .when(F.col("state") == "closed", "skipped")
        .otherwise("ignored")
    )
    taken = F.col("outcome") == "synced"
    return (
        source.join(picked, "sprint_id", "left")
        .join(loaded, "sprint_id", "left")
        .withColumn("outcome", outcome)
        .select(
            "sprint_id", "sprint_name", "state", "outcome",
            F.when(taken, F.coalesce("issues", F.lit(0))).otherwise(0).alias("issues"),
            F.when(taken, F.coalesce("comments", F.lit(0))).otherwise(0).alias("comments"),
        )
    )


def sync_summary(log: DataFrame, rejects: DataFrame | None = None) -> DataFrame:
    """Totals of one run, one row. Each rejected line counts as an error."""
    errors = F.count_if(F.col("outcome") == "error")
    if rejects is not None:
        errors = errors + rejects.agg(F.count("*")).scalar()
    return log.agg(
        F.coalesce(F.sum("issues"), F.lit(0)).alias("issues"),
        F.coalesce(F.sum("comments"), F.lit(0)).alias("comments"),
        F.count_if(F.col("outcome") == "skipped").alias("skipped"),
        errors.alias("errors"),
    )


def sufficiency_row(future_sp: DataFrame, weekly: DataFrame, as_of: object) -> DataFrame:
    """Today's history row. ``future_sp`` is a one-row frame; the ratio stays unrounded."""
    velocity = F.col("avg_velocity")
    return (
        future_sp.select("future_sp")
        .withColumn("avg_velocity", avg_recent_velocity(weekly).scalar())
        .select(
            as_date(as_of).alias("snapshot_date"),
            "future_sp",
            "avg_velocity",
            F.coalesce(
                F.when(velocity > 0, F.col("future_sp") / F.nullif(velocity, F.lit(0.0)) * 100),
                F.lit(0.0),
            ).alias("sufficiency"),
        )
    )


def sufficiency_update(history: DataFrame, future_sp: DataFrame, weekly: DataFrame,
                       as_of: object) -> DataFrame:
    """History with today's row added, or replaced when the day is already there."""
    return replace_columns(history, sufficiency_row(future_sp, weekly, as_of), ["snapshot_date"])
