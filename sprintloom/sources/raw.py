"""Landed issue-tracker documents to model tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.richtext import rich_text
from ..schemas import CORRUPT, RAW_SPRINTS, STORY_POINTS_FIELD, raw_issue_schema
from ..vocab import DEFAULT, Vocabulary

# JSON texts that count as "not flagged" (false, zero and empty values).
_FALSY_JSON = ("false", "null", "0", "0.0", "-0.0", '""', "[]", "{}")


def read_raw_issues(spark: SparkSession, path: str,
                    story_points_field: str = STORY_POINTS_FIELD) -> DataFrame:
    """JSON lines of ``{board_name, sprint_id, sprint_name, issue}``, never schema-inferred.

    Lines that cannot be read, or hold an issue without a key, come along; ``readable`` leaves them
    out and ``ingest_rejects`` lists them.
    """
    return spark.read.schema(raw_issue_schema(story_points_field)).option(
        "columnNameOfCorruptRecord", CORRUPT).json(path)


def _reject_reason(raw: DataFrame) -> Column:
    nameless = F.when(F.col("issue.key").isNull(), "no issue key")
    if CORRUPT not in raw.columns:
        return nameless
    return F.when(F.col(CORRUPT).isNotNull(), "unreadable line").otherwise(nameless)


def readable(raw: DataFrame) -> DataFrame:
    """The documents that can be stored: read without an error and with an issue key."""
    return raw.filter(_reject_reason(raw).isNull())


def ingest_rejects(raw: DataFrame) -> DataFrame:
    """``board_name, sprint_id, reason, line`` of every line that is not ``readable``.

    ``line`` is the text of an unreadable line and null for a document without a key.
    """
    line = F.col(CORRUPT) if CORRUPT in raw.columns else F.lit(None).cast("string")
    return raw.withColumn("reason", _reject_reason(raw)).filter("reason is not null").select(
        "board_name", "sprint_id", "reason", line.alias("line"))


def read_raw_sprints(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RAW_SPRINTS).json(path)


def _context(raw: DataFrame, name: str, given: object) -> Column:
    if given is None:
        return F.col(name)
    return F.lit(given).cast(raw.schema[name].dataType) if name in raw.columns else F.lit(given)


def _text(path: str) -> Column:
    return F.coalesce(F.col(path), F.lit(""))


def ingest_issues(raw: DataFrame, board: str | None = None, sprint_id: int | None = None,
                  sprint_name: str | None = None,
                  story_points_field: str = STORY_POINTS_FIELD) -> DataFrame:
    """Raw documents to ``issues`` rows. Board and sprint come with each line unless given."""
    fields = "issue.fields"
    flag = F.to_json(F.col(f"{fields}.flagged"))
    return raw.select(
        F.col("issue.key").alias("key"),
        _context(raw, "board_name", board).alias("board_name"),
        _context(raw, "sprint_id", sprint_id).cast("int").alias("sprint_id"),
        _context(raw, "sprint_name", sprint_name).alias("sprint_name"),
        _text(f"{fields}.summary").alias("summary"),
        F.col(f"{fields}.assignee.displayName").alias("assignee"),
        F.coalesce(F.col(f"{fields}.{story_points_field}"), F.lit(0.0)).alias("reported_sp"),
        _text(f"{fields}.status.name").alias("status"),
        _text(f"{fields}.status.statusCategory.name").alias("status_category"),
        _text(f"{fields}.priority.name").alias("priority"),
        _text(f"{fields}.issuetype.name").alias("issuetype"),
        F.col(f"{fields}.resolution.name").alias("resolution"),
        (flag.isNotNull() & ~flag.isin(*_FALSY_JSON)).alias("flagged"),
        F.col(f"{fields}.created").cast("timestamp_ntz").alias("created"),
        F.col(f"{fields}.updated").cast("timestamp_ntz").alias("updated"),
        rich_text(F.col(f"{fields}.description")).alias("description"),
    )


def ingest_comments(raw: DataFrame, vocab: Vocabulary = DEFAULT) -> DataFrame:
    return raw.select(
        F.col("issue.key").alias("issue_key"),
        F.explode("issue.fields.comment.comments").alias("comment"),
    ).select(
        F.col("comment.id").alias("id"),
        "issue_key",
        F.coalesce("comment.author.displayName", F.lit(vocab.unknown_author)).alias("author"),
        rich_text(F.col("comment.body")).alias("body"),
        F.col("comment.created").cast("timestamp_ntz").alias("created"),
    )


def ingest_changelog(raw: DataFrame, vocab: Vocabulary = DEFAULT) -> DataFrame:
    """One row per changed field; the id holds the item's position, so equal items stay apart."""
    histories = raw.select(
        F.col("issue.key").alias("issue_key"),
        F.explode("issue.changelog.histories").alias("history"),
    )
    return histories.select(
        "issue_key", "history", F.posexplode("history.items").alias("position", "item"),
    ).select(
        F.concat_ws("_", "issue_key", "history.id", F.col("position").cast("string")).alias("id"),
        "issue_key",
        F.coalesce("history.author.displayName", F.lit(vocab.unknown_author)).alias("author"),
        _text("item.field").alias("field"),
        F.col("item.fromString").alias("from_string"),
        F.col("item.toString").alias("to_string"),
        F.col("history.created").cast("timestamp_ntz").alias("created"),
    )


def sprint_list(raw_sprints: DataFrame) -> DataFrame:
    """Sprint pages to rows, newest first.

    Pages list a board's sprints oldest first, so (page, position) descending is newest first.
    Sprint ids break ties, which also lets the sort split a board with very many sprints.
    """
    return (
        raw_sprints.select("board_name", "page", F.posexplode("values").alias("position", "s"))
        .orderBy("board_name", F.desc("page"), F.desc("position"), F.desc("s.id"))
        .select(
            "board_name",
            F.col("s.id").alias("sprint_id"),
            F.col("s.name").alias("sprint_name"),
            _text("s.state").alias("state"),
            F.col("s.startDate").alias("start_date"),
            F.col("s.endDate").alias("end_date"),
            F.col("s.completeDate").alias("complete_date"),
        )
    )


def unique_sprints(source: DataFrame) -> DataFrame:
    """One row per sprint id. Boards may share a sprint: the last board by name wins."""
    rest = [c for c in source.columns if c != "sprint_id"]
    order = ["board_name"] if "board_name" in rest else []
    best = F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("_best")
    return source.groupBy("sprint_id").agg(best).select(
        *[F.col(c) if c == "sprint_id" else F.col(f"_best.{c}") for c in source.columns])


def sprints_to_sync(source: DataFrame, synced: DataFrame, full: bool = False,
                    vocab: Vocabulary = DEFAULT) -> DataFrame:
    """Source sprints that need loading, one row each: one already stored as closed is not read again."""
    known = unique_sprints(source).filter(F.col("state").isin(*vocab.sprint_states))
    if full:
        return known
    finished = synced.filter(F.col("state") == "closed").select("sprint_id")
    s, f = known.alias("s"), finished.alias("f")
    return s.join(
        f,
        (F.col("s.sprint_id") == F.col("f.sprint_id")) & (F.col("s.state") == "closed"),
        "left_anti",
    )


def future_sprint_sp(raw: DataFrame, sprints: DataFrame,
                     story_points_field: str = STORY_POINTS_FIELD) -> DataFrame:
    """Story points waiting in future sprints, as one row. Summed per sprint before the join.

    A document landed again counts once, in its newest state. A sprint on two boards counts for
    both, as each board plans it.
    """
    points = F.coalesce(F.col(f"issue.fields.{story_points_field}"), F.lit(0.0))
    newest = readable(raw).groupBy("board_name", "sprint_id", F.col("issue.key").alias("key")).agg(
        F.max(F.struct(F.col("issue.fields.updated").cast("timestamp_ntz").alias("updated"),
                       points.alias("sp"))).alias("newest"))
    per_sprint = newest.groupBy("sprint_id").agg(F.sum("newest.sp").alias("sp"))
    future = sprints.filter(F.col("state") == "future").select("sprint_id")
    return per_sprint.join(future, "sprint_id", "left_semi").agg(
        F.coalesce(F.sum("sp"), F.lit(0.0)).alias("future_sp"),
    )
