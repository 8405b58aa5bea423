"""Shared column expressions. Everything here stays inside generated JVM code."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, functions as F

from ..vocab import DEFAULT, TeamRule, Vocabulary
from .skew import counted_join, key_counts

# Every character a Unicode-aware strip removes (Spark's own trim only removes spaces).
WHITESPACE = "".join(chr(code) for code in range(0x3001) if chr(code).isspace())


def contains_any(text: Column, words: Iterable[str]) -> Column:
    return reduce(or_, [text.contains(word) for word in words])


def team_of(board: Column | None = None, sprint: Column | None = None,
            rule: TeamRule = DEFAULT.team_rule) -> Column:
    board = F.col("board_name") if board is None else board
    sprint = F.col("sprint_name") if sprint is None else sprint
    return (
        F.when(board == rule.ai_board, rule.ai_team)
        .when(contains_any(sprint, rule.b_markers), rule.b_team)
        .otherwise(rule.default_team)
    )


def week_start(day: Column) -> Column:
    """Monday of the week, as a date."""
    return F.trunc(day, "week")


def iso_week_label(day: Column) -> Column:
    """``YYYY-Www`` with the ISO year, which differs from the calendar year around New Year."""
    year = F.extract(F.lit("YEAROFWEEK"), day).cast("string")
    return F.concat(year, F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))


def sum_if(condition: Column, value: Column) -> Column:
    return F.sum(F.when(condition, value).otherwise(F.lit(0.0)))


def count_if(condition: Column) -> Column:
    """Rows where the condition holds; 0 rather than null on empty input."""
    return F.count_if(condition)


def safe_pct(numerator: Column, denominator: Column) -> Column:
    """Percentage with one decimal; null when the denominator is 0 or null."""
    return F.round(numerator / F.nullif(denominator, F.lit(0.0)) * 100, 1)


def pct_or_zero(numerator: Column, denominator: Column) -> Column:
    return F.coalesce(
        F.when(denominator > 0, F.round(numerator / F.nullif(denominator, F.lit(0.0)) * 100, 1)),
        F.lit(0.0),
    )


def round_sp(value: Column) -> Column:
    return F.round(value, 1)


def sort_if(df: DataFrame, ordered: bool, *keys: Column | str) -> DataFrame:
    """Reports come sorted; a caller that aggregates further saves the sort with ``ordered=False``
    (Spark keeps a sort below sums of doubles)."""
    return df.orderBy(*keys) if ordered else df


def planned_value(snapshot: Column, current: Column) -> Column:
    return F.coalesce(snapshot, current)


def days_since_update(updated: Column, as_of: Column) -> Column:
    return F.date_diff(as_of, updated.cast("date"))


def priority_rank(priority: Column, vocab: Vocabulary = DEFAULT) -> Column:
    """Sort key of the priority breakdown: Highest 1 … Lowest 5, anything else 6."""
    rank = F.lit(len(vocab.priorities) + 1)
    for position, name in reversed(list(enumerate(vocab.priorities, start=1))):
        rank = F.when(priority == name, position).otherwise(rank)
    return rank


def urgency_rank(priority: Column, summary: Column | None = None,
                 vocab: Vocabulary = DEFAULT) -> Column:
    """Sort key of the sprint lists: Highest 1, High 2, the rest 3.

    With a summary, an urgent word in it ranks like High.
    """
    first, second = vocab.urgent_priorities
    rank = F.when(priority == first, 1).when(priority == second, 2)
    if summary is not None:
        rank = rank.when(contains_any(summary, vocab.urgent_words), 2)
    return rank.otherwise(3)


def is_high_priority(summary: Column, priority: Column, vocab: Vocabulary = DEFAULT) -> Column:
    words = vocab.urgent_words + vocab.hotfix_words
    hit = contains_any(summary, words) | priority.isin(*vocab.urgent_priorities)
    return F.coalesce(hit, F.lit(False))


def needs_attention(summary: Column, priority: Column, flagged: Column, category: Column,
                    vocab: Vocabulary = DEFAULT) -> Column:
    """Open work that is urgent, defective or flagged (three-valued, for use in a filter)."""
    words = vocab.urgent_words + vocab.hotfix_words + vocab.defect_words
    return (category != vocab.done) & (
        priority.isin(*vocab.urgent_priorities) | contains_any(summary, words) | flagged
    )


def is_done_change(vocab: Vocabulary = DEFAULT) -> Column:
    """Changelog rows that move an issue to a final status; both tests reach the Parquet scan."""
    return (F.col("field") == "status") & F.col("to_string").isin(*vocab.done_statuses)


def issue_filter(team: str | None = None, board: str | None = None, date_from: object = None,
                 vocab: Vocabulary = DEFAULT) -> Column:
    """Conjunction of the optional report filters; nothing given keeps every row."""
    terms = [F.lit(True)]
    if team and team != vocab.all_teams:
        terms.append(team_of(rule=vocab.team_rule) == team)
    if board:
        terms.append(F.col("board_name") == board)
    if date_from is not None:
        terms.append(F.col("created") >= as_timestamp(date_from))
    return reduce(and_, terms)


def as_date(value: object) -> Column:
    """A date column from a date, an ISO string or a column."""
    return (value if isinstance(value, Column) else F.lit(str(value))).cast("date")


def as_timestamp(value: object) -> Column:
    return (value if isinstance(value, Column) else F.lit(str(value))).cast("timestamp_ntz")


def period_start(as_of: object, days: int, floor: object) -> Column:
    """First day of a report period that never reaches behind ``floor``; 0 days means all."""
    if days <= 0:
        return as_date(floor)
    return F.greatest(F.date_sub(as_date(as_of), days), as_date(floor))


def strip(text: Column) -> Column:
    """Without white space at both ends. Most texts have none there, and looking at the two outer
    characters costs far less than a trim against the whole list."""
    listed = F.lit(WHITESPACE)
    outer = listed.contains(F.left(text, F.lit(1))) | listed.contains(F.right(text, F.lit(1)))
    return F.when(outer, F.btrim(text, listed)).otherwise(text)


def split_sprint_names(names: Column) -> Column:
    """Names in a ", "-separated list, stripped, blanks dropped; null gives an empty array."""
    parts = F.split(F.coalesce(names, F.lit("")), ", ")
    return F.filter(F.transform(parts, strip), lambda part: part != "")


# ── frames built straight from the expressions above ────────────────────────────────────────


def _completed(changelog: DataFrame, pick, vocab: Vocabulary) -> DataFrame:
    return (
        # The null test is what joins on the key imply; written out, all uses share one shuffle.
        changelog.filter(is_done_change(vocab) & F.col("issue_key").isNotNull())
        .groupBy("issue_key")
        .agg(pick("created").cast("date").alias("completed_date"))
    )


def first_completed(changelog: DataFrame, vocab: Vocabulary = DEFAULT) -> DataFrame:
    """First day each issue reached a done status (velocity is dated by it)."""
    return _completed(changelog, F.min, vocab)


def last_completed(changelog: DataFrame, vocab: Vocabulary = DEFAULT) -> DataFrame:
    """Last such day, shown in the issue table."""
    return _completed(changelog, F.max, vocab)


def completions(changelog: DataFrame, vocab: Vocabulary = DEFAULT) -> DataFrame:
    """First and last day in one pass, for reports that share the result."""
    done = changelog.filter(is_done_change(vocab) & F.col("issue_key").isNotNull())
    return done.groupBy("issue_key").agg(
        F.min("created").cast("date").alias("completed_date"),
        F.max("created").cast("date").alias("last_completed_date"))


def other_sprint_count(sprint_issues: DataFrame) -> DataFrame:
    """Each membership with the number of other sprints that hold the same issue.

    A pre-aggregate joined back rather than a window, which would put one issue's whole history
    into one task.
    """
    counts = key_counts(sprint_issues)
    return counted_join(sprint_issues, None, counts, "sprint_name").select(
        "sprint_name", "issue_key", (F.col("n") - 1).alias("other_sprint_count"))
