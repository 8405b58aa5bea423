"""Scoring of issues by a function the caller supplies."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import chain, groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.expressions import as_timestamp
from ..functions.skew import HOT_SHARE
from ..schemas import AI_SCORES
from .reports import leaderboard

# A scorer takes one prompt and returns (reasoning, clarity between 0 and 1, notes). One that has a method ``read`` takes
# a prompt given in pieces through it, as an iterator of texts, so that the prompt is never held as a whole.
Scorer = Callable[[str], tuple[str, float, str]]

PROMPT = (
    "Judge how clearly this ticket states the work.\n"
    "key: %s\nsummary: %s\npoints: %s\nstatus: %s\nassignee: %s\n"
    "description:\n%s\ncomments:\n%s\n"
    "Answer with the reasoning on complexity, a clarity score from 0 (vague) to 1 (clear) and notes."
)


NO_COMMENTS = "(no comments)"

# Comments on an issue within an hour are divided when they are more than this and more than a thousandth of all comments,
# at about so many places.
LONG_HOUR, PLACES = 8192, 256


def _divided(comments: DataFrame) -> DataFrame:
    """The comments with ``hour`` and ``slice``, which together follow the order of time and id.

    An issue's hour that is hot is divided at the (time, id) of a sample of its comments, chosen by a hash, so equal
    parts of the sample's order hold about equal numbers of comments, even if all have one time. Fewer than a
    thousand hours are hot, by construction, which bounds what is broadcast.
    """
    hour = F.expr("timestampdiff(HOUR, TIMESTAMP_NTZ'1970-01-01', created)")
    hours = comments.withColumn("hour", F.coalesce(hour, F.lit(-(1 << 62))))
    counts = hours.groupBy("issue_key", "hour").agg(F.count("*").alias("n"))
    large = (F.col("n") > LONG_HOUR) & (F.col("n") * HOT_SHARE > counts.agg(F.sum("n")).scalar())
    keys = ["issue_key", "hour"]
    place = F.struct("created", "id")
    chosen = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / PLACES)) == 0
    places = hours.select(*keys, "created", "id").join(F.broadcast(counts.filter(large)), keys).filter(chosen).groupBy(*keys).agg(
        F.sort_array(F.collect_list(place)).alias("places"))
    before = F.size(F.filter("places", lambda p: p <= place))
    return hours.join(F.broadcast(places), keys, "left").withColumn(
        "slice", F.when(F.col("places").isNull(), 0).otherwise(before)).drop("places")


def thread_pieces(comments: DataFrame) -> DataFrame:
    """``issue_key, hour, slice, lines``: the threads in pieces, an hour each or a part of it where an hour is hot."""
    line = F.concat(F.lit("- "), F.col("author"), F.lit(": "), F.col("body"))
    return _divided(comments.select("issue_key", "created", "id", line.alias("line"))).groupBy(
        "issue_key", "hour", "slice").agg(F.expr("listagg(line, '\\n') WITHIN GROUP (ORDER BY created, id)").alias("lines"))


def comment_threads(comments: DataFrame) -> DataFrame:
    """One thread per issue: "- author: body" lines in order of time, then id; null times first.

    Lines are put together per hour, or a part of it where an hour is hot, and then per issue, so no sort holds all
    single comments of a much-discussed issue. The thread itself is one cell by definition: one beyond what a cell
    can hold fails the job rather than being cut. ``thread_pieces`` has no such bound.
    """
    return thread_pieces(comments).groupBy("issue_key").agg(
        F.expr("listagg(lines, '\\n') WITHIN GROUP (ORDER BY hour, slice)").alias("thread"))


def _or_else(column: str, fallback: str) -> Column:
    """The text, or the fallback when it is null or empty."""
    return F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(fallback))


def scoring_prompts(issues: DataFrame, comments: DataFrame, template: str = PROMPT, pieces: bool = False) -> DataFrame:
    """One prompt per issue. The template takes key, summary, points, status, assignee, description
    and comments, in this order.

    With ``pieces`` the prompts come as ``prompt_pieces``, for threads of any length.
    """
    if pieces:
        return prompt_pieces(issues, comments, template)
    rows = issues.join(comment_threads(comments), F.col("key") == F.col("issue_key"), "left")
    return rows.select(F.col("key").alias("issue_key"), F.format_string(
        template, *_filled(), _or_else("thread", NO_COMMENTS)).alias("prompt"))


def _filled() -> list[Column]:
    """What the template takes before the comments."""
    return [
        F.col("key"), F.coalesce("summary", F.lit("")), F.coalesce("reported_sp", F.lit(0.0)).cast("string"),
        F.coalesce("status", F.lit("")), _or_else("assignee", "Unassigned"), _or_else("description", "(no description)"),
    ]


def _around_comments(template: str) -> tuple[str, str]:
    """The template up to the place of the comments, and the text behind it."""
    places = [m for m in re.finditer("%.", template, re.DOTALL) if m[0] not in ("%%", "%n")]
    if [m[0] for m in places] != ["%s"] * 7:
        raise ValueError("a template of prompts in pieces takes its seven texts by a plain %s each")
    return template[:places[6].start()], template[places[6].end():].replace("%n", "\n").replace("%%", "%")


def prompt_pieces(issues: DataFrame, comments: DataFrame, template: str = PROMPT) -> DataFrame:
    """``issue_key, prompt_id, hour, slice, piece, behind``: the prompts in pieces, in order of hour (null first) and slice.

    The first piece is all that comes before the comments, once for each row of the issue, and the others are
    those of the issue's thread. ``behind`` is what follows the last one, stated with the first. Rows of one key that differ
    have their own ``prompt_id``.
    """
    before, behind = _around_comments(template)
    heads = issues.select(F.col("key").alias("issue_key"), F.format_string(before, *_filled()).alias("piece"))
    heads = heads.withColumn("prompt_id", F.md5("piece"))
    threads = thread_pieces(comments).filter("lines is not null").join(heads.select("issue_key", "prompt_id").distinct(), "issue_key")
    opening = heads.select("issue_key", "prompt_id", F.lit(None).cast("long").alias("hour"), F.lit(0).alias("slice"), "piece",
                           F.lit(behind).alias("behind"))
    return opening.unionByName(threads.select(
        "issue_key", "prompt_id", "hour", "slice", F.col("lines").alias("piece"), F.lit(None).cast("string").alias("behind")))


def _score(pieces: Iterable[str], scorer: Scorer) -> tuple[str, float | None, str | None]:
    try:
        read = getattr(scorer, "read", None)
        reasoning, clarity, notes = read(iter(pieces)) if read else scorer("".join(pieces))
        if not 0 <= clarity <= 1:
            raise ValueError(f"clarity score {clarity} is not between 0 and 1")
        return reasoning, float(clarity), notes
    except Exception as failure:  # one bad answer must not end the run
        return f"Analysis failed: {failure}", None, None  # fixed value: the prefix readers look for


class Pace:
    """A token bucket: ``take`` waits until the next call may be made, ``burst`` calls may follow each other at once."""

    def __init__(self, a_minute: float, burst: int = 1, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        if a_minute <= 0:
            raise ValueError("a pace is more than zero calls a minute")
        self.every, self.burst, self.clock, self.sleep = 60 / a_minute, burst, clock, sleep
        self.tokens, self.at = float(burst), clock()

    def take(self) -> None:
        now = self.clock()
        self.tokens = min(self.burst, self.tokens + (now - self.at) / self.every)
        self.at = now
        if self.tokens < 1:
            self.sleep((1 - self.tokens) * self.every)
            self.tokens, self.at = 1.0, self.clock()
        self.tokens -= 1


def _whole(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """Key, number of equal prompts, texts of the prompt, and what else the row has."""
    for batch in batches:
        for key, prompt, *kept in batch.itertuples(index=False, name=None):
            yield key, 1, [prompt], kept


def _joined(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """As ``_whole``, with a prompt's pieces as they arrive, from rows in their order."""
    broken: list[BaseException] = []

    def rows() -> Iterator[tuple]:
        try:
            for batch in batches:
                yield from zip(batch["issue_key"], batch["prompt_id"], batch["piece"], batch["behind"])
        except BaseException as failure:
            broken.append(failure)
            raise

    for (key, _), group in groupby(rows(), key=lambda r: r[:2]):
        first = next(group)
        copies, line = 1, next(group, None)
        while line is not None and line[3] is not None:  # the same row of an issue once more
            copies, line = copies + 1, next(group, None)
        lines = [NO_COMMENTS] if line is None else chain([line[2]], (f"\n{r[2]}" for r in group))
        yield key, copies, chain([first[2]], lines, [first[3]]), []
        if broken:  # what a scorer makes of rows that could not be read is no score
            raise broken[0]


# Scores of one Arrow batch.
_SCORES = 1000


def score_issues(prompts: DataFrame, scorer: Scorer, analyzed_at: object, calls_a_minute: float | None = None, tasks: int = 1,
                 keep: Sequence[str] = ()) -> DataFrame:
    """Rows for ``ai_scores``. Prompts stream through Python in Arrow batches, partition by
    partition; a scorer that fails on a prompt leaves a row that says so.

    ``prompts`` are whole or in pieces (``scoring_prompts``). Pieces meet in a sort and reach the scorer one after another, so
    a prompt of any length takes a task no more memory than a batch, if the scorer has ``read``.
    With ``calls_a_minute`` the prompts are dealt to ``tasks`` partitions, each of which keeps to its share of that pace, so
    that all together do. A repeated task calls again at that pace. Text columns of whole prompts named in ``keep`` come along.
    """
    schema = "issue_key string, complexity_reasoning string, clarity_score double, clarity_notes string" + "".join(f", {c} string" for c in keep)
    given = _joined if "piece" in prompts.columns else _whole
    dealt = [] if calls_a_minute is None else [tasks]
    if given is _joined:
        rows = prompts.repartition(*dealt, "issue_key", "prompt_id").sortWithinPartitions(
            "issue_key", "prompt_id", "hour", "slice").select("issue_key", "prompt_id", "piece", "behind")
    else:
        rows = prompts.select("issue_key", "prompt", *keep)
        rows = rows.repartition(tasks) if dealt else rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pace = None if calls_a_minute is None else Pace(calls_a_minute / tasks)
        scored = []

        def out() -> pd.DataFrame:
            made = pd.DataFrame(scored, columns=["issue_key", "complexity_reasoning", "clarity_score", "clarity_notes", *keep])
            made["clarity_score"] = made["clarity_score"].astype("float64")
            scored.clear()
            return made

        for key, copies, pieces, kept in given(batches):
            if pace:
                pace.take()
            scored += [(key, *_score(pieces, scorer), *kept)] * copies
            if len(scored) >= _SCORES:
                yield out()
        yield out()

    scored = rows.mapInPandas(run, schema)
    return scored.withColumn("analyzed_at", as_timestamp(analyzed_at)).select(*AI_SCORES.fieldNames(), *keep)


def sprint_mvp(issues: DataFrame) -> DataFrame:
    """The assignee with the largest story point total."""
    return leaderboard(issues).limit(1).select(F.col("assignee").alias("mvp"), "total_sp")
