"""Balance when one issue holds a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# An issue is hot when it holds more than 1/HOT_SHARE of the rows, so there are fewer than
# HOT_SHARE hot issues whatever the data: that is the bound on what is broadcast below. Fewer than
# HOT_ROWS rows are no burden to a task whatever their share.
HOT_SHARE = 1000
HOT_ROWS = 1000
SALTS = 256


def key_counts(rows: DataFrame) -> DataFrame:
    """Rows per issue. Partial sums are taken before the shuffle, so a hot issue is cheap.

    The null test is what a join on the key implies anyway; written out, every use of the counts
    in one query has the same plan and shares one shuffle.
    """
    return rows.filter(F.col("issue_key").isNotNull()).groupBy("issue_key").agg(
        F.count("*").alias("n"))


def _is_hot(counts: DataFrame) -> Column:
    return (F.col("n") >= HOT_ROWS) & (F.col("n") * HOT_SHARE > counts.agg(F.sum("n")).scalar())


def flag_hot(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """The rows with a column ``hot``; no shuffle, the hot keys are fewer than ``HOT_SHARE``."""
    hot = counts.filter(_is_hot(counts))
    keys = hot.select("issue_key", F.lit(True).alias("hot"))
    return rows.join(F.broadcast(keys), "issue_key", "left").withColumn(
        "hot", F.coalesce("hot", F.lit(False)))


def counted_join(many: DataFrame, facts: DataFrame | None, counts: DataFrame,
                 spread_by: str) -> DataFrame:
    """``many`` joined on ``issue_key`` with ``facts``, which has one row per issue.

    ``counts`` are the ``key_counts`` of ``many``; ``n`` becomes a column of the result. Rows of a
    hot issue are divided by a hash of ``spread_by`` and its one fact row is repeated for each
    division, so no task receives a whole hot issue. Other issues join as they are. The division
    is a function of the row, so a repeated task divides alike.
    """
    hot = _is_hot(counts)
    divisions = F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    known = counts if facts is None else facts.join(counts, "issue_key")
    known = known.withColumn("_salt", F.explode(divisions))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64(spread_by), F.lit(SALTS)).cast("int")).otherwise(0)
    divided = flag_hot(many, counts).withColumn("_salt", salt).drop("hot")
    return divided.join(known, ["issue_key", "_salt"]).drop("_salt")
