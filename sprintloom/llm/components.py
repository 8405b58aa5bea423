"""Connected components of a link table, without collecting links or components anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sprintloom.session import written


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links(a, b)``; the root is the component's smallest node.

    Each round gives a node the smallest label among itself and its neighbours and then the label
    of that label, so distances shrink by more than half. A round ends in a written table: lost
    executors cost one round at most. A hub's many links meet its one label in a join whose large
    side adaptive execution divides; minima are combined before they are shuffled. Links may
    repeat and come in either direction; no links give no rows.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = written(both.distinct(), "links")
    labels = written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("root"))
                     .withColumnRenamed("a", "node"), "labels")
    while True:
        known = labels.select(F.col("node").alias("b"), "root")
        nearer = both.join(known, "b").groupBy("a").agg(F.min("root").alias("near"))
        lower = labels.join(nearer.withColumnRenamed("a", "node"), "node").select(
            "node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        lower = written(lower, "labels")
        jump = lower.select(F.col("node").alias("root"), F.col("root").alias("far"))
        after = written(lower.join(jump, "root").select(
            "node", F.least("root", "far").alias("root"), (F.col("old") != F.least("root", "far")).alias("moved")), "labels")
        if after.filter("moved").isEmpty():
            return after.select("node", "root")
        labels = after.select("node", "root")
