"""Connected components of links, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revtide.session import settle


def connect(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (a, b): the root is the smallest node of the component.

    Each round takes the smallest label among a node's neighbours and then jumps to the label's own
    label, so chains halve at least; a round is written to the shared folder, so a lost executor costs
    a re-read. Nothing is collected; a hub's links are spread by the join and pre-aggregated.
    """
    both = settle(links.select("a", "b").union(links.select("b", "a")).filter(F.col("a") != F.col("b")).distinct())
    labels = settle(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        nearby = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("near"))
        lower = labels.join(nearby, F.col("node") == F.col("a"), "left").select("node", F.least("root", "near").alias("root"), F.col("root").alias("_old"))
        lower = settle(lower)
        jump = lower.select(F.col("node").alias("_at"), F.col("root").alias("_next"))
        following = settle(lower.join(jump, F.col("root") == F.col("_at"), "left").select("node", F.coalesce("_next", "root").alias("root"), "_old"))
        if following.filter(F.col("root") != F.col("_old")).isEmpty():
            return following.select("node", "root")
        labels = following.select("node", "root")
