"""Connected components of links, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stillwater.llm import common


def components(links: DataFrame, scratch: common.Scratch, name: str) -> DataFrame:
    """node, label for each node of links (columns u, v): the smallest node it can reach.

    A round sends each node the smallest label next to it (combined before the shuffle, so hubs don't matter) and then
    follows labels of labels; rounds grow with the logarithm of a component's width.  Each round is a written table.
    """
    both = links.select(F.col("u").alias("node"), F.col("v").alias("other")).unionByName(links.select(F.col("v").alias("node"), F.col("u").alias("other"))).distinct()
    both = scratch.table(both, f"{name}-edges")
    labels = scratch.table(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("label")), f"{name}-0")
    step = 0
    while True:
        step += 1
        near = both.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("low"))
        jump = lower.join(labels.select(F.col("node").alias("low"), F.col("label").alias("far")), "low")
        moved = scratch.table(jump.select("node", F.least("low", "far").alias("label"), (F.least("low", "far") != F.col("label")).alias("changed")), f"{name}-{step}")
        done = moved.where("changed").isEmpty()
        labels = moved.select("node", "label")
        scratch.drop(f"{name}-{step - 1}")
        if done:
            scratch.drop(f"{name}-edges")
            return labels
