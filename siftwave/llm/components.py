"""Connected components of a table of links, by the least label that reaches each node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, label) for each node of links (a, b): the least node of its component. Nodes are of any type that has an order.

    Every turn takes the least label among a node's neighbours, then the label's own label, so paths halve. Labels are written to the
    shared folder each turn, and only the number of changed labels comes to the driver.
    """
    both = scratch.save(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-links")
    labels = scratch.save(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).withColumnRenamed("a", "node"), f"{name}-0")
    turn = 0
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        found = labels.join(near, F.col("node") == F.col("a")).select("node", "label", F.least("label", "near").alias("next"))
        up = labels.select(F.col("node").alias("n"), F.col("label").alias("up"))
        found = found.join(up, F.col("next") == F.col("n"), "left").select("node", "label", F.least("next", F.coalesce("up", "next")).alias("next"))
        found = scratch.save(found, f"{name}-{turn + 1}")
        scratch.drop(f"{name}-{turn}")
        turn += 1
        if not found.where("label <> next").limit(1).count():
            return found.select("node", F.col("next").alias("label"))
        labels = found.select("node", F.col("next").alias("label"))
