"""Connected components of a table of links, by smallest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import discard, written


def components(links: DataFrame) -> DataFrame:
    """(node, label) for the ends of links (a, b): label is the smallest node that links reach.

    Each round takes the smallest label among the neighbours and then the label of the label, so a
    chain halves with every round; each is written, which cuts the lineage. Only counts come to the driver.
    """
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "links")
    labels = written(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("label")), "labels")
    last = labels
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("other")), "b").groupBy("a").agg(F.min("other").alias("other"))
        lower = labels.join(near, labels["node"] == near["a"], "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("other", "label")).alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        changed = written(lower.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label")), "labels")
        discard(last)
        labels, last = changed.select("node", "label"), changed
        if changed.filter("old <> label").isEmpty():
            discard(both)
            return labels
