"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinesieve.llm.storage import drop_table, keep


def components(links: DataFrame) -> DataFrame:
    """(node, label): each node of the links (a, b) with the smallest node that it is linked to.

    Every step gives a node the smallest label among its neighbours and then that label's own
    label, so chains shrink by more than half; it ends when no label changes.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    edges = keep(both.filter("a <> b"), "edges")
    labels = keep(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        around = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(around.withColumnRenamed("a", "node"), "node").select("node", "label", F.least("label", "near").alias("new"))
        target = labels.select(F.col("node").alias("new"), F.col("label").alias("further"))
        moved = keep(step.join(target, "new", "left").select("node", "label", F.least("new", F.coalesce("further", "new")).alias("new")), "moved")
        done = moved.filter("new < label").isEmpty()
        drop_table(labels)
        labels = keep(moved.select("node", F.col("new").alias("label")), "labels")
        drop_table(moved)
        if done:
            drop_table(edges)
            return labels
