"""Rows in a global order without one task that holds them all: ranges of the order are dealt to
tasks, and a row's place is its task's number and its place there."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinesieve.llm.storage import drop_table, keep

#: monotonically_increasing_id() numbers rows within a task below this many bits (Spark's layout).
WITHIN = 33


def in_order(rows: DataFrame, keys: list[str], name: str, per_task: int = 500_000) -> DataFrame:
    """The rows, written in the order of the keys, with `at`, a long that ascends in that order.

    Ranges cut between rows, so keys that many rows share need a last one that tells them apart.
    """
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // per_task))
    dealt = rows.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys)
    return keep(dealt.withColumn("at", F.monotonically_increasing_id()), name)


def ranked(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Rows(tree, ...) with idx, their place from 0 by keys within the tree, and n, the tree's rows.

    Equal rows get different places. Places are counted per range and added up over a tree's ranges,
    so a tree of any share of the rows is spread over tasks.
    """
    base = keep(rows.withColumn("row", F.monotonically_increasing_id()), f"{name}-rows")
    ordered = in_order(base, ["tree", *keys, "row"], f"{name}-ordered")
    drop_table(base)
    task = F.shiftright("at", WITHIN).alias("task")
    counts = ordered.groupBy("tree", task).agg(F.min("at").alias("first"), F.count("*").alias("here"))
    tree = Window.partitionBy("tree")
    before = F.sum("here").over(tree.orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("tree", "task", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("here").over(tree).alias("n"))
    out = ordered.withColumn("task", task).join(starts, ["tree", "task"]).withColumn("idx", F.col("at") + F.col("shift"))
    out = keep(out.drop("task", "shift", "at", "row"), name)
    drop_table(ordered)
    return out
