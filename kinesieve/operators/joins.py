"""Joins by time and position.

As-of joins are one union and one window over both sides, ordered by time: no side is broadcast and
no pair of rows is tried. Range joins cut time into buckets of a range's length, so a row meets only
its own bucket and the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, key: str, time: str, tie: str, values: list[str], direction: str = "prev") -> DataFrame:
    """All rows of left with `<value>_r` of the right row before (or at), or after (or at), each.

    Of right rows at one time the one with the largest tie value counts before, the smallest after.
    """
    back = direction == "prev"
    payload = F.struct(F.col(time).alias("t"), *(F.col(v).alias(v) for v in values))
    one = left.select("*", F.lit(None).cast(right.select(payload.alias("p")).schema["p"].dataType).alias("__r"), F.lit(1 if back else 0).alias("__side"))
    two = right.select(key, time, tie, payload.alias("__r"), F.lit(0 if back else 1).alias("__side"))
    both = one.unionByName(two, allowMissingColumns=True)
    w = W.partitionBy(key).orderBy(time, "__side", tie)
    found = F.last("__r", True).over(w.rowsBetween(W.unboundedPreceding, 0)) if back else F.first("__r", True).over(w.rowsBetween(0, W.unboundedFollowing))
    out = both.withColumn("__f", found).filter(F.col("__side") == (1 if back else 0))
    cols = [F.col(f"__f.{v}").alias(f"{v}_r") for v in values]
    return out.select(*left.columns, F.col("__f.t").alias(f"{time}_r"), *cols)


def bracket(left: DataFrame, right: DataFrame, key: str, time: str, tie: str, values: list[str]) -> DataFrame:
    """The right rows before and after each left row, as `<value>_0` and `<value>_1`."""
    before = asof(left, right, key, time, tie, values)
    for v in (time, *values):
        before = before.withColumnRenamed(f"{v}_r", f"{v}_0")
    both = asof(before, right, key, time, tie, values, "next")
    for v in (time, *values):
        both = both.withColumnRenamed(f"{v}_r", f"{v}_1")
    return both


def lerp(t: Column, t0: Column, t1: Column, v0: Column, v1: Column) -> Column:
    """Between two samples; beyond the first or last one its value is held."""
    share = (t - t0) / (t1 - t0)
    return F.when(t0.isNull(), v1).when(t1.isNull() | (t1 == t0), v0).otherwise(v0 + share * (v1 - v0))


def nearest(left: DataFrame, right: DataFrame, key: str, time: str, tie: str, values: list[str]) -> DataFrame:
    """The right row closest in time, the earlier of two that are equally close."""
    both = bracket(left, right, key, time, tie, values)
    early = F.col(f"{time}_1").isNull() | (F.col(time) - F.col(f"{time}_0") <= F.col(f"{time}_1") - F.col(time))
    cols = [F.when(early, F.col(f"{v}_0")).otherwise(F.col(f"{v}_1")).alias(f"{v}_r") for v in (time, *values)]
    return both.select(*left.columns, *cols)


def uniform_grid(df: DataFrame, key: str, time: str, step: int) -> DataFrame:
    """(key, time): every multiple of the step within each key's range."""
    ends = df.groupBy(key).agg(F.min(time).alias("lo"), F.max(time).alias("hi"))
    first, last = F.ceil(F.col("lo") / step), F.floor(F.col("hi") / step)
    return ends.filter(first <= last).select(key, F.explode(F.sequence(first, last)).alias("__i")).select(key, (F.col("__i") * step).alias(time))


def interval_overlaps(left: DataFrame, right: DataFrame, key: str, lid: str, rid: str, bucket: int, least: float) -> DataFrame:
    """(key, lid, rid, weight): shares of left's [start, stop) that right's cover.

    Both sides enter the time buckets that they touch; shares under `least` are dropped and the rest
    brought to a sum of one.
    """

    def spread(df: DataFrame) -> DataFrame:
        last = F.floor((F.greatest("stop", F.col("start") + 1) - 1) / bucket)
        return df.withColumn("__b", F.explode(F.sequence(F.floor(F.col("start") / bucket), last)))

    one = spread(left).select(key, "__b", lid, F.col("start").alias("ls"), F.col("stop").alias("le"))
    two = spread(right).select(key, "__b", rid, F.col("start").alias("rs"), F.col("stop").alias("re"))
    low, high = F.greatest("ls", "rs"), F.least("le", "re")
    # a pair that shares several buckets counts in the one where its overlap begins
    both = one.join(two, [key, "__b"]).filter((high > low) & (F.floor(low / bucket) == F.col("__b")))
    both = both.withColumn("w", (high - low) / (F.col("le") - F.col("ls"))).filter(F.col("w") >= least)
    total = F.sum("w").over(W.partitionBy(key, lid))
    return both.select(key, lid, rid, (F.col("w") / total).alias("weight"))


def band(left: DataFrame, right: DataFrame, key: str, position: str, width: int) -> DataFrame:
    """Pairs of rows at most `width` positions apart; the right side's columns end in _r."""
    renamed = right.select(*(F.col(c).alias(c if c == key else f"{c}_r") for c in right.columns))
    near = renamed.withColumn(position, F.explode(F.sequence(F.col(f"{position}_r") - width, F.col(f"{position}_r") + width)))
    return left.join(near, [key, position])


def densify(df: DataFrame, key: str, position: str, spine: DataFrame) -> DataFrame:
    """Every row of the spine(key, position), with the columns of df where it has that row."""
    return spine.join(df, [key, position], "left")


def links(df: DataFrame, track: str, frame: str) -> DataFrame:
    """Rows whose track goes on in the very next frame; triple: and in the one after that."""
    w = W.partitionBy(track).orderBy(frame)
    out = df.withColumn("__1", F.lead(frame).over(w)).withColumn("__2", F.lead(frame, 2).over(w))
    out = out.filter(F.col("__1") == F.col(frame) + 1)
    return out.withColumn("triple", F.coalesce(F.col("__2") == F.col(frame) + 2, F.lit(False))).drop("__1", "__2")
