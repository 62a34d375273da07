"""Sequence operators: everything ordered within a clip.

Each takes a table, its key columns and its ordering columns, and adds or derives columns with window
functions. `keys` should hold the segment too wherever values must not cross a segment's bounds, which
also keeps window partitions small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ALL_BEFORE = (W.unboundedPreceding, W.currentRow)


def ordered(keys: list[str], order: list[str]):
    return W.partitionBy(*keys).orderBy(*order)


def running_sum(flag: Column, keys: list[str], order: list[str]) -> Column:
    return F.sum(flag).over(ordered(keys, order).rowsBetween(*ALL_BEFORE))


def segments(df: DataFrame, keys: list[str], order: list[str], high: float = 1.5, low: float | None = None) -> DataFrame:
    """segment_id: the count so far of steps over `high` (or under `low`) times the clip's median."""
    steps = df.withColumn("__dt", F.col(order[0]) - F.lag(order[0]).over(ordered(keys, order)))
    typical = steps.groupBy(*keys).agg(F.percentile("__dt", 0.5).alias("__median"))
    cut = F.col("__dt") > high * F.col("__median")
    if low is not None:
        cut = cut | (F.col("__dt") < low * F.col("__median"))
    out = steps.join(typical, keys)
    return out.withColumn("segment_id", running_sum(F.when(cut, 1).otherwise(0), keys, order).cast("long")).drop("__dt", "__median")


def changes(value: Column, keys: list[str], order: list[str]) -> Column:
    """True for the first row of each run of equal values."""
    return ~F.lag(value).over(ordered(keys, order)).eqNullSafe(value) | (F.row_number().over(ordered(keys, order)) == 1)


def drop_held(df: DataFrame, keys: list[str], order: list[str], value: str, delay: int) -> DataFrame:
    """The first row of each run of equal values, its time shifted by the delay."""
    return df.withColumn("__new", changes(F.col(value), keys, order)).filter("__new").drop("__new").withColumn(order[0], F.col(order[0]) + delay)


def run_lengths(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """(keys, run, value, n): the lengths of the runs of equal values."""
    runs = df.withColumn("run", running_sum(changes(F.col(value), keys, order).cast("int"), keys, order))
    return runs.groupBy(*keys, "run").agg(F.first(value).alias(value), F.count("*").alias("n"))


def true_runs(df: DataFrame, keys: list[str], order: list[str], mask: Column) -> DataFrame:
    """(keys, start, stop): half-open row ranges in which the mask holds."""
    rows = df.withColumn("__k", F.row_number().over(ordered(keys, order)) - 1).withColumn("__mask", mask)
    hits = rows.filter("__mask")
    island = F.col("__k") - F.row_number().over(ordered(keys, order))
    return hits.withColumn("__island", island).groupBy(*keys, "__island").agg(F.min("__k").cast("long").alias("start"), (F.max("__k") + 1).cast("long").alias("stop")).drop("__island")


def keep_sign(value: Column, product: Column, keys: list[str], order: list[str]) -> Column:
    """The value, negated after every odd number of negative products with the row before."""
    flips = running_sum(F.when(product < 0, 1).otherwise(0), keys, order)
    return F.when(flips % 2 == 0, value).otherwise(-value)


def interpolate(df: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Nulls filled linearly by row position; the ends hold the nearest value."""
    rows = df.withColumn("__k", F.row_number().over(ordered(keys, order)))
    at = F.when(F.col(value).isNotNull(), F.struct(F.col("__k").alias("k"), F.col(value).alias("v")))
    w = ordered(keys, order)
    rows = rows.withColumn("__a", F.last(at, True).over(w.rowsBetween(*ALL_BEFORE))).withColumn("__b", F.first(at, True).over(w.rowsBetween(W.currentRow, W.unboundedFollowing)))
    share = (F.col("__k") - F.col("__a.k")) / (F.col("__b.k") - F.col("__a.k"))
    filled = F.when(F.col(value).isNotNull(), F.col(value)).when(F.col("__a").isNull(), F.col("__b.v")).when(F.col("__b").isNull(), F.col("__a.v")).otherwise(F.col("__a.v") + share * (F.col("__b.v") - F.col("__a.v")))
    return rows.withColumn(out, filled).drop("__k", "__a", "__b")


def running_median(value: str, half: int, keys: list[str], order: list[str]) -> Column:
    """Median of the rows within `half`, the row included; at the ends of fewer rows."""
    return F.percentile(value, 0.5).over(ordered(keys, order).rowsBetween(-half, half))


def array_median(values: Column) -> Column:
    """Median of an array's values that are not null; null if there is none."""
    s = F.array_sort(F.filter(values, lambda x: x.isNotNull()))
    n = F.size(s)
    low = F.try_element_at(s, F.floor((n + 1) / 2).cast("int"))
    high = F.try_element_at(s, F.floor(n / 2).cast("int") + 1)
    return F.when(n > 0, (low + high) / 2)


def median_around(value: str, half: int, gap: int, keys: list[str], order: list[str]) -> Column:
    """Median of the rows within `half` but further than `gap` away."""
    w = ordered(keys, order)
    before = F.collect_list(value).over(w.rowsBetween(-half, -gap - 1))
    after = F.collect_list(value).over(w.rowsBetween(gap + 1, half))
    return array_median(F.concat(before, after))


def edge_mean(value: str, half: int, keys: list[str], order: list[str]) -> Column:
    """Mean of 2*half+1 rows where rows beyond an end repeat the end's value."""
    w = ordered(keys, order)
    k = F.row_number().over(w)
    n = F.count("*").over(W.partitionBy(*keys))
    first = F.first(value).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    last = F.last(value).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    inside = F.sum(value).over(w.rowsBetween(-half, half))
    missing_before = F.greatest(F.lit(0), half + 1 - k)
    missing_after = F.greatest(F.lit(0), k + half - n)
    return (inside + missing_before * first + missing_after * last) / (2 * half + 1)


def hann_mean(value: str, half: int, keys: list[str], order: list[str]) -> Column:
    """Hann-weighted mean of 2*half+1 rows, ends repeated as in edge_mean()."""
    import math

    weights = [0.5 * (1 + math.cos(math.pi * i / (half + 1))) for i in range(-half, half + 1)]
    w = ordered(keys, order)
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    first, last = F.first(value).over(whole), F.last(value).over(whole)
    k, n = F.row_number().over(w), F.count("*").over(W.partitionBy(*keys))
    total = F.lit(0.0)
    for i, weight in zip(range(-half, half + 1), weights):
        shifted = F.lag(value, -i).over(w) if i else F.col(value)
        total = total + weight * F.when(k + i < 1, first).when(k + i > n, last).otherwise(shifted)
    return total / sum(weights)


def erode(value: str, half: int, keys: list[str], order: list[str]) -> Column:
    """The smallest value within `half` rows."""
    return F.min(value).over(ordered(keys, order).rowsBetween(-half, half))


def row_windows(df: DataFrame, keys: list[str], order: list[str], length: int, keep_tail: bool = True) -> DataFrame:
    """win: tumbling windows of `length` rows; the tail joins the last full one, or is dropped."""
    rows = df.withColumn("__k", F.row_number().over(ordered(keys, order)) - 1).withColumn("__n", F.count("*").over(W.partitionBy(*keys)))
    win = F.floor(F.col("__k") / length)
    full = F.floor(F.col("__n") / length)
    if keep_tail:
        return rows.withColumn("win", F.least(win, F.greatest(F.lit(1), full) - 1).cast("long")).drop("__k", "__n")
    return rows.filter(win < full).withColumn("win", win.cast("long")).drop("__k", "__n")


def rms(value: Column) -> Column:
    return F.sqrt(F.avg(value * value))


def spike_events(df: DataFrame, keys: list[str], order: list[str], deviation: str, threshold: float, gap: int = 2) -> DataFrame:
    """(keys, event, start, n, peak): rows over the threshold, merged where at most `gap` apart."""
    rows = df.withColumn("__k", F.row_number().over(ordered(keys, order)))
    hits = rows.filter(F.abs(deviation) > threshold)
    new = F.coalesce(F.col("__k") - F.lag("__k").over(ordered(keys, order)) > gap, F.lit(True))
    hits = hits.withColumn("__new", new.cast("int")).withColumn("event", running_sum(F.col("__new"), keys, order))
    return hits.groupBy(*keys, "event").agg((F.min("__k") - 1).cast("long").alias("start"), F.count("*").alias("n"), F.max(F.abs(deviation)).alias("peak"))


def hampel(df: DataFrame, keys: list[str], order: list[str], value: str, half: int, scale_half: int, factor: float, floor: float) -> DataFrame:
    """outlier: the row is further from the running median than `factor` robust scales."""
    step = df.withColumn("__away", F.abs(F.col(value) - running_median(value, half, keys, order)))
    scale = 1.4826 * F.percentile("__away", 0.5).over(ordered(keys, order).rowsBetween(-scale_half, scale_half))
    return step.withColumn("outlier", F.col("__away") > factor * F.greatest(scale, F.lit(floor))).drop("__away")
