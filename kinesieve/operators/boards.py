"""Scoreboards: roll-ups of measured windows by group, shifts against noise, reasons and verdicts.

A window table has one row per window and configuration, with metrics as columns; a missing metric is
null and leaves that metric's statistics only. Groups are any columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rms(x: Column) -> Column:
    return F.sqrt(F.avg(x * x))


def pooled_share(share: Column, weight: Column) -> Column:
    """Share over all windows, each counted by its own number of trials."""
    known = share.isNotNull() & weight.isNotNull()
    return F.sum(F.when(known, share * weight)) / F.nullif(F.sum(F.when(known, weight)), F.lit(0))


def reduction(before: Column, after: Column) -> Column:
    return 1 - after / F.nullif(before, F.lit(0.0))


def summary(windows: DataFrame, keys: list[str], metrics: list[str], passed: Column, win: Column, trials: Column, pairs: dict[str, str]) -> DataFrame:
    """One row per group: windows, passed ones, the mean of each metric, how often and by what
    geometric ratio each metric of `pairs` is under its reference, and the pooled win share."""
    ratio = lambda k, r: F.when((F.col(k) > 0) & (F.col(r) > 0), F.log(F.col(k) / F.col(r)))
    return windows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count_if(passed).alias("passed"),
        *(F.avg(k).alias(f"mean_{k}") for k in metrics),
        *(F.exp(F.avg(ratio(k, r))).alias(f"ratio_{k}") for k, r in pairs.items()),
        *(F.count_if(F.col(k) < F.col(r)).alias(f"beats_{k}") for k, r in pairs.items()),
        pooled_share(win, trials).alias("win_pooled"),
        F.count_if(win >= 0.9).alias("win_ge_90"),
    )


def reasons(checks: dict[str, Column]) -> Column:
    """The names of the checks that are true, in the order given."""
    return F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in checks.items())))


def fail_histogram(windows: DataFrame, keys: list[str], fails: str) -> DataFrame:
    return windows.select(*keys, F.explode(fails).alias("check")).groupBy(*keys, "check").agg(F.count("*").alias("n"))


def shifts(pairs: DataFrame, keys: list[str], this: str, other: str, sigma: float, wide: float = 2.5) -> DataFrame:
    """Geometric mean change this/other of paired windows and the band that noise of `sigma` per
    window explains; windows beyond their own noise are counted on both sides."""
    r = F.log(F.col(this) / F.col(other))
    sound = pairs.filter((F.col(this) > 0) & (F.col(other) > 0)).withColumn("r", r)
    out = sound.groupBy(*keys).agg(
        F.count("*").alias("n"), (F.exp(F.avg("r")) - 1).alias("change"), F.stddev_pop("r").alias("spread"),
        F.count_if(F.exp("r") - 1 < -wide * sigma).alias("n_better"), F.count_if(F.exp("r") - 1 > wide * sigma).alias("n_worse"),
    )
    band = wide * sigma / F.sqrt("n")
    real = F.abs(F.log1p("change")) > band
    return out.withColumn("band", band).withColumn("verdict", F.when(~real, "same").when(F.col("change") < 0, "better").otherwise("worse"))


def shift_text(name: Column, change: Column, band: Column, verdict: Column) -> Column:
    """A change in words: percent, verdict if there is one, and the noise band."""
    said = F.when(verdict == "same", F.lit("")).otherwise(F.concat(F.lit(" "), verdict))
    return F.concat(name, F.format_string(" %+.1f%%", 100 * change), said, F.format_string(" (noise +-%.1f)", 100 * band))


def same_runs(one: DataFrame, two: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Windows of both runs: whether all metrics are equal (missing equals missing), and how many are
    not."""
    left = one.select(*keys, *(F.col(m).alias(f"a_{m}") for m in metrics))
    right = two.select(*keys, *(F.col(m).alias(f"b_{m}") for m in metrics))
    plain = lambda c: F.when(~F.isnan(c), c)
    differs = [(~plain(F.col(f"a_{m}").cast("double")).eqNullSafe(plain(F.col(f"b_{m}").cast("double")))).cast("int") for m in metrics]
    return left.join(right, keys).select(*keys, sum(differs[1:], differs[0]).alias("n_differs")).withColumn("identical", F.col("n_differs") == 0)


def covered_levels(levels: Column) -> Column:
    """How many levels from the first on are covered without a gap."""
    gap = F.array_position(F.transform(levels, lambda c: F.coalesce(c, F.lit(False))), F.lit(False))
    return F.when(gap == 0, F.size(levels)).otherwise(gap - 1).cast("int")


def clipped_polygon(points: Column, planes: list[tuple[float, float, float]]) -> Column:
    """A convex polygon (array of struct<x,y>) cut by half planes a*x + b*y <= c, one after another."""

    def cut(polygon: Column, a: float, b: float, c: float) -> Column:
        far = lambda p: a * p.x + b * p.y - c

        def edge(p: Column, i: Column, whole: Column) -> Column:
            q = F.get(whole, F.pmod(i + 1, F.size(whole)))
            share = far(p) / (far(p) - far(q))
            met = F.struct((p.x + share * (q.x - p.x)).alias("x"), (p.y + share * (q.y - p.y)).alias("y"))
            return F.array_compact(F.array(F.when(far(p) <= 0, p), F.when(far(p) * far(q) < 0, met)))

        return F.flatten(F.transform(F.array(polygon), lambda whole: F.flatten(F.transform(whole, lambda p, i: edge(p, i, whole)))))

    out = points
    for plane in planes:
        out = cut(out, *map(float, plane))
    return out


def polygon_area(points: Column) -> Column:
    """Shoelace area; nothing is left of fewer than three points."""

    def body(p: Column) -> Column:
        after = lambda i: F.get(p, F.pmod(i + 1, F.size(p)))
        parts = F.transform(p, lambda a, i: a.x * after(i).y - after(i).x * a.y)
        return F.abs(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)) / 2

    return F.transform(F.array(points), body)[0]
