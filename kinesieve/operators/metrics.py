"""The wide metric row of a measured sequence: what is left over a slow path, by band and by axis.

Signals are steps per row: tx and ty in pixels, rot in radians, logs (log of scale). Their sums are the
paths. A function over many segments filters each one's paths; everything after that is one aggregation in
Spark, so segments of a clip are pooled by rows, not by means of means.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinesieve.operators.boards import rms
from kinesieve.operators.solve import filled, over_segments, zero_phase

AXES = ("tx", "ty", "rot", "logs")
#: Rows that a calm metric needs.
CALM_ROWS = 60


def lever(width: float, height: float) -> float:
    """RMS distance of a picture's points from its centre: pixels for a radian or a unit of scale."""
    return math.sqrt((width * width + height * height) / 12)


def filtered_paths(signals: DataFrame, keys: list[str], order: list[str], rate: float, cut: float = 2.0, bands: tuple[tuple[float, float], ...] = ((2, 8), (8, 30))) -> DataFrame:
    """Per row: the paths' parts above `cut` (hp_<axis>), within each band (b<i>_<axis>), the slow
    speed in pixels per second, and how far the step is from the median of the seven around it
    (jump). Missing steps count as none, but their rows are marked not known."""
    names = [f"hp_{a}" for a in AXES] + [f"b{i}_{a}" for i in range(len(bands)) for a in AXES] + ["speed", "jump"]

    def paths(*steps: np.ndarray) -> list[np.ndarray]:
        high, within, slow, jump = [], [[] for _ in bands], {}, np.zeros(len(steps[0]))
        for a, step in zip(AXES, steps):
            step = np.where(np.isfinite(step), step, 0.0)
            path = filled(np.cumsum(step))
            low = {f: zero_phase(path, f, rate) for f in {cut, *(x for b in bands for x in b)}}
            high.append(path - low[cut])
            for part, (lo, hi) in zip(within, bands):
                part.append(low[hi] - low[lo])
            slow[a] = np.gradient(low[cut]) * rate if len(path) > 1 else np.zeros(1)
            if a in ("tx", "ty"):
                wide = np.pad(step, 3, mode="edge")
                jump += (step - np.median(np.lib.stride_tricks.sliding_window_view(wide, 7), axis=1)) ** 2
        return [*high, *(x for part in within for x in part), np.hypot(slow["tx"], slow["ty"]), np.sqrt(jump)]

    out = over_segments(signals, keys, order, list(AXES), names, paths)
    fine = lambda x: F.col(x).isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    known = reduce(and_, (fine(a) for a in AXES))
    return out.select(*keys, *order, *names, known.alias("known"))


def energy(prefix: str, reach: float) -> Column:
    tx, ty, rot, logs = (F.col(f"{prefix}_{a}") for a in AXES)
    return tx * tx + ty * ty + (rot * rot + logs * logs) * reach * reach


def metric_row(paths: DataFrame, keys: list[str], width: float, height: float, calm_speed: float, n_bands: int = 2) -> DataFrame:
    """One row of metrics per group, over known rows: hf and each band in pixels, hf by axis, the same
    over calm rows (null under CALM_ROWS of them), jumps over half a pixel and one, and n."""
    reach = lever(width, height)
    scale = {"tx": 1.0, "ty": 1.0, "rot": reach, "logs": reach}
    calm = F.col("speed") < calm_speed
    enough = F.count_if(calm) >= CALM_ROWS
    return paths.filter("known").groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.sqrt(F.avg(energy("hp", reach))).alias("hf"),
        *(F.sqrt(F.avg(energy(f"b{i}", reach))).alias(f"band_{i}") for i in range(n_bands)),
        *(rms(F.col(f"hp_{a}") * k).alias(f"hf_{a}") for a, k in scale.items()),
        F.when(enough, F.sqrt(F.avg(F.when(calm, energy("hp", reach))))).alias("calm_hf"),
        F.avg(calm.cast("int")).alias("calm_share"),
        F.count_if(F.col("jump") > 0.5).alias("jumps_half"), F.count_if(F.col("jump") > 1).alias("jumps_one"), F.max("jump").alias("jump_max"),
    )


def window_rms(paths: DataFrame, keys: list[str], position: Column, rows: int, width: float, height: float) -> DataFrame:
    """RMS of every `rows` rows by position; a group's windows are compared pairwise with another's."""
    window = F.floor(position / rows).cast("long").alias("window")
    return paths.filter("known").groupBy(*keys, window).agg(F.count("*").alias("n"), F.sqrt(F.avg(energy("hp", lever(width, height)))).alias("rms"))


def window_summary(paths: DataFrame, keys: list[str], pieces: list[str], order: list[str], rows: int, width: float, height: float) -> DataFrame:
    """Per group the spread of the RMS over its windows of `rows` rows, and how it goes with the slow speed.

    Windows lie within a piece (a segment of the group) and are whole; a window is measured over its known
    rows, and not at all without any. median_calm and median_active are over the windows up to the median and from the
    third quartile of speed, corr over all of them; the three need four windows and some spread.
    """
    place = F.row_number().over(W.partitionBy(*keys, *pieces).orderBy(*order)) - 1
    placed = paths.withColumn("window", F.floor(place / rows))
    known = F.when(F.col("known"), energy("hp", lever(width, height)))
    windows = placed.groupBy(*keys, *pieces, "window").agg(F.count("*").alias("rows"), F.sqrt(F.avg(known)).alias("rms"), F.avg(F.when(F.col("known"), F.col("speed"))).alias("speed"))
    windows = windows.filter((F.col("rows") == rows) & F.col("rms").isNotNull())
    level = windows.groupBy(*keys).agg(
        F.count("*").alias("windows"), F.percentile("rms", 0.5).alias("median"), F.percentile("rms", 0.9).alias("p90"), F.max("rms").alias("most"), F.min("rms").alias("least"),
        F.percentile("speed", 0.5).alias("half"), F.percentile("speed", 0.75).alias("quarter"),
        F.when((F.stddev_pop("rms") > 0) & (F.stddev_pop("speed") > 0), F.corr("rms", "speed")).alias("corr"),
    )
    both = windows.join(level, keys)
    kinds = both.groupBy(*keys).agg(F.percentile(F.when(F.col("speed") <= F.col("half"), F.col("rms")), 0.5).alias("calm"), F.percentile(F.when(F.col("speed") >= F.col("quarter"), F.col("rms")), 0.5).alias("active"))
    told = (F.col("windows") >= 4) & F.col("corr").isNotNull()
    return level.join(kinds, keys).select(
        *keys, "windows", "median", "p90", "most", "least",
        *(F.when(told, F.col(c)).alias(name) for c, name in (("corr", "corr"), ("calm", "median_calm"), ("active", "median_active"))),
    )
