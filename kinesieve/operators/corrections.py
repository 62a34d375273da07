"""Corrections of a path from measured step errors, round by round.

A round measures how far each step of what was rendered is off, as a rotation vector with a confidence.
`fold` makes a correction of these: steps that stand out are not trusted, the others are summed by a
weighted integral, slow parts taken off, the result faded where little is trusted, kept within a bound, and
steps and jumps limited. Corrections of several rounds compose on the rotation group, the first one first. A
round is accepted window by window, where what is left over got smaller.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinesieve.functions.rotation import qexp, qlog, qmul, quat, vec
from kinesieve.operators.solve import guarded_paths, limited_paths, pair_weights, weighted_integrals, zero_phase4
from kinesieve.operators.windows import STRETCH, equally_long, solve_windows


@dataclass(frozen=True)
class Folding:
    """`rate`: rows a second; `slow`: Hz below which nothing is corrected; `bound`: of the correction, and
    `step`, `jump`: of its steps and unsupported jumps, in the unit of the errors; `stray`: times the usual
    deviation from which an error is not trusted."""

    rate: float = 60.0
    slow: float = 1.0
    bound: float = 0.0087
    step: float = 3e-3
    jump: float = 6e-4
    stray: float = 5.0
    support: float = 0.25


def averaged(x: np.ndarray, half: int) -> np.ndarray:
    """Running mean along the last axis over `half` rows to either side, at the ends over those that there are."""
    total = np.concatenate((np.zeros((*x.shape[:-1], 1)), np.cumsum(x, axis=-1)), axis=-1)
    at = np.arange(x.shape[-1])
    low, high = np.maximum(at - half, 0), np.minimum(at + half + 1, x.shape[-1])
    return (total[..., high] - total[..., low]) / (high - low)


def known_median(x: np.ndarray) -> np.ndarray:
    """Median along the last axis of what is not NaN; NaN where all is."""
    ordered, n = np.sort(x, axis=-1), (~np.isnan(x)).sum(axis=-1)[..., None]
    low, high = (np.take_along_axis(ordered, i, axis=-1)[..., 0] for i in (np.maximum(n - 1, 0) // 2, n // 2))
    return (low + high) / 2


def strays(error: np.ndarray, weight: np.ndarray, times: float) -> np.ndarray:
    """Errors (runs, rows, axes) that are further from the median of the nine around them than `times` the usual
    distance of the run's trusted ones."""
    if error.shape[1] < 9:
        return np.zeros(weight.shape, bool)
    known = np.where((weight > 0)[:, :, None], error, np.nan)
    wide = np.lib.stride_tricks.sliding_window_view(np.pad(known, ((0, 0), (4, 4), (0, 0)), constant_values=np.nan), 9, axis=1)
    usual = np.nan_to_num(known_median(wide))
    away = np.sqrt(((error - usual) ** 2).sum(axis=2))
    typical = known_median(np.where(weight > 0, away, np.nan))
    return (weight > 0) & (away > times * 1.4826 * np.maximum(typical, 1e-12)[:, None])


def correction(error: np.ndarray, trust: np.ndarray, f: Folding) -> np.ndarray:
    """The correction (rows, axes) of one run of rows: error[i] is that of the step from row i - 1 to i,
    missing at the first row."""
    return corrected(error[None], trust[None], f)[0]


def corrected(error: np.ndarray, trust: np.ndarray, f: Folding) -> np.ndarray:
    """correction() of many runs of one length: errors and result (runs, rows, axes)."""
    n, out = error.shape[1], np.zeros(error.shape)
    known = np.isfinite(error).all(axis=2) & np.isfinite(trust)
    weight = np.where(known, pair_weights(np.nan_to_num(trust)), 0.0)
    weight[:, :1] = 0.0
    some = (weight > 0).sum(axis=1) >= 2
    if n < 3 or not some.any():
        return out
    error, weight = np.where(known[:, :, None], error, 0.0)[some], weight[some]
    weight = np.where(strays(error, weight, f.stray), 0.0, weight)
    path = np.swapaxes(weighted_integrals(error[:, 1:], weight[:, 1:], rate=f.rate), 1, 2)  # (runs, axes, rows)
    path = path - (zero_phase4(path, f.slow, f.rate) if n >= 16 else path.mean(axis=2, keepdims=True))
    held = averaged(weight, max(1, round(f.rate / 8)))
    fade = averaged(np.clip((held - 0.15) / 0.2, 0.0, 1.0), max(1, round(0.15 * f.rate / 2)))
    path = path * fade[:, None]
    size = np.sqrt((path**2).sum(axis=1))
    knee = 0.8 * f.bound
    soft = np.where(size > knee, knee + (f.bound - knee) * np.tanh((size - knee) / (f.bound - knee)), size)
    path = path * (soft / np.maximum(size, 1e-300))[:, None]
    half = max(2, round(0.05 * f.rate))
    support = averaged(weight, 2)
    guarded = [guarded_paths(limited_paths(path[:, a], half, f.step), support, f.jump, least=f.support) for a in range(path.shape[1])]
    out[some] = np.stack(guarded, axis=2)
    return out


def fold(df: DataFrame, keys: list[str], order: list[str], errors: list[str], trust: str, out: list[str], folding: Folding, core: int = 4096, overlap: int = 1024, stretch: int = STRETCH) -> DataFrame:
    """Every row (keys, order) with its correction, a column of `out` for each of `errors`: the step
    errors up to that row, each trusted by `trust` (0 to 1; null: not at all). Windows see `overlap` rows
    beyond what they own, many times the memory of the slow part."""

    def solve(offsets: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
        error = np.stack(values[:-1], axis=1)
        found = np.zeros(error.shape)
        for index in equally_long(offsets):
            found[index] = corrected(error[index], values[-1][index], folding)
        return list(found.T)

    return solve_windows(df, keys, order, [*errors, trust], out, solve, core, overlap, stretch)


def compose(rounds: DataFrame, keys: list[str], number: str, rotvec: Column) -> DataFrame:
    """(keys, q, rotvec): the corrections of a row's rounds, in order, as one rotation. Null ones turn
    nothing; rounds are few."""
    part = F.struct(F.col(number).alias("number"), rotvec.alias("v"))
    steps = rounds.groupBy(*keys).agg(F.sort_array(F.collect_list(part)).alias("steps"))
    none = quat(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0))
    turn = lambda q, s: F.when(s.v.x + s.v.y + s.v.z == s.v.x + s.v.y + s.v.z, qmul(q, qexp(s.v))).otherwise(q)
    return steps.withColumn("q", F.aggregate("steps", none, turn)).select(*keys, "q", qlog(F.col("q")).alias("rotvec"))


def accepted_windows(rows: DataFrame, keys: list[str], place: str, before: Column, after: Column, size: int, gain: float = 0.02, least: int = 30) -> DataFrame:
    """(keys, window, n, before, after, accepted): RMS of what was left over before and after a round, in
    windows of `size` rows; accepted where it fell by `gain` or more over at least `least` known rows."""
    known = rows.select(*keys, F.floor(F.col(place) / size).cast("long").alias("window"), before.alias("b"), after.alias("a")).filter("a is not null and b is not null")
    sums = known.groupBy(*keys, "window").agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col("b") * F.col("b"))).alias("before"), F.sqrt(F.avg(F.col("a") * F.col("a"))).alias("after"))
    return sums.withColumn("accepted", (F.col("n") >= least) & (F.col("after") <= (1 - gain) * F.col("before")))


def blended(rows: DataFrame, windows: DataFrame, keys: list[str], place: str, rotvec: Column, size: int) -> DataFrame:
    """The rows with `share`, 1 in accepted windows and 0 in others with a smooth ramp from one window's
    middle to the next one's, and `rotvec`, the correction cut down to that share."""
    order = Window.partitionBy(*keys).orderBy("window")
    flag = F.col("accepted").cast("double")
    beside = lambda step: F.max(flag).over(order.rangeBetween(step, step))
    around = windows.select(*keys, "window", flag.alias("own"), beside(-1).alias("last"), beside(1).alias("next"))
    at = (F.col(place) + 0.5) / size
    out = rows.withColumn("window", F.floor(F.col(place) / size).cast("long")).join(around, [*keys, "window"], "left")
    from_middle = at - F.col("window") - 0.5
    own = F.coalesce("own", F.lit(0.0))
    other = F.when(from_middle >= 0, F.coalesce("next", "own", F.lit(0.0))).otherwise(F.coalesce("last", "own", F.lit(0.0)))
    x = F.abs(from_middle)
    share = own + (other - own) * (0.5 - 0.5 * F.cos(F.lit(np.pi) * x))
    v = rotvec
    cut = out.withColumn("share", share)
    return cut.withColumn("rotvec", vec(v.x * F.col("share"), v.y * F.col("share"), v.z * F.col("share"))).drop("own", "last", "next", "window")
