"""Filters of orientations, which turn rather than add: along the tangents of the path.

The turns from one sample to the next, as rotation vectors, are summed to a path in a flat space; its fast part
is what the filter takes off, and the orientation is turned back by that much. Exact to first order in the
part taken off, and unaware of how far the path has turned in all. Windows overlap, so a clip is split.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinesieve.functions.rotation import qconj, qlog, qmul, slerp
from kinesieve.operators.solve import filled, zero_phase4
from kinesieve.operators.windows import STRETCH, solve_windows


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of quaternions (rows, 4), w first."""
    w = a[:, :1] * b[:, :1] - (a[:, 1:] * b[:, 1:]).sum(axis=1, keepdims=True)
    return np.concatenate((w, a[:, :1] * b[:, 1:] + b[:, :1] * a[:, 1:] + np.cross(a[:, 1:], b[:, 1:])), axis=1)


def inverse(q: np.ndarray) -> np.ndarray:
    return q * np.array([1.0, -1.0, -1.0, -1.0])


def vector_of(q: np.ndarray) -> np.ndarray:
    """The shortest rotation vectors of quaternions."""
    q = np.where(q[:, :1] < 0, -q, q)
    s = np.linalg.norm(q[:, 1:], axis=1, keepdims=True)
    return q[:, 1:] * np.where(s > 1e-12, 2 * np.arctan2(s, q[:, :1]) / np.maximum(s, 1e-300), 2.0)


def turn_of(v: np.ndarray) -> np.ndarray:
    a = np.linalg.norm(v, axis=1, keepdims=True)
    return np.concatenate((np.cos(a / 2), v * np.where(a > 1e-12, np.sin(a / 2) / np.maximum(a, 1e-300), 0.5)), axis=1)


def calmed(q: np.ndarray, cut: float, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Orientations (rows, 4) without what turns faster than `cut` Hz, and the turns taken off: q is the
    calm orientation followed by them. Short runs and cuts near half the rate are left alone."""
    if len(q) < 16 or cut >= 0.45 * rate:
        return q, np.zeros((len(q), 3))
    turns = vector_of(product(inverse(q[:-1]), q[1:]))
    path = np.concatenate((np.zeros((1, 3)), np.cumsum(turns, axis=0)))
    fast = path - np.stack([zero_phase4(p, cut, rate) for p in path.T], axis=1)
    out = product(q, turn_of(-fast))
    return out / np.linalg.norm(out, axis=1, keepdims=True), fast


def lowpass_orientation(df: DataFrame, keys: list[str], order: list[str], parts: list[str], cut: float, rate: float, core: int = 8192, overlap: int = 2048, stretch: int = STRETCH) -> DataFrame:
    """(keys, order, q_w, q_x, q_y, q_z, fast_x, fast_y, fast_z) of every row: the calm orientation, with the
    sign of the given one, and the turn taken off. parts: the columns w, x, y, z; rows missing one take
    part by interpolation and stay null."""

    def solve(offsets: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
        out = np.full((7, len(values[0])), np.nan)
        for i, j in zip(offsets, offsets[1:]):
            known = np.logical_and.reduce([np.isfinite(v[i:j]) for v in values])
            if known.any():
                q = np.stack([filled(np.where(known, v[i:j], np.nan)) for v in values], axis=1)
                q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)
                calm, fast = calmed(q, cut, rate)
                out[:, i:j] = np.where(known, np.concatenate((calm, fast), axis=1).T, np.nan)
        return list(out)

    names = ["q_w", "q_x", "q_y", "q_z", "fast_x", "fast_y", "fast_z"]
    return solve_windows(df, keys, order, parts, names, solve, core, overlap, stretch)


def rate_at(frames: DataFrame, samples: DataFrame, keys: list[str], half: float) -> DataFrame:
    """Frames(keys, t, ...) with `rate`, the rotation vector per unit of time around t from orientations
    samples(keys, t, q), by those half before and half after. Outside the samples there is none."""
    whole = F.struct(*frames.columns)
    numbered = frames.select(*keys, F.col("t").alias("__frame_t"), whole.alias("__frame"), F.monotonically_increasing_id().alias("__row"))
    ends = numbered.select("*", F.explode(F.array(F.lit(-1), F.lit(1))).alias("__side"))
    asked = ends.select(*keys, (F.col("__frame_t") + F.col("__side") * half).alias("__t"), F.lit(None).cast(samples.schema["q"].dataType).alias("q"), "__frame", "__row", "__side", F.lit(1).alias("__asked"))
    given = samples.filter("q is not null").select(*keys, F.col("t").cast("double").alias("__t"), "q", F.lit(None).cast(asked.schema["__frame"].dataType).alias("__frame"), F.lit(None).cast("long").alias("__row"), F.lit(None).cast("int").alias("__side"), F.lit(0).alias("__asked"))
    order = Window.partitionBy(*keys).orderBy("__t", "__asked")
    sample = F.when(F.col("__asked") == 0, F.struct("__t", "q"))
    around = given.unionByName(asked).withColumns({
        "a": F.last(sample, True).over(order.rowsBetween(Window.unboundedPreceding, 0)), "b": F.first(sample, True).over(order.rowsBetween(0, Window.unboundedFollowing)),
    })
    a, b = F.col("a"), F.col("b")
    share = F.when(b["__t"] > a["__t"], (F.col("__t") - a["__t"]) / (b["__t"] - a["__t"])).otherwise(0.0)
    read = around.filter("__asked = 1").withColumn("at", F.when(a.isNotNull() & b.isNotNull(), slerp(a.q, b.q, share)))
    sides = read.groupBy("__row").agg(F.first("__frame").alias("f"), F.max_by("at", "__side").alias("late"), F.min_by("at", "__side").alias("early"))
    turn = sides.withColumn("v", F.when(F.col("early").isNotNull() & F.col("late").isNotNull(), qlog(qmul(qconj(F.col("early")), F.col("late")))))
    return turn.select("f.*", F.when(F.col("v").isNotNull(), F.struct(*[(F.col("v")[c] / (2 * half)).alias(c) for c in "xyz"])).alias("rate"))
