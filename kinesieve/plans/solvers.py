"""Queries of the sequential solvers: one group per gap-free segment, results by row."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinesieve.operators import metrics, seq, solve
from kinesieve.plans.sequences import KEYS, ORDER, events, gappy

GROUP = ["clip_id", "segment_id"]


def segmented(spark, sf_dir):
    """Segments cut at gaps of five times the usual step, so that most are long enough to filter."""
    return seq.segments(events(spark, sf_dir), KEYS, ORDER, high=5.0)


def highpass_rms(spark, sf_dir):
    """RMS of what a zero-phase low-pass of a tenth of the sampling rate leaves over."""
    return rms_by_segment(segmented(spark, sf_dir))


def rms_by_segment(df):
    """Missing rows are interpolated for the filter and take no part in the RMS."""
    df = solve.by_segment(df, GROUP, ORDER, "value", "low", lambda x: solve.zero_phase(solve.filled(x), 0.1, 1.0))
    return df.groupBy(*GROUP).agg(F.count("*").alias("n"), seq.rms(F.col("value") - F.col("low")).alias("rms"))


def weighted_integrate(spark, sf_dir):
    """Path of the centred values, each trusted by its k (of 100)."""
    return integrated(segmented(spark, sf_dir))


def integrated(df):
    def path(x, k):
        import numpy as np

        mean = x[np.isfinite(x)].mean() if np.isfinite(x).any() else 0.0
        return solve.weighted_integral(x - mean, solve.pair_weights(k / 100))[1:]

    out = solve.by_segment(df, GROUP, ORDER, ["value", "k"], "path", path)
    return out.select("clip_id", "event_id", "path")


def velocity_reconstruct(spark, sf_dir):
    """Two measurements: the values are the direct estimate, the steps of k are the changes. Neither is
    measured at errors, so a change misses there and at the row after."""
    return rebuilt(gappy(spark, sf_dir))


def rebuilt(df):
    df = seq.segments(df, KEYS, ORDER, high=5.0)
    k = F.when(F.col("event_type") != "error", F.col("k"))
    df = df.withColumn("change", (k - F.lag(k).over(seq.ordered(GROUP, ORDER))).cast("double"))
    out = solve.by_segment(df, GROUP, ORDER, ["value", "change"], "velocity", lambda x, d: solve.rebuilt_velocity(x, d, 0.1, 1.0))
    return out.select("clip_id", "event_id", "velocity")


def smooth_path(spark, sf_dir):
    df = solve.by_segment(segmented(spark, sf_dir), GROUP, ORDER, "value", "smooth", lambda x: solve.smooth_path(x, 10.0, 50.0))
    return df.select("clip_id", "event_id", "smooth")


def limit_steps(spark, sf_dir):
    df = solve.by_segment(segmented(spark, sf_dir), GROUP, ORDER, "value", "limited", lambda x: solve.limited_steps(x, 3, 20.0))
    return df.select("clip_id", "event_id", "limited")


def jump_guard(spark, sf_dir):
    """Centred values, whose unsupported jumps are faded out; k of 100 is a step's support."""
    df = segmented(spark, sf_dir).withColumn("path", F.col("value") - 60)
    out = solve.by_segment(df, GROUP, ORDER, ["path", "k"], "guarded", lambda x, k: solve.guarded_jumps(x, k / 100, 120.0))
    return out.select("clip_id", "event_id", "guarded")


def signal_paths(spark, sf_dir):
    """Filtered paths of steps from values and k, at one row a second."""
    df = segmented(spark, sf_dir).withColumns({"tx": (F.col("value") - 60) / 50, "ty": (F.col("k") - 50) / 50, "rot": F.col("value") / 1e5, "logs": F.col("k") / 1e5})
    return metrics.filtered_paths(df, GROUP, ORDER, 1.0, cut=0.05, bands=((0.05, 0.2), (0.2, 0.45)))


def signal_metrics(spark, sf_dir):
    """The metric row of every clip."""
    return metrics.metric_row(signal_paths(spark, sf_dir), ["clip_id"], 1920, 1080, calm_speed=0.3)


def window_metrics(spark, sf_dir):
    """Every clip's windows of four rows."""
    return metrics.window_summary(signal_paths(spark, sf_dir), ["clip_id"], ["segment_id"], ORDER, 4, 1920, 1080)


SQL: dict[str, str] = {}
QUERIES = {f.__name__: f for f in (highpass_rms, weighted_integrate, velocity_reconstruct, smooth_path, limit_steps, jump_guard, signal_metrics, window_metrics)}
