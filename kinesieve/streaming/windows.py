"""Streaming forms of the sequence operators: an extension, bounded by watermarks and groups."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def time_window_rms(events: DataFrame, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """RMS of the values per clip and time window; rows later than `late` are left out."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = timed.groupBy(F.window("ts", length).alias("w"), "user_id").agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"))
    return out.select(F.col("user_id").alias("clip_id"), F.col("w.start").alias("start"), "n", "rms")


def session_counts(events: DataFrame, gap: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rows and span of each clip's sessions, cut where nothing came for `gap`."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = timed.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select(F.col("user_id").alias("clip_id"), F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def row_window_rms(events: DataFrame, length: int = 10) -> DataFrame:
    """RMS of every `length` rows of a clip as they arrive; the state is one unfinished window."""
    state = "n long, total double, win long"
    out = "clip_id long, win long, n long, rms double"

    def run(key, batches: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        n, total, win = held.get if held.exists else (0, 0.0, 0)
        rows = []
        for pdf in batches:
            for v in pdf.sort_values(["ts", "event_id"])["value"]:
                n, total = n + 1, total + v * v
                if n == length:
                    rows.append((key[0], win, n, (total / n) ** 0.5))
                    n, total, win = 0, 0.0, win + 1
        held.update((n, total, win))
        yield pd.DataFrame(rows, columns=["clip_id", "win", "n", "rms"])

    keyed = events.select(F.col("user_id").alias("clip_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    return keyed.groupBy("clip_id").applyInPandasWithState(run, out, state, "append", "NoTimeout")
