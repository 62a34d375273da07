"""Readers of the driver's tables and the time-series view of events.

A series is (clip_id, event_id, t, event_type, value, k): one clip per user, t in whole microseconds,
event_id breaking ties, k from the JSON properties. Missing measurements are null, never NaN.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored_by(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """The table dealt by a key, rows of a key in one task and in the order in which the files hold them: sums of
    doubles by that key come out the same however the table is split, as in an engine that reads it row by row."""
    rows = table(spark, sf_dir, name).select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    return rows.repartition(key).sortWithinPartitions(key, "__file", "__row").drop("__file", "__row")


def series(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("user_id").alias("clip_id"),
        "event_id",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("t"),
        "event_type",
        F.nanvl("value", F.lit(None).cast("double")).alias("value"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def read_series(spark: SparkSession, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """Samples(clip_id, t, value) from any of Spark's file formats, NaN as null."""
    df = spark.read.format(fmt).options(**options).load(path)
    return df.select(F.col("clip_id").cast("long"), F.col("t").cast("double"), F.nanvl(F.col("value").cast("double"), F.lit(None).cast("double")).alias("value"))


def write_versioned(df: DataFrame, path: str, version: int) -> None:
    """A table with its schema version beside it, partitioned by that version."""
    df.withColumn("schema_version", F.lit(version)).write.mode("overwrite").partitionBy("schema_version").parquet(path)


#: Version of the plan tables below; readers refuse others.
PLAN_VERSION = 1


def write_plan(frames: DataFrame, rows: DataFrame, header: dict, path: str) -> None:
    """A plan as tables side by side: frames(clip_id, frame, t, ...), rows(clip_id, frame, row, ...)
    partitioned by clip, and one JSON line for what holds of all of them."""
    spark = frames.sparkSession
    frames.write.mode("overwrite").partitionBy("clip_id").parquet(f"{path}/frames")
    rows.write.mode("overwrite").partitionBy("clip_id").parquet(f"{path}/rows")
    line = spark.range(1).select(F.lit(json.dumps(header | {"version": PLAN_VERSION}, sort_keys=True)).alias("value"))
    line.write.mode("overwrite").text(f"{path}/header")


def read_plan(spark: SparkSession, path: str) -> tuple[dict, DataFrame, DataFrame]:
    """The header, frames and rows of write_plan()."""
    lines = [r.value for r in spark.read.text(f"{path}/header").limit(2).collect()]
    header = json.loads(lines[0]) if len(lines) == 1 else {}
    if header.get("version") != PLAN_VERSION:
        raise ValueError(f"not a plan of version {PLAN_VERSION}: {path}")
    return header, spark.read.parquet(f"{path}/frames"), spark.read.parquet(f"{path}/rows")


def shifted_plan(frames: DataFrame, dx: float, dy: float) -> DataFrame:
    """The same plan with every frame's offset moved, to measure what a known error does."""
    return frames.withColumns({"dx": F.coalesce("dx", F.lit(0.0)) + dx, "dy": F.coalesce("dy", F.lit(0.0)) + dy})
