"""Queries that plan paths under limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinesieve.operators import paths
from kinesieve.plans.sequences import ORDER
from kinesieve.plans.solvers import GROUP, segmented


def limits(df):
    """Values may be left by as much as k allows, k itself by 15 up and 10 down; purchases stay as they are."""
    return df.withColumns({
        "k": F.col("k").cast("double"), "value_room": 20 + F.col("k") / 5, "up": F.lit(15.0), "down": F.lit(10.0),
        "lock": F.when(F.col("event_type") == "purchase", 1.0).otherwise(0.0),
    })


def planned_path(spark, sf_dir):
    """The calmest path of value and k, each segment's in windows of 512 rows."""
    return planned(limits(segmented(spark, sf_dir)))


def planned(df, core: int = 512, overlap: int = 128):
    out = paths.plan_path(df, GROUP, ORDER, ["value", "k"], ["value_room", "up", "value_room", "down"], "lock", ["path_value", "path_k"], core=core, overlap=overlap)
    return out.select("clip_id", "event_id", "path_value", "path_k")


SQL: dict[str, str] = {}
QUERIES = {f.__name__: f for f in (planned_path,)}
