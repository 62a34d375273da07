import pytest
from pyspark.sql import functions as F

from kinesieve.sources import tables


def test_plan_round_trip(spark, tmp_path):
    frames = spark.createDataFrame([(1, 0, 0.0, 0.5, None), (1, 1, 0.1, None, 2.0), (2, 0, 0.0, 1.0, 1.0)], "clip_id long, frame int, t double, dx double, dy double")
    rows = frames.select("clip_id", "frame", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("row"))
    tables.write_plan(frames, rows, {"width": 1920, "fps": 59.94}, f"{tmp_path}/plan")
    header, again, lines = tables.read_plan(spark, f"{tmp_path}/plan")
    assert header == {"width": 1920, "fps": 59.94, "version": tables.PLAN_VERSION}
    assert sorted(again.select(*frames.columns).collect(), key=str) == sorted(frames.collect(), key=str) and lines.count() == 12
    assert [tuple(r) for r in tables.shifted_plan(again, 1.0, -1.0).orderBy("clip_id", "frame").select("dx", "dy").collect()] == [(1.5, -1.0), (1.0, 1.0), (2.0, 0.0)]
    spark.range(1).select(F.lit('{"version": 99}').alias("value")).write.mode("overwrite").text(f"{tmp_path}/plan/header")
    with pytest.raises(ValueError):
        tables.read_plan(spark, f"{tmp_path}/plan")
