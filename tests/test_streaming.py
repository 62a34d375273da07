from pyspark.sql import functions as F

from kinesieve.plans import sequences
from kinesieve.streaming import windows
from tests.conftest import TINY


def drained(spark, frame, name, mode="append"):
    query = frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name)


def stream(spark, tmp_path):
    df = spark.read.parquet(f"{TINY}/events.parquet")
    df.repartition(1).sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))


def test_row_windows_equal_the_batch_form(spark, tmp_path):
    got = drained(spark, windows.row_window_rms(stream(spark, tmp_path)), "rows").select("clip_id", "win", "n", F.round("rms", 5).alias("rms"))
    expected = sequences.row_window_drop_tail(spark, TINY).select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))


def test_time_windows(spark, tmp_path):
    got = drained(spark, windows.time_window_rms(stream(spark, tmp_path)), "hours", "complete")
    assert got.agg(F.sum("n")).first()[0] == spark.read.parquet(f"{TINY}/events.parquet").count()


def test_sessions(spark):
    df = spark.read.parquet(f"{TINY}/events.parquet")
    got = windows.session_counts(df)
    assert got.agg(F.sum("n")).first()[0] == df.count() and got.filter("end <= start").isEmpty()
