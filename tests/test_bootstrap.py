import numpy as np
from pyspark.sql import functions as F

from kinesieve.operators import stats

SCHEMA = "g string, x double, y double"


def rows(n=900):
    rng = np.random.default_rng(3)
    x = rng.normal(10, 3, n)
    return [("a" if i % 3 else "b", float(a), float(2 * a + b)) for i, (a, b) in enumerate(zip(x, rng.normal(0, 1, n)))]


def collect(df):
    return {r[0]: r for r in df.collect()}


def test_partitions_do_not_matter(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    one = collect(stats.bootstrap_mean(df.coalesce(1), ["g"], "x", 300))
    other = collect(stats.bootstrap_mean(df.repartition(7), ["g"], "x", 300))
    assert {k: [round(v, 9) for v in r[2:]] for k, r in one.items()} == {k: [round(v, 9) for v in r[2:]] for k, r in other.items()}


def test_width_of_the_intervals(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    data = {g: np.array([r[1:] for r in rows() if r[0] == g]) for g in "ab"}
    for g, r in collect(stats.bootstrap_mean(df, ["g"], "x", 2000)).items():
        x = data[g][:, 0]
        assert np.isclose(r["mean"], x.mean()) and abs((r["hi"] - r["lo"]) / (3.92 * x.std() / np.sqrt(len(x))) - 1) < 0.1
    for g, r in collect(stats.bootstrap_ratio(df, ["g"], "y", "x", 2000)).items():
        x, y = data[g].T
        spread = (y - y.mean() / x.mean() * x).std() / x.mean() / np.sqrt(len(x))
        assert np.isclose(r["ratio"], y.mean() / x.mean()) and abs((r["hi"] - r["lo"]) / (3.92 * spread) - 1) < 0.12
    for g, r in collect(stats.bootstrap_difference(df, ["g"], "y", "x", 2000)).items():
        d = data[g][:, 1] - data[g][:, 0]
        assert np.isclose(r["difference"], d.mean()) and r["lo"] < d.mean() < r["hi"]


def test_equal_rows_draw_apart(spark):
    """A thousand zeros and a thousand ones: the interval is that of 2,000 rows, not of two."""
    df = spark.range(2000).select(F.lit("a").alias("g"), (F.col("id") % 2).cast("double").alias("x"))
    r = stats.bootstrap_mean(df, ["g"], "x", 2000).first()
    assert r["n"] == 2000 and abs((r["hi"] - r["lo"]) / (3.92 * 0.5 / np.sqrt(2000)) - 1) < 0.1


def test_few_rows(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("b", None, 2.0), ("c", 1.0, 0.0), ("c", 1.0, 0.0)], SCHEMA)
    assert collect(stats.bootstrap_mean(df, ["g"], "x", 50))["a"][1:] == (1, 1.0, None, None)
    assert collect(stats.bootstrap_ratio(df, ["g"], "x", "y", 50))["c"]["ratio"] is None
    assert stats.bootstrap_mean(df.limit(0), ["g"], "x", 50).collect() == []
