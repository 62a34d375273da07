"""Sequence queries over events, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinesieve.operators import seq
from kinesieve.sources.tables import series, table

KEYS, ORDER = ["clip_id"], ["t", "event_id"]
S = "s AS (SELECT user_id AS clip_id, event_id, epoch_us(ts) AS t, event_type, value FROM events)"
G = "s AS (SELECT user_id AS clip_id, event_id, epoch_us(ts) AS t, CASE WHEN event_type <> 'error' THEN value END AS value FROM events)"
O = "PARTITION BY clip_id ORDER BY t, event_id"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series(table(spark, sf_dir, "events"))


def gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value of errors is taken as not measured."""
    return events(spark, sf_dir).withColumn("value", F.when(F.col("event_type") != "error", F.col("value")))


def segments_by_gap(spark, sf_dir):
    return seq.segments(events(spark, sf_dir), KEYS, ORDER).select("clip_id", "event_id", "segment_id")


def segments_two_sided(spark, sf_dir):
    return seq.segments(events(spark, sf_dir), KEYS, ORDER, low=0.5).select("clip_id", "event_id", "segment_id")


def segment_sql(extra: str) -> str:
    return f"""WITH {S}, d AS (SELECT *, t - lag(t) OVER ({O}) AS dt FROM s),
m AS (SELECT clip_id, median(dt) AS med FROM d GROUP BY clip_id)
SELECT clip_id, event_id, CAST(sum(CASE WHEN dt > 1.5 * med {extra} THEN 1 ELSE 0 END) OVER ({O} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment_id
FROM d JOIN m USING (clip_id)"""


def dedup_held(spark, sf_dir):
    return seq.drop_held(events(spark, sf_dir), KEYS, ORDER, "event_type", 170).select("clip_id", "event_id", "t", "event_type")


def run_length_histogram(spark, sf_dir):
    runs = seq.run_lengths(events(spark, sf_dir), KEYS, ORDER, "event_type")
    return runs.groupBy("event_type", F.col("n").alias("run_length")).agg(F.count("*").alias("n_runs"))


def true_runs(spark, sf_dir):
    return seq.true_runs(events(spark, sf_dir), KEYS, ORDER, F.col("event_type") != "error")


def sign_continuity(spark, sf_dir):
    whole = seq.ordered(KEYS, ORDER).rowsBetween(seq.W.unboundedPreceding, seq.W.unboundedFollowing)  # summed in order, so always to the same
    df = events(spark, sf_dir).withColumn("x", F.col("value") - F.avg("value").over(whole))
    product = F.col("x") * F.lag("x").over(seq.ordered(KEYS, ORDER))
    df = df.withColumn("p", product).withColumn("y", seq.keep_sign(F.col("x"), F.col("p"), KEYS, ORDER))
    # halves away from zero as the SQL finds them, in the scaled number and not in its decimal digits
    return df.select("clip_id", "event_id", (F.signum("y") * F.floor(F.abs("y") * 1e5 + 0.5) / 1e5).alias("x"))


def gap_interpolate(spark, sf_dir):
    return seq.interpolate(gappy(spark, sf_dir), KEYS, ORDER, "value", "filled").select("clip_id", "event_id", F.round("filled", 5).alias("filled"))


def path_prefix_sum(spark, sf_dir):
    total = F.sum("value").over(seq.ordered(KEYS, ORDER).rowsBetween(seq.W.unboundedPreceding, -1))
    return events(spark, sf_dir).select("clip_id", "event_id", F.round(F.coalesce(total, F.lit(0.0)), 4).alias("path"))


def running_median7(spark, sf_dir):
    return gappy(spark, sf_dir).select("clip_id", "event_id", F.round(seq.running_median("value", 3, KEYS, ORDER), 5).alias("median7"))


def step_series(spark, sf_dir):
    """Steps of the signal against their own running median."""
    df = events(spark, sf_dir).withColumn("v", F.col("value") - F.lag("value").over(seq.ordered(KEYS, ORDER))).filter("v IS NOT NULL")
    return df.select("clip_id", "event_id", F.round(F.abs(F.col("v") - seq.running_median("v", 3, KEYS, ORDER)), 5).alias("step"))


def deviations(spark, sf_dir):
    return events(spark, sf_dir).withColumn("dev", F.col("value") - seq.median_around("value", 3, 0, KEYS, ORDER))


def spike_deviation(spark, sf_dir):
    return deviations(spark, sf_dir).select("clip_id", "event_id", F.round("dev", 5).alias("dev"))


def local_scale(spark, sf_dir):
    """Median size within 30 rows but further than 2 away."""
    df = events(spark, sf_dir).withColumn("size", F.abs("value"))
    return df.select("clip_id", "event_id", F.round(seq.median_around("size", 30, 2, KEYS, ORDER), 5).alias("scale"))


def spike_events(spark, sf_dir):
    return seq.spike_events(deviations(spark, sf_dir), KEYS, ORDER, "dev", 100.0).select("clip_id", "event", "start", "n", F.round("peak", 5).alias("peak"))


def hampel_pass(spark, sf_dir):
    return seq.hampel(events(spark, sf_dir), KEYS, ORDER, "value", 4, 30, 3.0, 1.0).select("clip_id", "event_id", "outlier")


def running_mean_edge(spark, sf_dir):
    return events(spark, sf_dir).select("clip_id", "event_id", F.round(seq.edge_mean("value", 4, KEYS, ORDER), 5).alias("mean9"))


def hann_smooth(spark, sf_dir):
    return events(spark, sf_dir).select("clip_id", "event_id", F.round(seq.hann_mean("value", 2, KEYS, ORDER), 5).alias("hann5"))


def erode_min(spark, sf_dir):
    return events(spark, sf_dir).select("clip_id", "event_id", F.round(seq.erode("value", 5, KEYS, ORDER), 5).alias("least"))


def row_window_rms(spark, sf_dir):
    """Windows of ten rows inside each gap-free segment; short tails join the last window."""
    df = seq.segments(events(spark, sf_dir), KEYS, ORDER)
    df = seq.row_windows(df, ["clip_id", "segment_id"], ORDER, 10)
    return df.groupBy("clip_id", "segment_id", "win").agg(F.count("*").alias("n"), F.round(seq.rms(F.col("value")), 5).alias("rms"))


def row_window_drop_tail(spark, sf_dir):
    df = seq.row_windows(events(spark, sf_dir), KEYS, ORDER, 10, keep_tail=False)
    return df.groupBy("clip_id", "win").agg(F.count("*").alias("n"), F.round(seq.rms(F.col("value")), 5).alias("rms"))


def window_accept(spark, sf_dir):
    """Windows whose RMS is at most 10 % over the best before them and 5 absolute."""
    rows = row_window_drop_tail(spark, sf_dir)
    best = F.min("rms").over(seq.W.partitionBy("clip_id").orderBy("win").rowsBetween(seq.W.unboundedPreceding, -1))
    return rows.withColumn("best", best).withColumn("accepted", F.coalesce(F.col("rms") <= F.col("best") * 1.1 + 5, F.lit(True))).select("clip_id", "win", "accepted")


def hopping_windows(spark, sf_dir):
    """Windows of 16 rows with a halo of 4 rows on both sides."""
    df = events(spark, sf_dir).withColumn("k", F.row_number().over(seq.ordered(KEYS, ORDER)) - 1)
    win = F.explode(F.sequence(F.greatest(F.lit(0), F.ceil((F.col("k") - 19) / F.lit(16))), F.floor((F.col("k") + 4) / F.lit(16))))
    df = df.select("clip_id", "k", "value", win.alias("win"))
    return df.groupBy("clip_id", "win").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total")).select("clip_id", F.col("win").cast("long").alias("win"), "n", "total")


WINDOWS = f"""w AS (SELECT clip_id, (row_number() OVER ({O}) - 1) // 10 AS win, count(*) OVER (PARTITION BY clip_id) // 10 AS full_, value FROM s),
r AS (SELECT clip_id, CAST(win AS BIGINT) AS win, count(*) AS n, round(sqrt(avg(value * value)), 5) AS rms FROM w WHERE win < full_ GROUP BY 1, 2)"""

SQL = {
    "segments_by_gap": segment_sql(""),
    "segments_two_sided": segment_sql("OR dt < 0.5 * med"),
    "dedup_held": f"""WITH {S}, d AS (SELECT *, lag(event_type) OVER ({O}) AS before, row_number() OVER ({O}) AS k FROM s)
SELECT clip_id, event_id, t + 170 AS t, event_type FROM d WHERE k = 1 OR before IS DISTINCT FROM event_type""",
    "run_length_histogram": f"""WITH {S}, d AS (SELECT *, row_number() OVER ({O}) - row_number() OVER (PARTITION BY clip_id, event_type ORDER BY t, event_id) AS island FROM s),
r AS (SELECT clip_id, event_type, island, count(*) AS run_length FROM d GROUP BY 1, 2, 3)
SELECT event_type, run_length, count(*) AS n_runs FROM r GROUP BY 1, 2""",
    "true_runs": f"""WITH {S}, d AS (SELECT *, row_number() OVER ({O}) - 1 AS k FROM s),
h AS (SELECT clip_id, k, k - row_number() OVER ({O}) AS island FROM d WHERE event_type <> 'error')
SELECT clip_id, min(k) AS start, max(k) + 1 AS stop FROM h GROUP BY clip_id, island""",
    "sign_continuity": f"""WITH {S}, a AS (SELECT *, value - avg(value) OVER (PARTITION BY clip_id) AS x FROM s),
b AS (SELECT *, CASE WHEN x * lag(x) OVER ({O}) < 0 THEN 1 ELSE 0 END AS flip FROM a)
SELECT clip_id, event_id, round(CASE WHEN sum(flip) OVER ({O} ROWS UNBOUNDED PRECEDING) % 2 = 0 THEN x ELSE -x END, 5) AS x FROM b""",
    "gap_interpolate": f"""WITH {G}, k AS (SELECT *, row_number() OVER ({O}) AS k FROM s),
p AS (SELECT *, max(CASE WHEN value IS NOT NULL THEN k END) OVER ({O} ROWS UNBOUNDED PRECEDING) AS ka,
 min(CASE WHEN value IS NOT NULL THEN k END) OVER ({O} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS kb FROM k)
SELECT p.clip_id, p.event_id, round(CASE WHEN p.value IS NOT NULL THEN p.value WHEN ka IS NULL THEN b.value WHEN kb IS NULL THEN a.value
 ELSE a.value + (p.k - ka) / CAST(kb - ka AS DOUBLE) * (b.value - a.value) END, 5) AS filled
FROM p LEFT JOIN k a ON a.clip_id = p.clip_id AND a.k = ka LEFT JOIN k b ON b.clip_id = p.clip_id AND b.k = kb""",
    "path_prefix_sum": f"WITH {S} SELECT clip_id, event_id, round(coalesce(sum(value) OVER ({O} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0), 4) AS path FROM s",
    "running_median7": f"WITH {G} SELECT clip_id, event_id, round(median(value) OVER ({O} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 5) AS median7 FROM s",
    "step_series": f"""WITH {S}, d AS (SELECT * FROM (SELECT *, value - lag(value) OVER ({O}) AS v FROM s) WHERE v IS NOT NULL)
SELECT clip_id, event_id, round(abs(v - median(v) OVER ({O} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)), 5) AS step FROM d""",
    "spike_deviation": f"WITH {S} SELECT clip_id, event_id, round(value - median(value) OVER ({O} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING EXCLUDE CURRENT ROW), 5) AS dev FROM s",
    "local_scale": f"""WITH {S}, k AS (SELECT *, row_number() OVER ({O}) AS k FROM s)
SELECT a.clip_id, a.event_id, round(median(abs(b.value)), 5) AS scale FROM k a LEFT JOIN k b ON a.clip_id = b.clip_id AND abs(a.k - b.k) BETWEEN 3 AND 30 GROUP BY 1, 2""",
    "spike_events": f"""WITH {S}, d AS (SELECT *, row_number() OVER ({O}) AS k, value - median(value) OVER ({O} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING EXCLUDE CURRENT ROW) AS dev FROM s),
h AS (SELECT * FROM d WHERE abs(dev) > 100),
g AS (SELECT *, CASE WHEN k - lag(k) OVER ({O}) > 2 OR lag(k) OVER ({O}) IS NULL THEN 1 ELSE 0 END AS new FROM h),
e AS (SELECT *, CAST(sum(new) OVER ({O} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS event FROM g)
SELECT clip_id, event, min(k) - 1 AS start, count(*) AS n, round(max(abs(dev)), 5) AS peak FROM e GROUP BY 1, 2""",
    "hampel_pass": f"""WITH {S}, d AS (SELECT *, abs(value - median(value) OVER ({O} ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)) AS away FROM s)
SELECT clip_id, event_id, away > 3.0 * greatest(1.4826 * median(away) OVER ({O} ROWS BETWEEN 30 PRECEDING AND 30 FOLLOWING), 1.0) AS outlier FROM d""",
    "running_mean_edge": f"""WITH {S}, k AS (SELECT *, row_number() OVER ({O}) AS k, count(*) OVER (PARTITION BY clip_id) AS n FROM s),
o AS (SELECT unnest(range(-4, 5)) AS i)
SELECT a.clip_id, a.event_id, round(avg(b.value), 5) AS mean9 FROM k a CROSS JOIN o JOIN k b ON b.clip_id = a.clip_id AND b.k = least(greatest(a.k + i, 1), a.n) GROUP BY 1, 2""",
    "hann_smooth": f"""WITH {S}, k AS (SELECT *, row_number() OVER ({O}) AS k, count(*) OVER (PARTITION BY clip_id) AS n FROM s),
o AS (SELECT i, 0.5 * (1 + cos(pi() * i / 3.0)) AS w FROM (SELECT unnest(range(-2, 3)) AS i))
SELECT a.clip_id, a.event_id, round(sum(w * b.value) / sum(w), 5) AS hann5 FROM k a CROSS JOIN o JOIN k b ON b.clip_id = a.clip_id AND b.k = least(greatest(a.k + i, 1), a.n) GROUP BY 1, 2""",
    "erode_min": f"WITH {S} SELECT clip_id, event_id, round(min(value) OVER ({O} ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING), 5) AS least FROM s",
    "row_window_rms": f"""WITH {S}, d AS (SELECT *, t - lag(t) OVER ({O}) AS dt FROM s),
m AS (SELECT clip_id, median(dt) AS med FROM d GROUP BY clip_id),
g AS (SELECT clip_id, event_id, t, value, CAST(sum(CASE WHEN dt > 1.5 * med THEN 1 ELSE 0 END) OVER ({O} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment_id FROM d JOIN m USING (clip_id)),
w AS (SELECT clip_id, segment_id, value, (row_number() OVER (PARTITION BY clip_id, segment_id ORDER BY t, event_id) - 1) // 10 AS a,
 greatest(1, count(*) OVER (PARTITION BY clip_id, segment_id) // 10) - 1 AS b FROM g)
SELECT clip_id, segment_id, CAST(least(a, b) AS BIGINT) AS win, count(*) AS n, round(sqrt(avg(value * value)), 5) AS rms FROM w GROUP BY 1, 2, 3""",
    "row_window_drop_tail": f"WITH {S}, {WINDOWS} SELECT * FROM r",
    "window_accept": f"""WITH {S}, {WINDOWS} SELECT clip_id, win, coalesce(rms <= 1.1 * min(rms) OVER (PARTITION BY clip_id ORDER BY win ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 5, true) AS accepted FROM r""",
    "hopping_windows": f"""WITH {S}, k AS (SELECT clip_id, value, row_number() OVER ({O}) - 1 AS k FROM s)
SELECT clip_id, win, count(*) AS n, round(sum(value), 3) AS total FROM (
 SELECT clip_id, value, unnest(range(greatest(0, CAST(ceil((k - 19) / 16.0) AS BIGINT)), (k + 4) // 16 + 1)) AS win FROM k) GROUP BY 1, 2""",
}
QUERIES = {name: globals()[name] for name in SQL}
