"""Join queries: as-of, bracketing, interval, band, dense and set joins over events."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinesieve.operators import joins, seq
from kinesieve.plans.sequences import KEYS, ORDER, O, S, events
from kinesieve.sources.tables import table

MINUTE = 60_000_000


def sides(spark, sf_dir):
    """Clicks ask, all other events answer."""
    df = events(spark, sf_dir)
    return df.filter("event_type = 'click'").select("clip_id", "event_id", "t"), df.filter("event_type <> 'click'").select("clip_id", "event_id", "t", "value")


def asof_prev(spark, sf_dir):
    left, right = sides(spark, sf_dir)
    return joins.asof(left, right, "clip_id", "t", "event_id", ["value"]).select("clip_id", "event_id", F.col("value_r").alias("value"))


def asof_next(spark, sf_dir):
    left, right = sides(spark, sf_dir)
    return joins.asof(left, right, "clip_id", "t", "event_id", ["value"], "next").select("clip_id", "event_id", F.col("value_r").alias("value"))


def asof_nearest(spark, sf_dir):
    left, right = sides(spark, sf_dir)
    return joins.nearest(left, right, "clip_id", "t", "event_id", ["value"]).select("clip_id", "event_id", F.col("value_r").alias("value"))


def bracket_lerp(spark, sf_dir):
    left, right = sides(spark, sf_dir)
    both = joins.bracket(left, right, "clip_id", "t", "event_id", ["value"])
    value = joins.lerp(F.col("t"), F.col("t_0"), F.col("t_1"), F.col("value_0"), F.col("value_1"))
    return both.select("clip_id", "event_id", F.round(value, 4).alias("value"))


def uniform_grid_resample(spark, sf_dir):
    """Values at every sixth hour of each clip."""
    df = events(spark, sf_dir).select("clip_id", "event_id", "t", "value")
    grid = joins.uniform_grid(df, "clip_id", "t", 360 * MINUTE)
    both = joins.bracket(grid, df, "clip_id", "t", "event_id", ["value"])
    value = joins.lerp(F.col("t"), F.col("t_0"), F.col("t_1"), F.col("value_0"), F.col("value_1"))
    return both.select("clip_id", "t", F.round(value, 4).alias("value"))


def slots(spark, sf_dir):
    """Half-hour exposures from every click on, and the slabs between neighbouring other events."""
    left, right = sides(spark, sf_dir)
    left = left.select("clip_id", F.col("event_id").alias("out_id"), F.col("t").alias("start"), (F.col("t") + 1800 * MINUTE // 60 * 60).alias("stop"))
    w = seq.ordered(["clip_id"], ["t", "event_id"])
    right = right.select("clip_id", F.col("event_id").alias("src_id"), F.col("t").alias("start"), F.lead("t").over(w).alias("stop")).filter("stop > start")
    return left, right


def interval_overlap_weights(spark, sf_dir):
    left, right = slots(spark, sf_dir)
    out = joins.interval_overlaps(left, right, "clip_id", "out_id", "src_id", 2880 * MINUTE, 0.005)
    return out.withColumn("weight", F.round("weight", 5))


def last_use(spark, sf_dir):
    """The last exposure that uses each slab, -1 where none does."""
    left, right = slots(spark, sf_dir)
    used = joins.interval_overlaps(left, right, "clip_id", "out_id", "src_id", 2880 * MINUTE, 0.005)
    last = used.groupBy("clip_id", "src_id").agg(F.max("out_id").alias("last_use"))
    return right.select("clip_id", "src_id").join(last, ["clip_id", "src_id"], "left").withColumn("last_use", F.coalesce("last_use", F.lit(-1)))


def positions(spark, sf_dir):
    return events(spark, sf_dir).withColumn("k", F.row_number().over(seq.ordered(KEYS, ORDER)).cast("long")).select("clip_id", "k", "event_type", "value")


def band_match(spark, sf_dir):
    """Errors with a purchase at most one row away: how many, and the largest value there."""
    df = positions(spark, sf_dir)
    pairs = joins.band(df.filter("event_type = 'error'"), df.filter("event_type = 'purchase'"), "clip_id", "k", 1)
    return pairs.groupBy("clip_id", "k").agg(F.count("*").alias("n"), F.max("value_r").alias("largest"))


def only_in_test(spark, sf_dir):
    """Errors without any purchase at most one row away."""
    df = positions(spark, sf_dir)
    there = df.filter("event_type = 'purchase'").select("clip_id", F.explode(F.sequence(F.col("k") - 1, F.col("k") + 1)).alias("k"))
    return df.filter("event_type = 'error'").join(there, ["clip_id", "k"], "left_anti").select("clip_id", "k", "value")


def exists_neighbor(spark, sf_dir):
    """Clicks with a larger purchase among the three rows on either side."""
    df = positions(spark, sf_dir)
    near = df.filter("event_type = 'purchase'").select("clip_id", F.col("value").alias("v"), F.explode(F.sequence(F.col("k") - 3, F.col("k") + 3)).alias("k"))
    near = near.groupBy("clip_id", "k").agg(F.max("v").alias("v"))
    clicks = df.filter("event_type = 'click'")
    return clicks.join(near, ["clip_id", "k"], "left_semi").join(near, ["clip_id", "k"]).filter("v > value").select("clip_id", "k", "value")


def densify_pairs(spark, sf_dir):
    """Purchases on the spine of all rows: null values, and weight 0, elsewhere."""
    df = positions(spark, sf_dir)
    sparse = df.filter("event_type = 'purchase'").select("clip_id", "k", "value")
    out = joins.densify(sparse, "clip_id", "k", df.select("clip_id", "k"))
    return out.select("clip_id", "k", "value", F.col("value").isNotNull().cast("int").alias("weight"))


def merge_prefer_new(spark, sf_dir):
    """The newer of two measurements where it was made: purchases over clicks by hour."""
    df = events(spark, sf_dir).withColumn("hour", F.floor(F.col("t") / (60 * MINUTE)))
    old = df.filter("event_type = 'click'").groupBy("clip_id", "hour").agg(F.max("value").alias("old"))
    new = df.filter("event_type = 'purchase'").groupBy("clip_id", "hour").agg(F.max("value").alias("new"))
    return old.join(new, ["clip_id", "hour"], "full").select("clip_id", "hour", F.coalesce("new", "old").alias("value"))


def consecutive_triples(spark, sf_dir):
    """Clips as tracks over days: days followed by the next day, and by the one after that."""
    days = events(spark, sf_dir).select("clip_id", F.floor(F.col("t") / (1440 * MINUTE)).alias("day")).distinct()
    return joins.links(days, "clip_id", "day").select("clip_id", "day", "triple")


def knn_ratio_test(spark, sf_dir):
    """Label 0 against all other labels: nearest neighbours that beat the second by the ratio 0.95.

    Blocks of queries meet blocks of candidates, so a task holds one block of each side; the two best
    of every block meet in one window per query.
    """
    import numpy as np
    import pandas as pd

    df = table(spark, sf_dir, "embeddings").filter("embedding IS NOT NULL").select("vec_id", "label", "embedding")
    n, asked = max(1, -(-df.count() // 8192)), max(1, -(-df.filter("label = 0").count() // 8192))
    own = lambda many: F.pmod(F.xxhash64("vec_id"), F.lit(many)).cast("int")
    every = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)))
    candidates = df.filter("label <> 0").withColumn("block", own(n)).withColumn("asked", every(asked))
    queries_ = df.filter("label = 0").withColumn("asked", own(asked)).withColumn("block", every(n))

    def two_best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "d": []}).astype({"query_id": "int64", "vec_id": "int64"})
        q, c = (np.stack(x["embedding"]).astype(float) for x in (left, right))
        ids = right["vec_id"].to_numpy()
        out = []
        for i in range(0, len(q), 256):
            d = ((q[i : i + 256, None, :] - c[None, :, :]) ** 2).sum(2) if len(c) * len(q) < 1 << 18 else np.maximum((q[i : i + 256] ** 2).sum(1)[:, None] + (c**2).sum(1) - 2 * q[i : i + 256] @ c.T, 0)
            best = np.argpartition(d, min(1, d.shape[1] - 1), axis=1)[:, :2]
            for r in range(best.shape[1]):
                out.append(pd.DataFrame({"query_id": left["vec_id"].to_numpy()[i : i + 256], "vec_id": ids[best[:, r]], "d": np.take_along_axis(d, best[:, r : r + 1], 1).ravel()}))
        return pd.concat(out)

    found = queries_.groupBy("asked", "block").cogroup(candidates.groupBy("asked", "block")).applyInPandas(two_best, "query_id long, vec_id long, d double")
    w = W.partitionBy("query_id").orderBy("d", "vec_id")
    both = found.withColumn("r", F.row_number().over(w)).withColumn("second", F.lead("d").over(w)).filter("r = 1")
    return both.filter(F.col("d") < 0.95 * 0.95 * F.col("second")).select("query_id", "vec_id", F.round(F.sqrt("d"), 4).alias("distance"))


def lag_alignment(spark, sf_dir):
    """Best shift of -3..3 rows between a clip's values and their running maximum of three."""
    df = positions(spark, sf_dir).withColumn("other", F.max("value").over(seq.ordered(KEYS, ["k"]).rowsBetween(-2, 0)))
    shifted = df.select("clip_id", "k", "value", F.explode(F.sequence(F.lit(-3), F.lit(3))).alias("lag"))
    pairs = shifted.withColumn("at", F.col("k") + F.col("lag")).join(df.select("clip_id", F.col("k").alias("at"), "other"), ["clip_id", "at"])
    cost = pairs.groupBy("clip_id", "lag").agg((F.sum(F.round(F.abs(F.col("value") - F.col("other")) * 100).cast("long")) / F.count("*")).alias("cost"))
    best = F.row_number().over(W.partitionBy("clip_id").orderBy("cost", "lag"))
    return cost.withColumn("r", best).filter("r = 1").select("clip_id", "lag", "cost")


SPLIT = f"{S}, l AS (SELECT clip_id, event_id, t FROM s WHERE event_type = 'click'), r AS (SELECT clip_id, event_id, t, value FROM s WHERE event_type <> 'click')"
PREV = "x AS (SELECT l.clip_id, l.event_id, l.t, r.t AS ta, r.value AS va FROM l ASOF LEFT JOIN r ON l.clip_id = r.clip_id AND l.t >= r.t)"
NEXT = "y AS (SELECT l.event_id, r.t AS tb, r.value AS vb FROM l ASOF LEFT JOIN r ON l.clip_id = r.clip_id AND l.t <= r.t)"
SLOTS = f"""{SPLIT}, o AS (SELECT clip_id, event_id AS out_id, t AS start, t + {1800 * MINUTE // 60 * 60} AS stop FROM l),
i AS (SELECT * FROM (SELECT clip_id, event_id AS src_id, t AS start, lead(t) OVER ({O}) AS stop FROM r) WHERE stop > start),
w AS (SELECT o.clip_id, out_id, src_id, (least(o.stop, i.stop) - greatest(o.start, i.start)) / CAST(o.stop - o.start AS DOUBLE) AS w
 FROM o JOIN i ON o.clip_id = i.clip_id AND i.start < o.stop AND i.stop > o.start),
k AS (SELECT * FROM w WHERE w >= 0.005)"""
P = f"{S}, p AS (SELECT clip_id, row_number() OVER ({O}) AS k, event_type, value FROM s)"
SQL = {
    "asof_prev": f"WITH {SPLIT}, {PREV} SELECT clip_id, event_id, va AS value FROM x",
    "asof_next": f"WITH {SPLIT}, {NEXT} SELECT l.clip_id, event_id, vb AS value FROM l JOIN y USING (event_id)",
    "asof_nearest": f"WITH {SPLIT}, {PREV}, {NEXT} SELECT clip_id, event_id, CASE WHEN tb IS NULL OR t - ta <= tb - t THEN va ELSE vb END AS value FROM x JOIN y USING (event_id)",
    "bracket_lerp": f"""WITH {SPLIT}, {PREV}, {NEXT} SELECT clip_id, event_id, round(CASE WHEN ta IS NULL THEN vb WHEN tb IS NULL OR ta = tb THEN va
 ELSE va + (t - ta) / CAST(tb - ta AS DOUBLE) * (vb - va) END, 4) AS value FROM x JOIN y USING (event_id)""",
    "uniform_grid_resample": f"""WITH {S}, e AS (SELECT clip_id, min(t) AS lo, max(t) AS hi FROM s GROUP BY 1),
g AS (SELECT clip_id, i * {360 * MINUTE} AS t FROM (SELECT clip_id, unnest(range(CAST(ceil(lo / {360.0 * MINUTE}) AS BIGINT), hi // {360 * MINUTE} + 1)) AS i FROM e)),
a AS (SELECT g.clip_id, g.t, s.t AS ta, s.value AS va FROM g ASOF LEFT JOIN s ON g.clip_id = s.clip_id AND g.t >= s.t),
b AS (SELECT g.clip_id, g.t, s.t AS tb, s.value AS vb FROM g ASOF LEFT JOIN s ON g.clip_id = s.clip_id AND g.t <= s.t)
SELECT clip_id, t, round(CASE WHEN ta = tb THEN va ELSE va + (t - ta) / CAST(tb - ta AS DOUBLE) * (vb - va) END, 4) AS value FROM a JOIN b USING (clip_id, t)""",
    "interval_overlap_weights": f"WITH {SLOTS} SELECT clip_id, out_id, src_id, round(w / sum(w) OVER (PARTITION BY clip_id, out_id), 5) AS weight FROM k",
    "last_use": f"WITH {SLOTS} SELECT i.clip_id, i.src_id, coalesce(max(out_id), -1) AS last_use FROM i LEFT JOIN k ON i.clip_id = k.clip_id AND i.src_id = k.src_id GROUP BY 1, 2",
    "band_match": f"WITH {P} SELECT a.clip_id, a.k, count(*) AS n, max(b.value) AS largest FROM p a JOIN p b ON a.clip_id = b.clip_id AND abs(a.k - b.k) <= 1 AND a.event_type = 'error' AND b.event_type = 'purchase' GROUP BY 1, 2",
    "only_in_test": f"WITH {P} SELECT clip_id, k, value FROM p a WHERE event_type = 'error' AND NOT EXISTS (SELECT 1 FROM p b WHERE b.clip_id = a.clip_id AND abs(a.k - b.k) <= 1 AND b.event_type = 'purchase')",
    "exists_neighbor": f"WITH {P} SELECT clip_id, k, value FROM p a WHERE event_type = 'click' AND EXISTS (SELECT 1 FROM p b WHERE b.clip_id = a.clip_id AND abs(a.k - b.k) <= 3 AND b.event_type = 'purchase' AND b.value > a.value)",
    "densify_pairs": f"WITH {P} SELECT clip_id, k, CASE WHEN event_type = 'purchase' THEN value END AS value, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS weight FROM p",
    "merge_prefer_new": f"""WITH {S}, h AS (SELECT *, t // {60 * MINUTE} AS hour FROM s),
o AS (SELECT clip_id, hour, max(value) AS old FROM h WHERE event_type = 'click' GROUP BY 1, 2), n AS (SELECT clip_id, hour, max(value) AS new FROM h WHERE event_type = 'purchase' GROUP BY 1, 2)
SELECT clip_id, hour, coalesce(new, old) AS value FROM o FULL JOIN n USING (clip_id, hour)""",
    "consecutive_triples": f"""WITH {S}, d AS (SELECT DISTINCT clip_id, t // {1440 * MINUTE} AS day FROM s),
x AS (SELECT *, lead(day) OVER (PARTITION BY clip_id ORDER BY day) AS a, lead(day, 2) OVER (PARTITION BY clip_id ORDER BY day) AS b FROM d)
SELECT clip_id, day, coalesce(b = day + 2, false) AS triple FROM x WHERE a = day + 1""",
    "knn_ratio_test": """WITH d AS (SELECT a.vec_id AS query_id, b.vec_id, list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS d
 FROM embeddings a JOIN embeddings b ON a.label = 0 AND b.label <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS r, lead(d) OVER (PARTITION BY query_id ORDER BY d, vec_id) AS second FROM d)
SELECT query_id, vec_id, round(d, 4) AS distance FROM r WHERE r = 1 AND d < 0.95 * second""",
    "lag_alignment": f"""WITH {P}, q AS (SELECT clip_id, k, value, max(value) OVER (PARTITION BY clip_id ORDER BY k ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS other FROM p),
c AS (SELECT a.clip_id, CAST(b.k - a.k AS INTEGER) AS lag, sum(CAST(round(abs(a.value - b.other) * 100) AS BIGINT)) / count(*) AS cost FROM q a JOIN q b ON a.clip_id = b.clip_id AND b.k - a.k BETWEEN -3 AND 3 GROUP BY 1, 2)
SELECT clip_id, lag, cost FROM (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY cost, lag) AS r FROM c) WHERE r = 1""",
}
QUERIES = {name: globals()[name] for name in SQL}
