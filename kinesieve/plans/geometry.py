"""Rotation and lens queries: element-wise expressions and their as-of combinations."""

from __future__ import annotations


from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinesieve.functions import lens as L
from kinesieve.functions import rotation as R
from kinesieve.operators import joins, seq
from kinesieve.plans.sequences import KEYS, ORDER, O, S, events
from kinesieve.sources.tables import table

LENS = {"fx": 1400.0, "fy": 1400.0, "cx": 1919.5, "cy": 1079.5, "k1": 0.05, "k2": -0.01, "k3": 0.002, "k4": 0.0}
SIXTH = 21_600_000_000


def lens_column():
    return F.struct(*(F.lit(v).alias(k) for k, v in LENS.items()))


def rotation_vector():
    """A rotation from an event's fields: at most about two radians."""
    return R.vec(F.col("value") / 500, F.pmod(F.col("event_id"), F.lit(17)) / 20, F.pmod(F.col("event_id"), F.lit(29)) / 40)


def rotations(spark, sf_dir):
    df = events(spark, sf_dir)
    return df.withColumn("v", rotation_vector()).withColumn("q", R.qexp(F.col("v")))


def quat_algebra(spark, sf_dir):
    """Exponential, product with the row before, and logarithm of the step between the two."""
    df = rotations(spark, sf_dir).withColumn("p", F.lag("q").over(seq.ordered(KEYS, ORDER))).filter("p IS NOT NULL")
    df = df.withColumn("m", R.qmul(R.qconj(F.col("p")), F.col("q"))).withColumn("r", R.qlog(F.col("m")))
    return df.select("clip_id", "event_id", *(F.round(F.col(c), 6).alias(c.replace(".", "_")) for c in ("q.w", "q.x", "m.w", "m.x", "m.y", "m.z", "r.x", "r.y", "r.z")))


def angular_rate(spark, sf_dir):
    """Degrees per day between neighbouring rows."""
    df = rotations(spark, sf_dir)
    w = seq.ordered(KEYS, ORDER)
    df = df.withColumn("p", F.lag("q").over(w)).withColumn("dt", (F.col("t") - F.lag("t").over(w)) / 86_400_000_000).filter("dt > 0")
    df = df.withColumn("r", R.qlog(R.qmul(R.qconj(F.col("p")), F.col("q"))))
    size = F.sqrt(F.col("r.x") * F.col("r.x") + F.col("r.y") * F.col("r.y") + F.col("r.z") * F.col("r.z"))
    return df.select("clip_id", "event_id", F.round(F.degrees(size) / F.col("dt"), 3).alias("rate"))


def quat_matrix(spark, sf_dir):
    """Rotation of the optical axis, by quaternion and by matrix."""
    df = rotations(spark, sf_dir)
    axis = R.vec(F.lit(0.0), F.lit(0.0), F.lit(1.0))
    df = df.withColumn("a", R.qrotate(F.col("q"), axis)).withColumn("m", R.matrix_of(F.col("q")))
    return df.select("clip_id", "event_id", *(F.round(F.col(f"a.{c}"), 6).alias(f"a_{c}") for c in "xyz"), *(F.round(F.col("m")[i], 6).alias(f"m{i}") for i in (2, 5, 8)))


def slerp_at_events(spark, sf_dir):
    """Orientation at every click, between the rows of other types around it."""
    df = rotations(spark, sf_dir)
    left, right = df.filter("event_type = 'click'").select("clip_id", "event_id", "t"), df.filter("event_type <> 'click'").select("clip_id", "event_id", "t", "q")
    both = joins.bracket(left, right, "clip_id", "t", "event_id", ["q"])
    same = F.col("t_1").isNull() | F.col("t_0").isNull() | (F.col("t_1") == F.col("t_0"))
    u = F.when(same, F.lit(0.0)).otherwise((F.col("t") - F.col("t_0")) / F.nullif(F.col("t_1") - F.col("t_0"), F.lit(0)))
    a, b = F.coalesce("q_0", "q_1"), F.coalesce("q_1", "q_0")
    both = both.withColumn("a", a).withColumn("b", b).withColumn("u", u).withColumn("s", R.slerp(F.col("a"), F.col("b"), F.col("u")))
    return both.select("clip_id", "event_id", *(F.round(F.col(f"s.{c}"), 5).alias(c) for c in "wxyz"))


def exposure_average(spark, sf_dir):
    """Sum of the rotation vectors at eight taps around each click, each tap the nearest earlier row."""
    df = rotations(spark, sf_dir)
    left = df.filter("event_type = 'click'").select("clip_id", F.col("event_id").alias("frame"), "t")
    taps = left.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(7)))).withColumn("t", F.col("t") + F.floor(((F.col("i") + 0.5) / 8 - 0.5) * SIXTH)).withColumn("event_id", F.col("frame"))
    found = joins.asof(taps, df.select("clip_id", "event_id", "t", "v"), "clip_id", "t", "event_id", ["v"])
    return found.groupBy("clip_id", "frame").agg(F.count("v_r").alias("n"), *(F.round(F.sum(f"v_r.{c}"), 6).alias(c) for c in "xyz"))


def rays():
    x, y = (F.pmod(F.col("p_partkey"), F.lit(41)) - 20) / 25, (F.col("p_size") - 25) / 40
    return R.vec(x, y, F.lit(1.0))


def lens_project(spark, sf_dir):
    """A ray for each part: its pixel, and the ray that the pixel leads back to."""
    df = table(spark, sf_dir, "part").withColumn("lens", lens_column()).withColumn("ray", rays()).withColumn("pix", L.project(F.col("ray"), F.col("lens")))
    df = df.withColumn("back", L.unproject(F.col("pix"), F.col("lens")))
    return df.select("p_partkey", F.round("pix.u", 3).alias("u"), F.round("pix.v", 3).alias("v"), F.round(F.col("back.x") / F.col("back.z"), 5).alias("x"), F.round(F.col("back.y") / F.col("back.z"), 5).alias("y"))


def row_times(spark, sf_dir):
    """Capture time of five rows of the image for each click."""
    df = events(spark, sf_dir).filter("event_type = 'click'").withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(4))))
    y = F.col("j") * (2160 - 1) / 4
    return df.select("clip_id", "event_id", "j", F.round(L.row_time(F.lit(0.0), y, F.lit(2160), F.lit(0.00972)), 9).alias("offset"))


def pixel_displacement(spark, sf_dir):
    df = rotations(spark, sf_dir)
    small = R.vec(F.col("v.x") / 100, F.col("v.y") / 100, F.col("v.z") / 100)
    df = df.withColumn("s", small)
    return df.select("clip_id", "event_id", F.round(L.pixel_shift(F.col("s"), 1400.0, 3840, 2160), 4).alias("px"), F.round(R.wrap_angle(F.col("value")), 5).alias("wrapped"), F.round(R.smoothstep(F.col("value") / 100), 6).alias("step"), F.round(R.ramp_weight(F.col("value"), 20.0, 80.0), 6).alias("weight"))


def timing_sweep(spark, sf_dir):
    """Shift (in rows, -4..4) with the largest correlation between the rates of two signals."""
    df = events(spark, sf_dir).withColumn("r", F.row_number().over(seq.ordered(KEYS, ORDER)).cast("long"))
    other = df.select("clip_id", (F.col("r") + 2).alias("at"), F.col("value").alias("w"))
    shifted = df.select("clip_id", "r", "value", F.explode(F.sequence(F.lit(-4), F.lit(4))).alias("lag")).withColumn("at", F.col("r") + F.col("lag"))
    scores = shifted.join(other, ["clip_id", "at"]).groupBy("clip_id", "lag").agg(F.round(F.corr("value", "w"), 8).alias("score"), F.count("*").alias("n"))
    best = F.row_number().over(W.partitionBy("clip_id").orderBy(F.desc("score"), "lag"))
    return scores.withColumn("b", best).filter("b = 1").select("clip_id", "lag", "n")


V = f"""{S}, v AS (SELECT *, value / 500 AS vx, (event_id % 17) / 20.0::DOUBLE AS vy, (event_id % 29) / 40.0::DOUBLE AS vz FROM s),
a AS (SELECT *, sqrt(vx * vx + vy * vy + vz * vz) AS th FROM v),
q AS (SELECT *, cos(th / 2) AS w, k * vx AS x, k * vy AS y, k * vz AS z FROM (SELECT *, CASE WHEN th < 1e-8 THEN 0.5 - th * th / 48 ELSE sin(th / 2) / th END AS k FROM a))"""
STEP = f"""{V}, p AS (SELECT *, lag(w) OVER ({O}) AS pw, lag(x) OVER ({O}) AS px, lag(y) OVER ({O}) AS py, lag(z) OVER ({O}) AS pz, t - lag(t) OVER ({O}) AS dt FROM q),
m AS (SELECT *, pw * w + px * x + py * y + pz * z AS mw, pw * x - px * w - py * z + pz * y AS mx, pw * y + px * z - py * w - pz * x AS my, pw * z - px * y + py * x - pz * w AS mz FROM p WHERE pw IS NOT NULL),
l AS (SELECT *, CASE WHEN mw < 0 THEN -1.0 ELSE 1.0 END * CASE WHEN s < 1e-12 THEN 2.0 ELSE 2 * atan2(s, abs(mw)) / s END AS g FROM (SELECT *, sqrt(mx * mx + my * my + mz * mz) AS s FROM m))"""
TD = "(th * (1 + th*th * (0.05::DOUBLE + th*th * (-0.01::DOUBLE + th*th * 0.002::DOUBLE))))"
SQL = {
    "quat_algebra": f"""WITH {STEP} SELECT clip_id, event_id, round(w, 6) AS q_w, round(x, 6) AS q_x, round(mw, 6) AS m_w, round(mx, 6) AS m_x, round(my, 6) AS m_y, round(mz, 6) AS m_z,
round(g * mx, 6) AS r_x, round(g * my, 6) AS r_y, round(g * mz, 6) AS r_z FROM l""",
    "angular_rate": f"WITH {STEP} SELECT clip_id, event_id, round(degrees(abs(g) * s) / (dt / 86400000000.0), 3) AS rate FROM l WHERE dt > 0",
    "quat_matrix": f"""WITH {V} SELECT clip_id, event_id, round(2 * (x * z + w * y), 6) AS a_x, round(2 * (y * z - w * x), 6) AS a_y, round(w * w - x * x - y * y + z * z, 6) AS a_z,
round(2 * (x * z + w * y), 6) AS m2, round(2 * (y * z - w * x), 6) AS m5, round(1 - 2 * (x * x + y * y), 6) AS m8 FROM q""",
    "slerp_at_events": f"""WITH {V}, l AS (SELECT * FROM q WHERE event_type = 'click'), r AS (SELECT * FROM q WHERE event_type <> 'click'),
e AS (SELECT l.clip_id, l.event_id, l.t, r.t AS ta, r.w AS aw, r.x AS ax, r.y AS ay, r.z AS az FROM l ASOF LEFT JOIN r ON l.clip_id = r.clip_id AND l.t >= r.t),
n AS (SELECT l.event_id, r.t AS tb, r.w AS bw, r.x AS bx, r.y AS by_, r.z AS bz FROM l ASOF LEFT JOIN r ON l.clip_id = r.clip_id AND l.t <= r.t),
j AS (SELECT clip_id, event_id, CASE WHEN ta IS NULL OR tb IS NULL OR ta = tb THEN 0.0 ELSE (t - ta) / CAST(tb - ta AS DOUBLE) END AS u,
 coalesce(aw, bw) AS aw, coalesce(ax, bx) AS ax, coalesce(ay, by_) AS ay, coalesce(az, bz) AS az, coalesce(bw, aw) AS bw, coalesce(bx, ax) AS bx, coalesce(by_, ay) AS by_, coalesce(bz, az) AS bz FROM e JOIN n USING (event_id)),
d AS (SELECT *, aw * bw + ax * bx + ay * by_ + az * bz AS dot FROM j), h AS (SELECT *, acos(least(abs(dot), 1.0)) AS th, abs(dot) > 1 - 1e-12 AS tiny FROM d),
k AS (SELECT *, CASE WHEN tiny THEN 1 - u ELSE sin((1 - u) * th) / sin(th) END AS wa, CASE WHEN dot < 0 THEN -1.0 ELSE 1.0 END * CASE WHEN tiny THEN u ELSE sin(u * th) / sin(th) END AS wb FROM h)
SELECT clip_id, event_id, round(wa * aw + wb * bw, 5) AS w, round(wa * ax + wb * bx, 5) AS x, round(wa * ay + wb * by_, 5) AS y, round(wa * az + wb * bz, 5) AS z FROM k""",
    "exposure_average": f"""WITH {V}, f AS (SELECT clip_id, event_id AS frame, t + CAST(floor(((i + 0.5) / 8 - 0.5) * {SIXTH}) AS BIGINT) AS t FROM (SELECT *, unnest(range(8)) AS i FROM q WHERE event_type = 'click'))
SELECT f.clip_id, frame, count(q.vx) AS n, round(sum(vx), 6) AS x, round(sum(vy), 6) AS y, round(sum(vz), 6) AS z FROM f ASOF LEFT JOIN q ON f.clip_id = q.clip_id AND f.t >= q.t GROUP BY 1, 2""",
    "lens_project": f"""WITH r AS (SELECT p_partkey, ((p_partkey % 41) - 20) / 25.0::DOUBLE AS x, (p_size - 25) / 40.0::DOUBLE AS y FROM part),
a AS (SELECT *, sqrt(x * x + y * y) AS r, atan2(sqrt(x * x + y * y), 1.0) AS th FROM r)
SELECT p_partkey, round(1400 * x * CASE WHEN r < 1e-12 THEN 1.0 ELSE {TD} / r END + 1919.5, 3) AS u, round(1400 * y * CASE WHEN r < 1e-12 THEN 1.0 ELSE {TD} / r END + 1079.5, 3) AS v,
round(x, 5) AS x, round(y, 5) AS y FROM a""",
    "row_times": f"WITH {S} SELECT clip_id, event_id, CAST(j AS INTEGER) AS j, round(0.00972::DOUBLE * ((j * 2159 / 4.0::DOUBLE + 0.5) / 2160 - 0.5), 9) AS \"offset\" FROM (SELECT *, unnest(range(5)) AS j FROM s WHERE event_type = 'click')",
    "pixel_displacement": f"""WITH {V} SELECT clip_id, event_id, round(sqrt(1400.0::DOUBLE * 1400 * (power(vx / 100, 2) + power(vy / 100, 2)) + (3840 * 3840 + 2160 * 2160) / 12.0::DOUBLE * power(vz / 100, 2)), 4) AS px,
round(value + pi() - floor((value + pi()) / (2 * pi())) * (2 * pi()) - pi(), 5) AS wrapped,
round(power(least(greatest(value / 100, 0), 1), 2) * (3 - 2 * least(greatest(value / 100, 0), 1)), 6) AS step, round(power(least(greatest((value - 20) / 60, 0), 1), 2), 6) AS weight FROM q""",
    "timing_sweep": f"""WITH {S}, r AS (SELECT clip_id, value, row_number() OVER ({O}) AS r FROM s),
c AS (SELECT a.clip_id, CAST(b.r + 2 - a.r AS INTEGER) AS lag, round(corr(a.value, b.value), 8) AS score, count(*) AS n FROM r a JOIN r b ON a.clip_id = b.clip_id AND b.r + 2 - a.r BETWEEN -4 AND 4 GROUP BY 1, 2)
SELECT clip_id, lag, n FROM (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY score DESC, lag) AS b FROM c) WHERE b = 1""",
}
QUERIES = {name: globals()[name] for name in SQL}
