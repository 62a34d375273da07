"""Queries of render plans, with their SQL.

Clicks stand for frames and the other events for samples of the camera's orientation; time runs so fast that
samples come about a thousand times a second.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from kinesieve.functions import rotation as R
from kinesieve.operators import rowplan
from kinesieve.plans.geometry import rotation_vector
from kinesieve.plans.sequences import events

#: Microseconds of the tables in a second of the plan; the plan's height and rows.
SECOND, HEIGHT, ROWS, RATE, TAPS = 2.5e13, 1080, 4, 1000.0, 9
CLOCK = rowplan.Clock(offset=0.0005, skew=1e-5, readout=0.004, turn=(0.01, -0.02, 0.03), exposure_scale=1.25)


def sides(spark, sf_dir):
    """(frames, samples): a frame's exposure is k hundredths of 10 ms, its output turns half as far."""
    df = events(spark, sf_dir).withColumn("v", rotation_vector()).withColumn("t", F.col("t") / SECOND)
    half = R.qexp(R.vec(*(F.col(f"v.{c}") / 2 for c in "xyz")))
    frames = df.filter("event_type = 'click'").select("clip_id", F.col("event_id").alias("frame"), "t", (F.col("k") / 10000.0).alias("exposure"), F.when(F.col("value").isNotNull(), half).alias("virtual"))
    samples = df.filter("event_type <> 'click' and value is not null").select("clip_id", "t", F.col("event_id").alias("tie"), R.qexp(F.col("v")).alias("q"))
    return frames, samples


def plan_matrices(spark, sf_dir):
    """The plan's matrix of each row, averaged over its exposure."""
    frames, samples = sides(spark, sf_dir)
    plan = rowplan.row_matrices(frames, samples, "clip_id", HEIGHT, ROWS, CLOCK, RATE, TAPS)
    return plan.select("clip_id", "frame", "row", *((F.round(F.col("m")[i], 5) + 0.0).alias(f"m{i}") for i in range(9)))


def turned(a: str, b: str) -> str:
    """SQL columns of the quaternion product of <a>w.. and <b>w.."""
    return f"""{a}w * {b}w - {a}x * {b}x - {a}y * {b}y - {a}z * {b}z AS w, {a}w * {b}x + {a}x * {b}w + {a}y * {b}z - {a}z * {b}y AS x,
 {a}w * {b}y - {a}x * {b}z + {a}y * {b}w + {a}z * {b}x AS y, {a}w * {b}z + {a}x * {b}y - {a}y * {b}x + {a}z * {b}w AS z"""


def matrix_sql(p: str) -> str:
    w, x, y, z = (f"{p}{c}" for c in "wxyz")
    entries = (
        f"1 - 2 * ({y} * {y} + {z} * {z})", f"2 * ({x} * {y} - {w} * {z})", f"2 * ({x} * {z} + {w} * {y})",
        f"2 * ({x} * {y} + {w} * {z})", f"1 - 2 * ({x} * {x} + {z} * {z})", f"2 * ({y} * {z} - {w} * {x})",
        f"2 * ({x} * {z} - {w} * {y})", f"2 * ({y} * {z} + {w} * {x})", f"1 - 2 * ({x} * {x} + {y} * {y})",
    )
    return ", ".join(f"{e} AS {p}m{i}" for i, e in enumerate(entries))


TURN = CLOCK.turn
SPAN = sum(x * x for x in TURN) ** 0.5
PLAN = f"""WITH s AS (SELECT user_id AS clip_id, event_id, epoch_us(ts) / {SECOND}::DOUBLE AS t, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
 value / 500 AS vx, (event_id % 17) / 20.0::DOUBLE AS vy, (event_id % 29) / 40.0::DOUBLE AS vz FROM events),
a AS (SELECT *, sqrt(vx * vx + vy * vy + vz * vz) AS th FROM s),
q AS (SELECT *, cos(th / 2) AS w, g * vx AS x, g * vy AS y, g * vz AS z, cos(th / 4) AS vw_, h * vx AS vx_, h * vy AS vy_, h * vz AS vz_
 FROM (SELECT *, CASE WHEN th < 1e-9 THEN 0.5 ELSE sin(th / 2) / th END AS g, CASE WHEN th < 1e-9 THEN 0.25 ELSE sin(th / 4) / th END AS h FROM a)),
r AS (SELECT clip_id, t, w, x, y, z FROM q WHERE event_type <> 'click' AND vx IS NOT NULL),
e AS (SELECT clip_id, event_id AS frame, t, vw_, vx_, vy_, vz_, least(greatest(coalesce(k / 10000.0::DOUBLE, 0), 0), 0.05::DOUBLE) AS e FROM q WHERE event_type = 'click'),
d AS (SELECT *, e * least(greatest((e - 0.002::DOUBLE) / 0.0015::DOUBLE, 0), 1) * {CLOCK.exposure_scale}::DOUBLE AS win FROM e),
n AS (SELECT *, CASE WHEN max(win) OVER (PARTITION BY clip_id) * {RATE}::DOUBLE >= 1 THEN CAST({TAPS} * power(2, least(greatest(ceil(log2((ceil(win * {RATE}::DOUBLE) + 1) / {TAPS}.0::DOUBLE)), 0), 4)) AS INTEGER) ELSE 0 END AS n FROM d),
f AS (SELECT *, t + {CLOCK.readout}::DOUBLE * ((j * {(HEIGHT - 1) / (ROWS - 1)}::DOUBLE + 0.5) / {HEIGHT} - 0.5) AS mid FROM (SELECT *, unnest(range({ROWS})) AS j FROM n)),
p AS (SELECT clip_id, frame, j, tap, (mid + win * CASE WHEN tap >= 0 THEN (tap + 0.5) / n - 0.5 ELSE 0 END) * (1 + {CLOCK.skew}::DOUBLE) + {CLOCK.offset}::DOUBLE AS t FROM (SELECT *, unnest(range(-1, n)) AS tap FROM f)),
b AS (SELECT p.*, r.t AS ta, r.w AS aw, r.x AS ax, r.y AS ay, r.z AS az FROM p ASOF LEFT JOIN r ON p.clip_id = r.clip_id AND p.t >= r.t),
c AS (SELECT b.*, r.t AS tb, r.w AS bw, r.x AS bx, r.y AS by_, r.z AS bz FROM b ASOF LEFT JOIN r ON b.clip_id = r.clip_id AND b.t <= r.t),
j AS (SELECT clip_id, frame, j, tap, CASE WHEN ta IS NULL OR tb IS NULL OR ta = tb THEN 0.0 ELSE (t - ta) / (tb - ta) END AS u,
 coalesce(aw, bw) AS aw, coalesce(ax, bx) AS ax, coalesce(ay, by_) AS ay, coalesce(az, bz) AS az, coalesce(bw, aw) AS bw, coalesce(bx, ax) AS bx, coalesce(by_, ay) AS by_, coalesce(bz, az) AS bz FROM c),
o AS (SELECT *, aw * bw + ax * bx + ay * by_ + az * bz AS dot FROM j), h AS (SELECT *, acos(least(abs(dot), 1.0)) AS th, abs(dot) > 1 - 1e-12 AS tiny FROM o),
k AS (SELECT *, CASE WHEN tiny THEN 1 - u ELSE sin((1 - u) * th) / sin(th) END AS wa, CASE WHEN dot < 0 THEN -1.0 ELSE 1.0 END * CASE WHEN tiny THEN u ELSE sin(u * th) / sin(th) END AS wb FROM h),
i AS (SELECT clip_id, frame, j, tap, wa * aw + wb * bw AS iw, wa * ax + wb * bx AS ix, wa * ay + wb * by_ AS iy, wa * az + wb * bz AS iz,
 cos({SPAN / 2}::DOUBLE) AS ew, {TURN[0]}::DOUBLE * sin({SPAN / 2}::DOUBLE) / {SPAN}::DOUBLE AS ex, {TURN[1]}::DOUBLE * sin({SPAN / 2}::DOUBLE) / {SPAN}::DOUBLE AS ey, {TURN[2]}::DOUBLE * sin({SPAN / 2}::DOUBLE) / {SPAN}::DOUBLE AS ez FROM k),
l AS (SELECT clip_id, frame, j, tap, {turned("i", "e")} FROM i),
m AS (SELECT l.*, CASE WHEN l.w * z.w + l.x * z.x + l.y * z.y + l.z * z.z < 0 THEN -1.0 ELSE 1.0 END AS sg, max(l.tap) OVER (PARTITION BY l.frame, l.j) AS last FROM l JOIN l AS z ON l.frame = z.frame AND l.j = z.j AND z.tap = -1),
g AS (SELECT clip_id, frame, j, sum(sg * w) AS w, sum(sg * x) AS x, sum(sg * y) AS y, sum(sg * z) AS z FROM m WHERE tap >= 0 OR last = -1 GROUP BY 1, 2, 3),
u AS (SELECT g.clip_id, g.frame, j, w / len AS cw, x / len AS cx, y / len AS cy, z / len AS cz, e.vw_ AS ow, e.vx_ AS ox, e.vy_ AS oy, e.vz_ AS oz FROM (SELECT *, sqrt(w * w + x * x + y * y + z * z) AS len FROM g) AS g JOIN e ON g.frame = e.frame),
v AS (SELECT clip_id, frame, j, {matrix_sql("c")}, {matrix_sql("o")} FROM u)
SELECT clip_id, frame, CAST(j AS INTEGER) AS "row", {", ".join(f"round(cm{i} * om{k} + cm{i + 3} * om{k + 3} + cm{i + 6} * om{k + 6}, 5) + 0.0 AS m{3 * i + k}" for i in range(3) for k in range(3))} FROM v"""
SQL = {"plan_matrices": PLAN}
QUERIES = {name: globals()[name] for name in SQL}
