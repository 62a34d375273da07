"""Camera frames: matrices, horizon, homographies, borders and resampling, with their SQL.

An event stands for a frame: its rotation is that of geometry.rotation_vector().
"""

from __future__ import annotations

from pyspark.sql import functions as F

from kinesieve.functions import lens as L
from kinesieve.functions import matrix as M
from kinesieve.functions import rotation as R
from kinesieve.plans.geometry import LENS, lens_column, rotation_vector
from kinesieve.plans.sequences import S, events
from kinesieve.sources.tables import table

GRID = [0.5, -1.0, 2.0, 0.25, 3.0, -0.75]


def frames(spark, sf_dir):
    df = events(spark, sf_dir).filter("value IS NOT NULL").select("event_id", "value", rotation_vector().alias("v"))
    return df.withColumn("m", M.rodrigues(F.col("v")))  # not inlined: it is computed once per frame


def rounded(digits, **columns):
    return [(F.round(c, digits) + 0.0).alias(k) for k, c in columns.items()]  # never -0.0


def matrix_quaternion(spark, sf_dir):
    """From rotation vector to matrix, quaternion and back."""
    df = frames(spark, sf_dir).withColumn("q", M.quat_of_matrix(F.col("m"))).withColumn("r", R.qlog(F.col("q")))
    return df.select("event_id", *rounded(6, w=F.col("q.w"), x=F.col("q.x"), y=F.col("q.y"), z=F.col("q.z"), rx=F.col("r.x"), ry=F.col("r.y"), rz=F.col("r.z")))


def jacobian_inverse(spark, sf_dir):
    """The change of a rotation vector for a small turn of (1, 2, 3)."""
    df = frames(spark, sf_dir).withColumn("j", M.right_jacobian_inverse(F.col("v")))
    u = M.matvec(F.col("j"), R.vec(F.lit(1.0), F.lit(2.0), F.lit(3.0)))
    return df.withColumn("u", u).select("event_id", *rounded(6, ux=F.col("u.x"), uy=F.col("u.y"), uz=F.col("u.z")))


def horizon_roll(spark, sf_dir):
    """Roll and elevation against gravity, the roll's gradient, and its excess over 20 degrees."""
    df = frames(spark, sf_dir).withColumn("a", M.horizon_angles(F.col("m"), R.vec(F.lit(0.0), F.lit(0.0), F.lit(1.0)))).withColumn("d", M.roll_gradient(F.col("a.g")))
    roll = F.degrees("a.roll")
    return df.select("event_id", *rounded(4, roll=roll, elevation=F.degrees("a.elevation"), excess=F.greatest(F.abs(roll) - 20, F.lit(0.0)), dx=F.col("d.x"), dy=F.col("d.y")))


def view_homography(spark, sf_dir):
    """Where the homography of a rotation takes the pixel (100, 200) of a 1920 x 1080 picture."""
    df = frames(spark, sf_dir).withColumn("h", M.view_change(F.lit(1000.0), F.lit(959.5), F.lit(539.5), F.col("m")))
    df = df.withColumn("p", M.matvec(F.col("h"), R.vec(F.lit(100.0), F.lit(200.0), F.lit(1.0)))).filter("p.z > 0.1")
    return df.select("event_id", *rounded(3, u=F.col("p.x") / F.col("p.z"), v=F.col("p.y") / F.col("p.z")))


def crop_margin(spark, sf_dir):
    """Per frame the least distance of its output border inside the source, and whether it is 5 px."""
    df = frames(spark, sf_dir).withColumn("lens", lens_column())
    points = df.withColumn("p", F.explode(L.border_points(F.lit(1920), F.lit(1080))))
    ray = M.matvec(F.col("m"), R.vec((F.col("p.u") - 959.5) / 1500, (F.col("p.v") - 539.5) / 1500, F.lit(1.0)))
    points = points.withColumn("ray", R.let(ray, lambda r: r)).withColumn("s", R.let(F.col("ray"), lambda r: L.project(r, F.col("lens"))))
    inside = L.inside_distance(F.col("s"), F.col("ray.z"), F.lit(3840), F.lit(2160))
    out = points.groupBy("event_id").agg(F.min(inside).alias("margin"), F.count_if(L.in_view(F.col("ray"), 60.0)).alias("in_view"))
    return out.select("event_id", F.round("margin", 3).alias("margin"), (F.col("margin") >= 5).alias("ok"), "in_view")


def lens_gradient(spark, sf_dir):
    """Gradient of the projection of a part's ray by a lens of half the size."""
    df = table(spark, sf_dir, "part").withColumn("ray", R.vec(F.col("p_size") / 40 - 0.6, F.pmod(F.col("p_partkey"), F.lit(41)) / 40 - 0.5, F.lit(1.0)))
    df = df.withColumn("ray", R.let(F.col("ray"), lambda r: r)).withColumn("lens", R.let(L.scaled(lens_column(), F.lit(0.5)), lambda x: x)).withColumn("g", L.project_gradient(F.col("ray"), F.col("lens"))).withColumn("p", R.let(F.col("ray"), lambda r: L.project(r, F.col("lens"))))
    return df.select("p_partkey", *rounded(3, u=F.col("p.u"), v=F.col("p.v"), **{f"g{i}": F.col("g")[i] for i in range(6)}))


def kernel_weights(spark, sf_dir):
    """Weights of the taps around a part's fraction, by kernel."""
    f = F.pmod(F.col("p_partkey"), F.lit(97)) / 97
    parts = [table(spark, sf_dir, "part").select("p_partkey", F.lit(k).alias("kernel"), F.posexplode(L.tap_weights(f, k)).alias("tap", "weight")) for k in KERNELS]
    df = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return df.select("p_partkey", "kernel", "tap", (F.round("weight", 6) + 0.0).alias("weight"))


KERNELS = ("bilinear", "catmullrom", "lanczos3")


def grid_lookup(spark, sf_dir):
    """A 3 x 2 grid over a 1920 x 1080 picture, at places that a part's keys make, softly limited."""
    x, y = F.pmod(F.col("p_partkey") * 37, F.lit(1920)).cast("double"), F.pmod(F.col("p_partkey") * 53, F.lit(1080)).cast("double")
    df = table(spark, sf_dir, "part").select("p_partkey", x.alias("x"), y.alias("y"))
    df = df.withColumn("d", L.grid_value(F.array(*map(F.lit, GRID)), 3, 2, F.col("x"), F.col("y"), F.lit(1920), F.lit(1080)))
    terms = L.polynomial_terms(F.col("x") / 1920, F.col("y") / 1080, 2)
    return df.select("p_partkey", *rounded(5, d=F.col("d"), limited=F.col("d") * L.soft_limit(F.abs("d"), 1.0), terms=F.aggregate(terms, F.lit(0.0), lambda a, b: a + b)))


def frame_scalars(spark, sf_dir):
    """Per frame: timing offset by exposure, displacement in pixels, rows and size of the output."""
    df = frames(spark, sf_dir).withColumn("exposure", F.when(F.pmod("event_id", F.lit(7)) != 0, F.pmod("event_id", F.lit(23)) / 1000))
    k = L.axis_factors(F.lit(810.0))
    px = F.sqrt(F.pow(F.col("v.x") * F.col("k.x"), 2) + F.pow(F.col("v.y") * F.col("k.y"), 2) + F.pow(F.col("v.z") * F.col("k.z"), 2))
    rows = L.row_positions(F.lit(1080.0), F.pmod("event_id", F.lit(5)).cast("int") + 1)
    bytes_ = F.when(F.pmod("event_id", F.lit(2)) == 0, 3.55 * 1920 * 1080 * 60).otherwise(50e6) / 8 * F.col("event_id") / 60
    return df.withColumn("k", k).select(
        "event_id",
        *rounded(6, timing=L.exposure_offset(F.col("exposure"), 0.009, 0.004, 0.004, 1 / 61), readout=F.coalesce(F.col("exposure"), F.lit(0.016))),
        *rounded(3, px=px, last_row=F.element_at(rows, -1), row_sum=F.aggregate(rows, F.lit(0.0), lambda a, b: a + b), bytes=bytes_, focal=L.focal_of_view(F.lit(90.0) + F.col("value") / 100, F.lit(1920)), view=L.view_of_focal(F.lit(900.0) + F.col("value"), F.lit(1920))),
    )


def robust_weights(spark, sf_dir):
    """Weights of residuals and of distances in time, and a quaternion brought back to length one."""
    df = frames(spark, sf_dir).withColumn("e", R.qexp(F.col("v")))
    k = 1 + F.pmod("event_id", F.lit(9)) / 3
    df = df.withColumn("q", R.let(R.quat(*(F.col(f"e.{c}") * k for c in "wxyz")), R.qnormalize))
    return df.select(
        "event_id",
        *rounded(6, w=F.col("q.w"), x=F.col("q.x"), y=F.col("q.y"), z=F.col("q.z"), cauchy=R.cauchy_weight(F.col("value") - 50, 20.0), near=R.temporal_weight(F.pmod("event_id", F.lit(41)) - 20, 8.0)),
    )


V = f"""{S}, f AS (SELECT event_id, value, value / 500 AS vx, (event_id % 17) / 20.0 AS vy, (event_id % 29) / 40.0 AS vz FROM s WHERE value IS NOT NULL),
a AS (SELECT *, sqrt(vx * vx + vy * vy + vz * vz) AS t FROM f),
q AS (SELECT *, cos(t / 2) AS w, CASE WHEN t > 0 THEN sin(t / 2) / t ELSE 0.5 END AS k FROM a),
r AS (SELECT event_id, value, vx, vy, vz, t, w, k * vx AS x, k * vy AS y, k * vz AS z FROM q),
m AS (SELECT *, 1 - 2 * (y * y + z * z) AS m0, 2 * (x * y - w * z) AS m1, 2 * (x * z + w * y) AS m2, 2 * (x * y + w * z) AS m3, 1 - 2 * (x * x + z * z) AS m4,
 2 * (y * z - w * x) AS m5, 2 * (x * z - w * y) AS m6, 2 * (y * z + w * x) AS m7, 1 - 2 * (x * x + y * y) AS m8 FROM r)"""


def lens_sql(x: str, y: str, z: str) -> str:
    """Common columns of a projection: r, theta, its square s, the distorted angle d and the slope e."""
    poly = f"1 + s * ({LENS['k1']} + s * ({LENS['k2']} + s * ({LENS['k3']} + s * {LENS['k4']})))"
    steep = f"1 + s * ({3 * LENS['k1']} + s * ({5 * LENS['k2']} + s * ({7 * LENS['k3']} + s * {9 * LENS['k4']})))"
    return f"sqrt({x} * {x} + {y} * {y}) AS r, atan2(sqrt({x} * {x} + {y} * {y}), {z}) AS th, th * th AS s, th * ({poly}) AS d, {steep} AS e"


SQL = {
    "matrix_quaternion": f"""WITH {V}, o AS (SELECT *, CASE WHEN w < 0 THEN -1 ELSE 1 END AS sg FROM m)
SELECT event_id, round(sg * w, 6) AS w, round(sg * x, 6) AS x, round(sg * y, 6) AS y, round(sg * z, 6) AS z,
 round(vx, 6) AS rx, round(vy, 6) AS ry, round(vz, 6) AS rz FROM o""",
    "jacobian_inverse": f"""WITH {V}, c AS (SELECT *, CASE WHEN t > 1e-4 THEN 1 / (t * t) - (1 + cos(t)) / (2 * t * sin(t)) ELSE 1 / 12.0 END AS c, vx * 1 + vy * 2 + vz * 3 AS dot FROM m)
SELECT event_id, round(1 + (vy * 3 - vz * 2) / 2 + c * (vx * dot - 1 * t * t), 6) AS ux, round(2 + (vz * 1 - vx * 3) / 2 + c * (vy * dot - 2 * t * t), 6) AS uy,
 round(3 + (vx * 2 - vy * 1) / 2 + c * (vz * dot - 3 * t * t), 6) AS uz FROM c""",
    "horizon_roll": f"""WITH {V}, h AS (SELECT *, degrees(atan2(m6, m7)) AS roll, degrees(asin(greatest(least(m8, 1), -1))) AS elevation, greatest(m6 * m6 + m7 * m7, 0.04) AS n2 FROM m)
SELECT event_id, round(roll, 4) + 0.0 AS roll, round(elevation, 4) AS elevation, round(greatest(abs(roll) - 20, 0), 4) AS excess, round(-m8 * m6 / n2, 4) + 0.0 AS dx, round(-m8 * m7 / n2, 4) + 0.0 AS dy FROM h""",
    "view_homography": f"""WITH {V}, p AS (SELECT *, (100 - 959.5) / 1000 AS a, (200 - 539.5) / 1000 AS b FROM m),
o AS (SELECT event_id, m0 * a + m3 * b + m6 AS px, m1 * a + m4 * b + m7 AS py, m2 * a + m5 * b + m8 AS pz FROM p)
SELECT event_id, round(1000 * px / pz + 959.5, 3) AS u, round(1000 * py / pz + 539.5, 3) AS v FROM o WHERE pz > 0.1""",
    "crop_margin": f"""WITH {V}, b(u, v) AS (VALUES (0.0, 0.0), (1919.0, 0.0), (1919.0, 1079.0), (0.0, 1079.0),
 (479.75, 0.0), (959.5, 0.0), (1439.25, 0.0), (479.75, 1079.0), (959.5, 1079.0), (1439.25, 1079.0), (0.0, 269.75), (0.0, 539.5), (0.0, 809.25), (1919.0, 269.75), (1919.0, 539.5), (1919.0, 809.25)),
i AS (SELECT *, CAST((u - 959.5) / 1500 AS DOUBLE) AS a, CAST((v - 539.5) / 1500 AS DOUBLE) AS c FROM m, b),
j AS (SELECT event_id, m0 * a + m1 * c + m2 AS px, m3 * a + m4 * c + m5 AS py, m6 * a + m7 * c + m8 AS pz FROM i),
o AS (SELECT *, {lens_sql("px", "py", "pz")} FROM j),
l AS (SELECT *, CASE WHEN r < 1e-12 THEN 1 ELSE d / r END AS k FROM o),
g AS (SELECT event_id, th, pz, {LENS["fx"]} * px * k + {LENS["cx"]} AS su, {LENS["fy"]} * py * k + {LENS["cy"]} AS sv FROM l),
n AS (SELECT event_id, min(CASE WHEN pz > 0 THEN least(su + 0.5, 3839.5 - su, sv + 0.5, 2159.5 - sv) ELSE -1e30 END) AS margin, count(*) FILTER (WHERE th < radians(60)) AS in_view FROM g GROUP BY 1)
SELECT event_id, round(margin, 3) AS margin, margin >= 5 AS ok, in_view FROM n""",
    "lens_gradient": f"""WITH p AS (SELECT p_partkey, p_size / 40.0 - 0.6 AS x, (p_partkey % 41) / 40.0 - 0.5 AS y FROM part), f AS (SELECT p_partkey, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM p),
o AS (SELECT *, {lens_sql("x", "y", "1")} FROM f),
g AS (SELECT *, CASE WHEN r > 1e-9 THEN d / r ELSE 1 END AS k, CASE WHEN r > 1e-9 THEN e / (r * r + 1) ELSE 1 END AS q, CASE WHEN r > 1e-9 THEN x / r ELSE 1 END AS cx, CASE WHEN r > 1e-9 THEN y / r ELSE 0 END AS cy FROM o)
SELECT p_partkey, round({LENS["fx"] / 2} * x * k + {(LENS["cx"] + 0.5) / 2 - 0.5}, 3) AS u, round({LENS["fy"] / 2} * y * k + {(LENS["cy"] + 0.5) / 2 - 0.5}, 3) AS v,
 round({LENS["fx"] / 2} * (q * cx * cx + k * cy * cy), 3) AS g0, round({LENS["fx"] / 2} * (q - k) * cx * cy, 3) + 0.0 AS g1, round({-LENS["fx"] / 2} * q * x, 3) + 0.0 AS g2,
 round({LENS["fy"] / 2} * (q - k) * cx * cy, 3) + 0.0 AS g3, round({LENS["fy"] / 2} * (q * cy * cy + k * cx * cx), 3) AS g4, round({-LENS["fy"] / 2} * q * y, 3) + 0.0 AS g5 FROM g""",
    "robust_weights": f"""WITH {V} SELECT event_id, round(w, 6) AS w, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(z, 6) + 0.0 AS z,
 round(1 / (1 + power((value - 50) / 20, 2)), 6) AS cauchy, round(1 / (1 + abs(event_id % 41 - 20) / 8.0::DOUBLE), 6) AS near FROM m""",
    "kernel_weights": """WITH f AS (SELECT p_partkey, (p_partkey % 97) / 97.0::DOUBLE AS f FROM part),
w AS (SELECT p_partkey, 'bilinear' AS kernel, [1 - f, f] AS w FROM f UNION ALL
 SELECT p_partkey, 'catmullrom', [-0.5 * f ** 3 + f * f - 0.5 * f, 1.5 * f ** 3 - 2.5 * f * f + 1, -1.5 * f ** 3 + 2 * f * f + 0.5 * f, 0.5 * f ** 3 - 0.5 * f * f] FROM f UNION ALL
 SELECT p_partkey, 'lanczos3', list_transform(l, lambda x: x / list_sum(l)) FROM (SELECT p_partkey, list_transform([-2, -1, 0, 1, 2, 3],
  lambda i: CASE WHEN abs(f - i) < 1e-10 THEN 1 ELSE sin(pi() * (f - i)) / (pi() * (f - i)) * sin(pi() * (f - i) / 3) / (pi() * (f - i) / 3) END) AS l FROM f))
SELECT p_partkey, kernel, CAST(generate_subscripts(w, 1) - 1 AS INTEGER) AS tap, round(unnest(w), 6) + 0.0 AS weight FROM w""",
    "grid_lookup": f"""WITH p AS (SELECT p_partkey, CAST(p_partkey * 37 % 1920 AS DOUBLE) AS x, CAST(p_partkey * 53 % 1080 AS DOUBLE) AS y, CAST({GRID} AS DOUBLE[]) AS g FROM part),
c AS (SELECT *, least(greatest((x + 0.5) * 3 / 1920 - 0.5, 0), 2) AS gx, least(greatest((y + 0.5) * 2 / 1080 - 0.5, 0), 1) AS gy FROM p),
i AS (SELECT *, CAST(least(floor(gx), 1) AS INTEGER) AS x0, gx - least(floor(gx), 1) AS u, gy AS v FROM c),
d AS (SELECT p_partkey, x / 1920 AS a, y / 1080 AS b, (g[x0 + 1] * (1 - u) + g[x0 + 2] * u) * (1 - v) + (g[x0 + 4] * (1 - u) + g[x0 + 5] * u) * v AS d FROM i)
SELECT p_partkey, round(d, 5) AS d, round(sign(d) * tanh(abs(d)), 5) AS limited, round(1 + a + b + a * a + a * b + b * b, 5) AS terms FROM d""",
    "frame_scalars": f"""WITH {V}, e AS (SELECT *, CASE WHEN event_id % 7 <> 0 THEN (event_id % 23) / 1000.0::DOUBLE END AS exposure, CAST(event_id % 5 AS INTEGER) + 1 AS n FROM m),
o AS (SELECT *, CASE WHEN exposure > 0 THEN exposure ELSE 1 / 61.0::DOUBLE END AS known FROM e)
SELECT event_id, round(0.009 + 0.004 * least(greatest((1 / 61.0::DOUBLE - known) / (1 / 61.0::DOUBLE - 0.004), 0), 1), 6) AS timing, round(coalesce(exposure, 0.016), 6) AS readout,
 round(sqrt(power(810 * vx, 2) + power(810 * vy, 2) + power(0.785 * 810 * vz, 2)), 3) AS px, round(CASE WHEN n = 1 THEN 0 ELSE 1079.0::DOUBLE END, 3) AS last_row,
 round(CASE WHEN n = 1 THEN 0 ELSE 1079.0::DOUBLE * n / 2 END, 3) AS row_sum, round(CASE WHEN event_id % 2 = 0 THEN 3.55::DOUBLE * 1920 * 1080 * 60 ELSE 50e6 END / 8 * event_id / 60, 3) AS bytes,
 round(960 / tan(radians(90 + value / 100) / 2), 3) AS focal, round(degrees(2 * atan(960 / (900 + value))), 3) AS view FROM o""",
}
QUERIES = {name: globals()[name] for name in SQL}
