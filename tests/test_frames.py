import numpy as np
import pytest
from pyspark.sql import functions as F

from kinesieve.functions import lens as L
from kinesieve.functions import matrix as M
from kinesieve.functions import rotation as R
from kinesieve.operators import boards as B

LENS = {"fx": 700.0, "fy": 690.0, "cx": 400.0, "cy": 300.0, "k1": 0.04, "k2": -0.012, "k3": 0.003, "k4": -0.0002}


def lens():
    return F.struct(*(F.lit(v).alias(k) for k, v in LENS.items()))


def cross_matrix(v):
    return np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]])


def exponential(v, terms=40):
    """A rotation matrix as the power series of its skew matrix."""
    out, power = np.eye(3), np.eye(3)
    for k in range(1, terms):
        power = power @ cross_matrix(v) / k
        out = out + power
    return out


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(8)
    some = rng.normal(size=(60, 3))
    some *= (rng.random(60) * 3.1 / np.linalg.norm(some, axis=1))[:, None]
    return np.vstack((some, np.zeros(3), [1e-9, 0, 0], [3.1, 0, 0], [0, -3.1, 0], [0, 0, 3.14]))


def columns(spark, vectors, *out):
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(vectors)], "i int, x double, y double, z double").withColumn("v", F.struct("x", "y", "z"))
    rows = df.select("i", *(c.alias(f"c{k}") for k, c in enumerate(out))).orderBy("i").collect()
    return [[np.array(r[f"c{k}"], float) for r in rows] for k in range(len(out))]


def test_matrices_and_back(spark, vectors):
    v = F.col("v")
    m, skew, q = columns(spark, vectors, M.rodrigues(v), M.skew(v), M.quat_of_matrix(M.rodrigues(v)))
    (back,) = columns(spark, vectors, R.qlog(M.quat_of_matrix(M.rodrigues(v))))
    for i, x in enumerate(vectors):
        assert np.allclose(m[i].reshape(3, 3), exponential(x), atol=1e-9)
        assert np.allclose(skew[i].reshape(3, 3), cross_matrix(x))
        assert q[i][0] >= 0 and np.isclose(np.linalg.norm(q[i]), 1)
        assert np.allclose(back[i], x, atol=1e-7)


def test_right_jacobian(spark, vectors):
    (j,) = columns(spark, vectors, M.right_jacobian_inverse(F.col("v")))
    for x, found in zip(vectors, j):
        if np.linalg.norm(x) > 3:
            continue
        # the vector of exp(x) exp(small) is x plus the jacobian times small
        small = np.array([1e-5, -2e-5, 1.5e-5])
        turned = exponential(x) @ exponential(small)
        assert np.allclose(exponential(x + found.reshape(3, 3) @ small), turned, atol=1e-8)


def test_products(spark, vectors):
    v = F.col("v")
    m = M.rodrigues(v)
    product, turned, homography = columns(spark, vectors, M.matmul(m, M.transpose(M.skew(v))), M.matvec(m, R.vec(F.lit(1.0), F.lit(-2.0), F.lit(0.5))), M.view_change(F.lit(500.0), F.lit(320.0), F.lit(240.0), m))
    k = np.array([[500, 0, 320], [0, 500, 240], [0, 0, 1.0]])
    for i, x in enumerate(vectors):
        r = exponential(x)
        assert np.allclose(product[i].reshape(3, 3), r @ cross_matrix(x).T, atol=1e-9)
        assert np.allclose(turned[i], r @ [1, -2, 0.5])
        assert np.allclose(homography[i].reshape(3, 3), k @ r.T @ np.linalg.inv(k), atol=1e-6)


def test_projection_gradient(spark):
    rng = np.random.default_rng(2)
    rays = np.vstack((rng.normal(size=(40, 3)) * [0.6, 0.6, 0.1] + [0, 0, 1.2], [0, 0, 2.0]))
    step = 1e-6
    moved = [F.struct(*((F.col(c) + (step if c == d else 0.0)).alias(c) for c in "xyz")) for d in "xyz"]
    g, at, *others = columns(spark, rays, L.project_gradient(F.col("v"), lens()), *(R.let(p, lambda r: L.project(r, lens())) for p in (F.col("v"), *moved)))
    for i in range(len(rays)):
        numeric = np.stack([(o[i] - at[i]) / step for o in others], 1)
        assert np.allclose(g[i].reshape(2, 3), numeric, atol=2e-2)


def test_scaled_lens_keeps_pixel_centres(spark):
    rays = [[0.1, 0.2, 1.0], [-0.4, 0.3, 0.9]]
    full, half = columns(spark, rays, R.let(F.col("v"), lambda r: L.project(r, lens())), R.let(F.col("v"), lambda r: L.project(r, L.scaled(lens(), F.lit(0.5)))))
    for a, b in zip(full, half):
        assert np.allclose((a + 0.5) / 2 - 0.5, b)


def test_widest_radius():
    assert L.widest_radius({"k1": 0, "k2": 0, "k3": 0, "k4": 0}, margin=1.0, degrees=80) == pytest.approx(np.radians(80))
    bent = L.widest_radius({"k1": -0.3, "k2": 0, "k3": 0, "k4": 0}, margin=1.0)
    theta = np.sqrt(0.7 / 0.9)  # the slope 1 - 0.9 theta^2 is 0.3 there
    assert bent == pytest.approx(theta * (1 - 0.3 * theta**2), abs=2e-3)


def test_kernels_reproduce_lines(spark):
    fractions = [[f, 0.0, 0.0] for f in (0.0, 0.1, 0.5, 0.93)]
    bilinear, cubic, sinc = columns(spark, fractions, *(L.tap_weights(F.col("x"), k) for k in ("bilinear", "catmullrom", "lanczos3")))
    for i, (f, _, _) in enumerate(fractions):
        assert np.isclose(bilinear[i] @ [0, 1], f) and np.isclose(cubic[i] @ [-1, 0, 1, 2], f)
        assert np.isclose(cubic[i] @ np.square([-1, 0, 1, 2]), f * f)
        assert np.isclose(sinc[i].sum(), 1) and abs(sinc[i] @ np.arange(-2, 4) - f) < 0.03
    with pytest.raises(ValueError):
        L.tap_weights(F.col("x"), "box")


def test_polygons_cut_by_a_square(spark):
    rng = np.random.default_rng(5)
    rows, inside = [], rng.random((40_000, 2))
    for i in range(25):
        c, a, size = rng.random(2), rng.random() * 6.3, 0.1 + rng.random(2)
        turn = np.array([[np.cos(a), -np.sin(a)], [np.sin(a), np.cos(a)]])
        corners = (np.array([[-1, -1], [1, -1], [1, 1], [-1, 1]]) * size / 2) @ turn.T + c
        share = (np.abs((inside - c) @ turn) <= size / 2).all(1).mean()
        rows.append((i, [tuple(map(float, p)) for p in corners], float(share)))
    rows.append((99, [(5.0, 5.0), (6.0, 5.0), (6.0, 6.0)], 0.0))
    df = spark.createDataFrame(rows, "i int, p array<struct<x:double,y:double>>, share double")
    area = B.polygon_area(B.clipped_polygon(F.col("p"), [(-1, 0, 0), (1, 0, 1), (0, -1, 0), (0, 1, 1)]))
    assert all(abs(r.area - r.share) < 0.015 for r in df.select(area.alias("area"), "share").collect())


def test_levels_and_reasons(spark):
    df = spark.createDataFrame([([True, True, False, True],), ([True] * 4,), ([False, True],), ([True, None, True],)], "c array<boolean>")
    assert [r[0] for r in df.select(B.covered_levels(F.col("c"))).collect()] == [2, 4, 0, 1]
    why = B.reasons({"a": F.col("c")[0], "b": F.col("c")[1]})
    assert [r[0] for r in df.select(why).collect()] == [["a", "b"], ["a", "b"], ["b"], ["a"]]
