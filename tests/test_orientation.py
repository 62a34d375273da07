"""Filters and rates of orientations, and render models, against plain NumPy."""

import time

import numpy as np
from pyspark.sql import functions as F

from kinesieve.functions.lens import unproject, unprojected
from kinesieve.functions.rotation import qexp, vec
from kinesieve.operators import orientation, rendering, solve
from kinesieve.plans import rotations
from tests.conftest import SMALL
from tests.test_rotations import matrix


def test_slow_turns_stay_and_fast_ones_go():
    t = np.arange(1200) / 60
    slow = np.stack([0.4 * np.sin(0.5 * t), 2.5 * t / 20, 0 * t], axis=1)
    fast = np.stack([0 * t, 0 * t, 0.02 * np.sin(2 * np.pi * 8 * t)], axis=1)
    calm = orientation.turn_of(slow)
    q = orientation.product(calm, orientation.turn_of(fast))
    out, off = orientation.calmed(q, 2.0, 60.0)
    left = orientation.vector_of(orientation.product(orientation.inverse(calm), out))
    assert np.abs(left[100:-100]).max() < 2e-3 and np.abs(off[100:-100] - fast[100:-100]).max() < 3e-3
    assert np.allclose(orientation.product(out, orientation.turn_of(off)), q, atol=1e-12)
    same, none = orientation.calmed(q[:10], 2.0, 60.0)
    assert np.array_equal(same, q[:10]) and not none.any()


def test_windows_and_missing_rows(spark):
    t = np.arange(2000) / 60
    q = orientation.turn_of(np.stack([0.3 * np.sin(t), 0.2 * np.cos(0.7 * t), 0.01 * np.sin(30 * t)], axis=1))
    rows = [(1, i * 16_667, i, *(map(float, x) if i % 301 else (None, 0.0, 0.0, 0.0))) for i, x in enumerate(q)]
    df = spark.createDataFrame(rows, "clip long, t long, frame long, w double, x double, y double, z double").repartition(3)
    got = orientation.lowpass_orientation(df, ["clip"], ["t", "frame"], ["w", "x", "y", "z"], 2.0, 60.0, core=600, overlap=400).orderBy("frame").collect()
    filled = np.stack([solve.filled(np.where(np.arange(2000) % 301, v, np.nan)) for v in q.T], axis=1)
    want, _ = orientation.calmed(filled / np.linalg.norm(filled, axis=1)[:, None], 2.0, 60.0)
    for i, r in enumerate(got):
        assert (r.q_w is None) == (i % 301 == 0)
        assert r.q_w is None or not 60 < i < 1940 or np.allclose([r.q_w, r.q_x, r.q_y, r.q_z], want[i], atol=2e-4)


def test_rates(spark):
    """A steady turn has one rate everywhere; outside of the samples there is none."""
    spin = np.array([0.3, -0.2, 0.5])
    rows = [(1, float(t), tuple(map(float, orientation.turn_of(spin[None] * t)[0]))) for t in np.arange(0, 10, 0.25)]
    samples = spark.createDataFrame(rows, "clip int, t double, q struct<w:double,x:double,y:double,z:double>")
    frames = spark.createDataFrame([(1, 0.9, "a"), (1, 5.05, "b"), (1, 9.9, "c"), (2, 1.0, "d"), (1, 5.05, "b")], "clip int, t double, name string")
    got = [(r.name, r.rate and [r.rate.x, r.rate.y, r.rate.z]) for r in orientation.rate_at(frames, samples, ["clip"], 0.2).collect()]
    assert sorted(x for x, _ in got) == ["a", "b", "b", "c", "d"]
    for name, rate in got:
        assert (rate is None) == (name in "cd") and (rate is None or np.allclose(rate, spin, atol=1e-9))


LENS = dict(fx=800.0, fy=800.0, cx=959.5, cy=539.5, k1=0.03, k2=-0.004, k3=0.0, k4=0.0)


def test_render_models_are_found_and_inverted(spark):
    rng, rows = np.random.default_rng(11), []
    turn, spin, focal = np.array([0.02, -0.05, 0.3]), np.array([0.004, -0.01, 0.006]), 1030.0
    for i in range(400):
        ray = np.array([rng.uniform(-0.7, 0.7), rng.uniform(-0.4, 0.4), 1.0])
        r = np.hypot(*ray[:2])
        a = np.arctan2(r, 1.0)
        d = a * (1 + a**2 * (LENS["k1"] + a**2 * LENS["k2"]))
        u, v = LENS["fx"] * ray[0] / r * d + LENS["cx"], LENS["fy"] * ray[1] / r * d + LENS["cy"]
        ray = ray / np.linalg.norm(ray)
        tau = (v + 0.5) / 1080 - 0.5
        s = matrix(turn) @ (ray + tau * np.cross(spin, ray))
        p = focal * s[:2] / s[2] + (959.5, 539.5) + rng.normal(0, 0.05, 2) + (40 if i % 12 == 0 else 0)
        rows.append((1, (float(u), float(v)), tuple(map(float, p))))
    point = "struct<u:double,v:double>"
    lens = F.struct(*[F.lit(v).alias(k) for k, v in LENS.items()])
    df = spark.createDataFrame([*rows, (1, None, (1.0, 1.0))], f"clip int, source {point}, render {point}")
    m = rendering.fit_render(df, ["clip"], lens, 1080.0, (959.5, 539.5), 1000.0, rounds=9).first()
    q = np.array([m.q.w, m.q.x, m.q.y, m.q.z])
    assert np.allclose(orientation.vector_of(q[None])[0], turn, atol=2e-4) and abs(m.focal - focal) < 0.5 and m.n == 400
    assert np.allclose([m.spin.x, m.spin.y, m.spin.z], spin, atol=1e-3)
    true = qexp(vec(*[F.lit(float(x)) for x in turn]))
    way = vec(*[F.lit(float(x)) for x in spin])
    back = rendering.source_of(F.col("render"), lens, true, way, F.lit(focal), (959.5, 539.5), 1080.0)
    good = [i for i in range(400) if i % 12]
    found = df.filter("source is not null").select("source", back.alias("b")).collect()
    assert max(abs(found[i].b.u - found[i].source.u) + abs(found[i].b.v - found[i].source.v) for i in good) < 0.6


def test_render_query_ends(spark):
    """At this size the fits gave no result in 130 s when each row's expressions were not compiled."""
    begin = time.time()
    rows = rotations.fitted_render(spark, SMALL).collect()
    assert len(rows) == 6 and time.time() - begin < 100
    assert all(r.n > 9000 and abs(r.q_w**2 + r.q_x**2 + r.q_y**2 + r.q_z**2 - 1) < 1e-3 for r in rows)


def test_many_pixels_at_once(spark):
    rows = [(float(u), float(v)) for u in range(0, 1920, 320) for v in range(0, 1080, 180)] + [(959.5, 539.5), (None, 1.0)]
    lens = F.struct(*[F.lit(v).alias(k) for k, v in LENS.items()])
    df = spark.createDataFrame(rows, "u double, v double")
    fast = F.pandas_udf(unprojected, "x double, y double, z double")("u", "v", *[lens[k] for k in ("fx", "fy", "cx", "cy", "k1", "k2", "k3", "k4")])
    for r in df.select(unproject(F.struct("u", "v"), lens).alias("a"), fast.alias("b")).collect():
        b, a = (np.array([v.x, v.y, v.z], float) for v in (r.b, r.a))
        assert np.allclose(b, a, atol=1e-12, equal_nan=True)
