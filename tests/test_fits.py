"""Grouped and shared fits against dense ones, and timing against offsets put in."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from kinesieve.operators import fits, timing
from kinesieve.operators.fits import Unknown
from kinesieve.plans import calibration
from tests.conftest import SMALL, TINY


def dense(residual, x, c, rounds=60, held=None):
    """Reweighted Gauss-Newton over everything at once."""
    x = np.array(x, float)
    held = np.zeros(len(x)) if held is None else held
    for _ in range(rounds):
        r = residual(x)
        j = np.stack([(residual(x + 1e-6 * e) - r) / 1e-6 for e in np.eye(len(x))], axis=1)
        w = 1 / (1 + (r / c) ** 2)
        x = x - np.linalg.solve(j.T @ (w[:, None] * j) + np.diag(held) + 1e-12 * np.eye(len(x)), j.T @ (w * r) + held * x)
    return x


def curve_rows(seed, groups, n):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        x = rng.uniform(0, 3, n)
        y = (1 + g) * np.exp(-0.4 * x) + 0.1 * g + rng.normal(0, 0.01, n)
        y[:: 9] += 5
        rows += [(g, float(a), float(b)) for a, b in zip(x, y)]
    return rows


def test_group_fits(spark):
    rows = curve_rows(1, 4, 120)
    df = spark.createDataFrame([*rows, (0, None, 1.0), (1, float("nan"), 2.0), (9, None, None)], "clip long, x double, y double")
    model = lambda v: [F.col("y") - v[0] * F.exp(-v[1] * F.col("x")) - v[2]]
    unknowns = [Unknown("size", 1.0), Unknown("decay", 0.2), Unknown("base", 0.0)]
    got = {r.clip: r for r in fits.fit_groups(df, ["clip"], model, unknowns, 0.05, 15).collect()}
    assert got[9].n == 0 and got[9].best == [1.0, 0.2, 0.0]
    for g in range(4):
        x, y = np.array([r[1:] for r in rows if r[0] == g]).T
        want = dense(lambda v: y - v[0] * np.exp(-v[1] * x) - v[2], got[g].best, 0.05)
        assert got[g].n == 120 and np.allclose(got[g].best, want, atol=1e-3) and abs(want[1] - 0.4) < 0.1


def test_shared_fit(spark):
    """Eliminating the groups' own unknowns gives what one dense system gives."""
    rng = np.random.default_rng(4)
    rows = []
    for g in range(6):
        q, d = rng.uniform(1, 50, 80), rng.uniform(0, 0.1, 80)
        y = 3 * g + (1 + 0.2 * g) * q * (1 - 0.004 * q + 0.5 * d) + rng.normal(0, 0.2, 80)
        y[::11] += 40
        rows += [(g, float(a), float(b) * 1000, float(c)) for a, b, c in zip(q, y, d)]
    df = spark.createDataFrame(rows, "l_suppkey long, l_quantity double, l_extendedprice double, l_discount double")
    shared, own = fits.fit_shared(df, ["l_suppkey"], calibration.price_model, calibration.SHARED, calibration.OWN, 1.0, 15)
    a = np.array(rows)
    g, q, y, d = a[:, 0].astype(int), a[:, 1], a[:, 2] / 1000, a[:, 3]
    got = {r.l_suppkey: r.own for r in own.collect()}
    start = [*shared, *[x for i in range(6) for x in got[i]]]
    want = dense(lambda v: y - v[2 + 2 * g] - v[3 + 2 * g] * q * (1 + v[0] * q + v[1] * d), start, 1.0, held=np.array([0, 4.0] + [0] * 12))
    assert np.allclose(start, want, atol=2e-3) and abs(shared[0] + 0.004) < 5e-4


def test_shared_fit_without_rows(spark):
    df = spark.createDataFrame([(1, None, None, None)], "l_suppkey long, l_quantity double, l_extendedprice double, l_discount double")
    shared, own = fits.fit_shared(df, ["l_suppkey"], calibration.price_model, calibration.SHARED, calibration.OWN, 1.0, 2)
    assert list(shared) == [0.0, 0.0] and [tuple(r) for r in own.collect()] == [(1, [0.0, 1.0], 0)]


def path(t):
    return 40 * np.sin(2 * np.pi * 1.3 * t) + 9 * np.sin(2 * np.pi * 7.1 * t + 1) + 2 * np.sin(2 * np.pi * 17 * t + 2)


def tracked(clip, offset, gain=0.0, readout=0.0, seed=1, seconds=6):
    """Sensor at 1,000 Hz, tracks of a second at 60 Hz, read `offset` ms late; positions in pixels."""
    rng = np.random.default_rng(seed)
    t = np.arange(0, seconds * 1000) / 1.0
    samples = [(clip, float(a), float(b)) for a, b in zip(t, path(t / 1000))]
    seen = []
    for track in range(seconds * 4):
        at = 60 + track * 230 + np.arange(60) * 1000 / 60
        at = at[at < seconds * 1000 - 60]
        row = rng.uniform(-0.5, 0.5)
        y = (1 + gain) * path((at + offset + readout * row) / 1000) + rng.normal(0, 0.05, len(at))
        y[5::17] += 8
        seen += [(clip, str(track), float(a), float(b), float(row), 0.0) for a, b in zip(at, y)]
    return seen, samples


@pytest.fixture(scope="module")
def timed(spark):
    cases = {1: (0.8, 0.0, 0.0), 2: (-1.0, 0.02, 0.0), 3: (0.0, 0.0, 0.0)}
    seen, samples = [], []
    for clip, case in cases.items():
        s, m = tracked(clip, *case, seed=clip)
        seen, samples = seen + s, samples + m
    seen += [(4, "a", 100.0, 1.0, None, None), (4, "a", None, 1.0, 0.0, 0.0), (1, "0", 70.0, None, 0.0, 0.0)]
    obs = spark.createDataFrame(seen, "clip long, track string, t double, y double, row double, exposure double")
    sensor = spark.createDataFrame(samples, "clip long, t double, v double")
    return {r.clip: r for r in timing.fit_timing(obs, sensor, ["clip"], timing.Timing(reach=4.0, loss=0.3, block=1000.0), 8.0).collect()}


def test_offsets_are_recovered(timed):
    assert abs(timed[1].offset - 0.8) < 0.05 and timed[1].accepted and timed[1].sigma < 0.05
    assert abs(timed[2].offset + 1.0) < 0.05 and abs(timed[2].gain - 0.02) < 5e-3 and timed[2].accepted


def test_right_times_are_left_alone(timed):
    assert abs(timed[3].offset) < 0.05 and not timed[3].accepted
    assert 4 not in timed or not timed[4].accepted


def test_samples_near_an_observation(spark):
    obs = spark.createDataFrame([(1, "a", 5.0), (1, "a", 50.0)], "clip long, track string, t double")
    sensor = spark.createDataFrame([(1, float(i), float(i * i)) for i in range(0, 12)] + [(2, 5.0, 0.0), (1, 6.5, None)], "clip long, t double, v double")
    got = {r.t: [s.t for s in r.near] for r in timing.with_samples(obs, sensor, ["clip"], 1.5, 4.0).collect()}
    assert got == {5.0: [3.0, 4.0, 5.0, 6.0, 7.0]}
    read = timing.with_samples(obs, sensor, ["clip"], 1.5, 4.0).select(timing.read_at(F.col("near"), F.col("t") + 0.5).alias("v")).first()
    assert read.v == 30.5


def seen_and_samples(spark, seed=3):
    """Two clips with gaps, two samples at one time, and observations of which some have no sample near."""
    rng = np.random.default_rng(seed)
    at = [(clip, float(t)) for clip in (1, 2) for t in np.concatenate([np.sort(rng.uniform(0, 60, 150)), rng.uniform(200, 230, 40)])]
    sensor = [(clip, t, float(rng.normal())) for clip, t in at] + [(1, at[0][1], 5.0), (1, None, 1.0), (2, 3.0, None), (3, 1.0, 1.0)]
    seen = [(clip, "ab"[i % 2], float(t), float(rng.normal()), float(rng.uniform(-0.5, 0.5)), 0.01) for clip in (1, 2) for i, t in enumerate(rng.uniform(-20, 260, 400))]
    obs = spark.createDataFrame([*seen, (1, None, 5.0, 1.0, 0.0, 0.0), (None, "a", 5.0, 1.0, 0.0, 0.0)], "clip long, track string, t double, y double, row double, exposure double")
    return seen, sensor, obs, spark.createDataFrame(sensor, "clip long, t double, v double")


def test_samples_of_many_cells(spark):
    seen, sensor, obs, samples = seen_and_samples(spark)
    got = {(r.clip, r.track, r.t): [tuple(s) for s in r.near] for r in timing.with_samples(obs, samples, ["clip"], 2.0, 1.0).collect()}
    want = {}
    for clip, track, t, *_ in seen:
        own = sorted((a, v) for c, a, v in sensor if c == clip and a is not None and v is not None)
        if any(np.floor(t - 3.0) <= np.floor(a) <= np.floor(t + 3.0) for a, _ in own):
            before, after = [s for s in own if t - 3 <= s[0] < t - 2], [s for s in own if t + 2 < s[0] <= t + 3]
            want[clip, track, t] = before[-1:] + [s for s in own if t - 2 <= s[0] <= t + 2] + after[:1]
    assert got == want and 0 < len(want) < len(seen)


def test_steps_are_held_together(spark):
    """Many steps a row, cut by batches and by the number that a row holds, leave what each of them leaves by itself."""
    _, _, obs, samples = seen_and_samples(spark)
    near = timing.with_samples(obs, samples, ["clip"], 2.0, 1.0).cache()
    values = [0.3, 0.2, 0.05, 1.5]
    order = Window.partitionBy("clip", "track").orderBy("t")
    place = F.col("t") + values[0] + values[1] * F.col("row") + values[3] * F.col("exposure")
    read = near.withColumn("v", timing.read_at(F.col("near"), place))
    left = F.col("y") - F.lag("y").over(order) - (1 + values[2]) * (F.col("v") - F.lag("v").over(order))
    want = sorted((r.clip, r.r) for r in read.select("clip", left.alias("r")).filter("r is not null").collect())
    for most in (10_000, 90, 7):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
        try:
            rows = timing.steps(near, ["clip"]).toPandas()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        own, row = timing.opened([rows[c].to_numpy() for c in timing.PACKED])
        r = timing.residuals(own, values)[0]
        got = sorted((int(c), float(x)) for c, x in zip(rows["clip"].to_numpy()[row], r) if not np.isnan(x))
        assert rows["n"].max() <= timing.TOGETHER and len(got) == len(want) and np.allclose(got, want, rtol=0, atol=1e-12)
        assert most < 90 or len(rows) < len(row) / 8


def test_timing_without_samples(spark):
    _, _, obs, samples = seen_and_samples(spark)
    found = timing.fit_timing(obs, samples.filter("clip > 2"), ["clip"], timing.Timing(reach=1.0, loss=1.0, block=10.0, rounds=2), 1.0)
    assert found.count() == 0


def test_steps_of_many_groups():
    """Damped steps and rounds of many groups at once are those of each by itself, also where unknowns are not determined."""
    rng = np.random.default_rng(6)
    j = rng.normal(size=(60, 8, 3)) * (1, 1, 0)
    j[::2, :, 2] = rng.normal(size=(30, 8))
    a, g, damping = j.transpose(0, 2, 1) @ j, rng.normal(size=(60, 3)) * (1, 1, 0), rng.choice([0.0, 1e-3, 10.0], 60)
    got = fits.damped_steps(a, g, damping)
    assert np.allclose(got, [fits.damped_step(*x) for x in zip(a, g, damping)])
    upper = a[:, *np.triu_indices(3)]
    groups = pd.DataFrame({
        "x": list(np.ones((3, 3))), "best": list(np.zeros((3, 3))), "cost": [np.inf, 1.0, np.inf], "a": [None, list(upper[1]), None], "g": [None, list(g[1]), None],
        "n": [0, 4, 0], "damping": [1e-3] * 3, "new_n": [5.0, 6.0, None], "loss": [2.0, 2.0, None], "new_a": [list(upper[0]), list(upper[2]), None], "new_g": [list(g[0]), list(g[2]), None],
    })
    out = fits.stepped(groups, [Unknown(c, low=-9.0, high=9.0) for c in "xyz"])
    assert [list(x) for x in out["best"]] == [[1.0] * 3, [0.0] * 3, [0.0] * 3] and list(out["n"]) == [5, 4, 0] and out["a"][2] is None
    assert np.allclose(out["damping"], [2e-4, 8e-3, 1e-3]) and list(out["cost"]) == [2.0, 1.0, np.inf] and out["move"][2] == 0 and list(out["x"][2]) == [1.0] * 3
    assert np.allclose(out["x"][0], 1 + fits.damped_step(a[0], g[0], 2e-4)) and np.allclose(out["x"][1], fits.damped_step(a[1], g[1], 8e-3))


def test_queries(spark):
    assert calibration.fitted_timing(spark, TINY).count() == 15
    rows = calibration.shared_curve(spark, SMALL).collect()
    assert len(rows) == 100 and len({(r.bend, r.discount) for r in rows}) == 1 and sum(r.n for r in rows) == 60000
