"""Fields against dense fits, and their time parts against signals put in."""

import numpy as np
from pyspark.sql import functions as F

from kinesieve.operators import fields
from kinesieve.operators.fields import Band
from kinesieve.plans import rotations
from tests.conftest import SMALL


def phi(x, y, order, size):
    return np.stack([(x / size) ** i * (y / size) ** j for i, j in fields.terms(order)], axis=1)


def test_terms():
    assert fields.terms(2) == [(0, 0), (1, 0), (0, 1), (2, 0), (1, 1), (0, 2)]


def test_fields_match_dense_fits(spark):
    rng, rows, want = np.random.default_rng(3), [], {}
    for frame in range(3):
        x, y = rng.uniform(-480, 480, 300), rng.uniform(-270, 270, 300)
        p = phi(x, y, 2, 480.0)
        d = p @ rng.normal(0, 1, (6, 2)) + rng.normal(0, 0.05, (300, 2))
        d[::8] += 9
        f = np.linalg.lstsq(p, d, rcond=None)[0]
        for _ in range(80):
            w = 1 / (1 + ((d - p @ f) ** 2).sum(axis=1) / 0.2**2)
            f = np.linalg.solve(p.T @ (w[:, None] * p), p.T @ (w[:, None] * d))
        want[frame] = f.T.ravel()
        rows += [(frame, *map(float, r)) for r in np.column_stack((x, y, d))]
    rows += [(0, None, 1.0, 1.0, 1.0), (7, float("nan"), 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "frame int, x double, y double, dx double, dy double")
    got = {r.frame: r for r in fields.fit_fields(df, ["frame"], 2, 480.0, 0.2, rounds=25).collect()}
    assert got[7].field is None and got[7].n == 0
    for frame, f in want.items():
        assert got[frame].n == 300 and np.allclose(got[frame].field, f, atol=0.02)


def frames_of(spark, paths, support=800.0, noise=0.0, gap=None, seed=1):
    """Speeds and changes of coefficient paths (frames, count), with halves that carry noise of their own."""
    rng = np.random.default_rng(seed)
    n, count = paths.shape
    v = np.diff(paths, axis=0, prepend=paths[:1])
    side = [v + rng.normal(0, noise, v.shape) for _ in (0, 1)]
    speed = (side[0] + side[1]) / 2
    change = np.diff(v, axis=0, prepend=v[:1]) + rng.normal(0, noise / 10, v.shape)
    rows = [(1, 0, i * 16_667, i, speed[i].tolist(), change[i].tolist() if i else None, support, side[0][i].tolist(), side[1][i].tolist()) for i in range(n)]
    if gap:
        rows = [(*r[:1], int(i >= gap[1]), *r[2:]) for i, r in enumerate(rows) if not gap[0] <= i < gap[1]]
    kind = "array<double>"
    return spark.createDataFrame(rows, f"clip long, run int, t long, frame int, speed {kind}, change {kind}, support double, first {kind}, second {kind}").repartition(3)


BAND = Band(rate=60.0, low=1.5, high=12.0)


def solved(df, halves=False, **sizes):
    out = fields.solve_fields(df, ["clip", "run"], ["t", "frame"], 3, BAND, halves, **sizes).collect()
    return {r.frame: np.array(r.field) for r in out}


def signal(n=900):
    t = np.arange(n) / 60
    return np.stack([0.6 * np.sin(2 * np.pi * 3.5 * t), 20 * t + 8 * np.sin(2 * np.pi * 0.3 * t), 0.05 * np.sin(2 * np.pi * 24 * t)], axis=1)


def test_band_limits_are_kept(spark):
    x = signal()
    got = solved(frames_of(spark, x, noise=0.002))
    j = np.array([got[i] for i in range(len(x))])[60:-60]
    assert np.sqrt(np.mean((j[:, 0] - x[60:-60, 0]) ** 2)) < 0.1 * np.sqrt(np.mean(x[:, 0] ** 2))
    assert np.sqrt(np.mean(j[:, 1] ** 2)) < 0.05 and np.sqrt(np.mean(j[:, 2] ** 2)) < 0.01


def test_support_and_gaps(spark):
    x = signal()
    assert max(np.abs(v).max() for v in solved(frames_of(spark, x, support=0.0)).values()) == 0
    parts = solved(frames_of(spark, x, gap=(400, 430)))
    assert len(parts) == 870 and np.abs(parts[399]).max() < 1e-9 and np.abs(parts[430]).max() < 1e-9 and np.abs(parts[200][0]) + np.abs(parts[205][0]) > 0.2
    short = solved(frames_of(spark, x[:10]))
    assert len(short) == 10 and max(np.abs(v).max() for v in short.values()) == 0


def test_halves_shrink_noise_and_keep_signal(spark):
    t = np.arange(1200) / 60
    x = np.zeros((1200, 3))
    x[:600, 0] = 0.8 * np.sin(2 * np.pi * 5 * t[:600])
    df = frames_of(spark, x, noise=0.03).withColumn("change", F.lit(None).cast("array<double>"))
    shrunk, plain = solved(df, halves=True), solved(df)
    still, moving = range(750, 1100), range(120, 480)
    power = lambda s, r: np.sqrt(np.mean([s[i][0] ** 2 for i in r]))
    assert power(shrunk, still) < 0.6 * power(plain, still) and power(shrunk, moving) > 0.85 * power(plain, moving)


def test_windows_solve_as_the_whole(spark):
    df = frames_of(spark, signal(2400), noise=0.002)
    whole, parts = solved(df), solved(df, core=700, overlap=500)
    assert max(np.abs(whole[i] - parts[i]).max() for i in range(60, 2340)) < 0.02


def test_grid_and_similarity(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0, -1.0, 0.5, 0.25])], "frame int, field array<double>")
    got = {(r.column, r.row): (r.dx, r.dy) for r in fields.on_grid(df, 200.0, 100.0, 3, 2, 1, 100.0).collect()}
    assert len(got) == 6 and got[0, 0] == (1 - 2 - 1.5, -1 - 0.5 - 0.125) and got[2, 1] == (1 + 2 + 1.5, -1 + 0.5 + 0.125)
    assert df.select(fields.similarity_part(F.col("field"), 3).alias("s")).first().s == [1.0, 2.0, -0.5, -1.0, 0.5, 2.0]


def test_queries(spark):
    assert rotations.monthly_fields(spark, SMALL).count() > 100
    rows = rotations.fitted_rotation(spark, SMALL).collect()
    assert sum(r.n for r in rows) == 500
    assert rotations.folded_correction(spark, SMALL).filter("cx is null").count() == 0
