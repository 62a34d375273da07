"""Row matrices of render plans against plain NumPy."""

import numpy as np
from pyspark.sql import functions as F

from kinesieve.operators import rowplan
from kinesieve.operators.orientation import product, turn_of

QUAT = "struct<w:double,x:double,y:double,z:double>"
FRAMES, SAMPLES = f"clip int, frame int, t double, exposure double, virtual {QUAT}", f"clip int, t double, tie long, q {QUAT}"


def attitude(t):
    t = np.atleast_1d(t)
    return np.stack([0.5 * np.sin(3 * t), 0.3 * np.cos(2 * t), 0.2 * t], axis=1)


def at(t, step, last):
    """Orientation at t between samples every `step`, along the arc from one to the next."""
    t = np.clip(t, 0, last)
    i = min(int(np.floor(t / step + 1e-9)), int(round(last / step)) - 1)
    a, b = turn_of(attitude(i * step))[0], turn_of(attitude((i + 1) * step))[0]
    dot = a @ b
    b, dot = (-b, -dot) if dot < 0 else (b, dot)
    th, u = np.arccos(min(dot, 1.0)), t / step - i
    return (np.sin((1 - u) * th) * a + np.sin(u * th) * b) / np.sin(th)


def rotation(q):
    w, x, y, z = q
    return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]])


def inputs(spark, exposures, step=0.002, last=2.0):
    rng = np.random.default_rng(3)
    n = int(round(last / step)) + 1
    # signs of quaternions are arbitrary
    samples = [(1, float(i * step), i, tuple(map(float, q * rng.choice([-1, 1])))) for i, q in enumerate(turn_of(attitude(np.arange(n) * step)))]
    samples += [(1, 0.5001, 9_999_999, None), (2, None, 0, (1.0, 0.0, 0.0, 0.0))]
    virtual = tuple(map(float, turn_of(np.array([[0.1, -0.2, 0.3]]))[0] * 3))
    frames = [(1, k, float(t), e, virtual) for k, (t, e) in enumerate(exposures)] + [(2, 0, 0.5, 0.01, virtual), (1, 99, None, 0.01, virtual), (None, 1, 0.1, 0.01, virtual)]
    return spark.createDataFrame(frames, FRAMES), spark.createDataFrame(samples, SAMPLES).repartition(3), virtual


def expected(t, e, virtual, clock, rate, height, n_rows, step, last, taps=9):
    q = np.array(virtual) / np.linalg.norm(virtual)
    e = 0.0 if e is None else min(max(e, 0), 0.05)
    window = e * min(max((e - 0.002) / 0.0015, 0), 1) * clock.exposure_scale
    n = taps * 2 ** min(max(int(np.ceil(np.log2((np.ceil(window * rate) + 1) / taps))), 0), 4) if rate >= 500 else 1
    turn = turn_of(np.array([clock.turn]))
    for j in range(n_rows):
        middle = t + clock.readout * ((j * (height - 1) / (n_rows - 1) + 0.5) / height - 0.5)
        get = lambda x: product(at(x * (1 + clock.skew) + clock.offset, step, last)[None], turn)[0]
        centre, total = get(middle), np.zeros(4)
        for u in (np.arange(n) + 0.5) / n - 0.5:
            x = get(middle + window * u)
            total += x * (-1 if x @ centre < 0 else 1)
        yield rotation(total / np.linalg.norm(total)).T @ rotation(q)


def test_rows_are_read_at_their_own_times(spark):
    exposures = [(0.0, 0.001), (0.31, 0.0028), (0.5, 0.01), (0.777, 0.04), (1.2, None), (1.999, 0.2), (3.0, 0.01)]
    frames, samples, virtual = inputs(spark, exposures)
    clock = rowplan.Clock(offset=0.003, skew=1e-4, readout=0.012, turn=(0.01, 0.02, -0.03), exposure_scale=1.1)
    for rate, cell in ((500.0, 8.0), (500.0, 0.01), (100.0, 0.25)):
        got = {(r.clip, r.frame, r.row): r.m for r in rowplan.row_matrices(frames, samples, "clip", 1080, 5, clock, rate, cell=cell).collect()}
        assert len(got) == (len(exposures) + 2) * 5
        assert all(got[k] is None for k in got if k[0] == 2 or k[1] == 99)
        for k, (t, e) in enumerate(exposures):
            for j, want in enumerate(expected(t, e, virtual, clock, rate, 1080, 5, 0.002, 2.0)):
                assert np.allclose(np.reshape(got[1, k, j], (3, 3)), want, atol=1e-9), (rate, cell, k, j)


def test_corrections_turn_the_camera_and_none_do_nothing(spark):
    frames, samples, virtual = inputs(spark, [(0.4, 0.001), (1.0, 0.001)])
    turn = turn_of(np.array([[0.02, 0.0, -0.01]]))[0]
    steady = spark.createDataFrame([(1, 0.0, 0, tuple(map(float, turn))), (1, 9.0, 1, tuple(map(float, -turn)))], SAMPLES)
    plain = {(r.frame, r.row): r.m for r in rowplan.row_matrices(frames.filter("clip = 1"), samples, "clip", 720, 3).collect()}
    got = {(r.frame, r.row): r.m for r in rowplan.row_matrices(frames.filter("clip = 1"), samples, "clip", 720, 3, corrections=steady).collect()}
    none = {(r.frame, r.row): r.m for r in rowplan.row_matrices(frames.filter("clip = 1"), samples, "clip", 720, 3, corrections=steady.limit(0)).collect()}
    for k, m in plain.items():
        assert none[k] == m
        if m is not None:
            assert np.allclose(np.reshape(got[k], (3, 3)), rotation(turn).T @ np.reshape(m, (3, 3)), atol=1e-12)


def test_empty_tables(spark):
    frames, samples, _ = inputs(spark, [(0.4, 0.01)])
    assert rowplan.row_matrices(frames.limit(0), samples, "clip", 720, 4, rate=1000.0).collect() == []
    assert {r.m for r in rowplan.row_matrices(frames, samples.limit(0), "clip", 720, 4, rate=1000.0).collect()} == {None}


def test_windows_of_exposures(spark):
    e = [None, float("nan"), -1.0, 0.002, 0.00275, 0.0035, 0.01, 9.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in e], "e double").coalesce(1).select(rowplan.averaged_time(F.col("e"))).collect()]
    assert np.allclose(got, [0, 0, 0, 0, 0.001375, 0.0035, 0.01, 0.05])


def test_the_largest_tie_counts_on_both_sides_and_taps_are_not_moved(spark):
    turns = [tuple(map(float, q)) for q in turn_of(np.array([[0.0, 0.0, x] for x in (0.0, 0.1, 0.2, 0.9, 0.4)]))]
    samples = spark.createDataFrame([(1, t, tie, q) for (t, tie), q in zip(((0.0, 1), (0.0, 2), (1.0, 9), (1.0, 3), (1.0, 4)), turns)], SAMPLES)
    frames = spark.createDataFrame([(1, 0, 0.5, None, (1.0, 0.0, 0.0, 0.0))], FRAMES)
    for cell in (8.0, 0.4):
        got = rowplan.row_matrices(frames, samples, "clip", 720, 2, cell=cell)
        for r in got.collect():
            assert np.allclose(np.reshape(r.m, (3, 3)), rotation(turn_of(np.array([[0.0, 0.0, 0.15]]))[0]).T, atol=1e-12)
    # what is shuffled are frames and samples: nothing explodes to the times of a row
    plan = rowplan.row_matrices(frames, samples, "clip", 720, 2, rate=1000.0)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "tap" not in plan
