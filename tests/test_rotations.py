"""Rotation fits against singular values, and corrections against sums put in."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinesieve.operators import corrections, rotfit
from kinesieve.operators.corrections import Folding
from kinesieve.operators.solve import solve_systems, weighted_integrals


def matrix(v):
    a = np.linalg.norm(v)
    k = np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]]) / max(a, 1e-300)
    return np.eye(3) + np.sin(a) * k + (1 - np.cos(a)) * k @ k


def best(a, b, w):
    u, _, vt = np.linalg.svd((b * w[:, None]).T @ a)
    return u @ np.diag([1, 1, np.sign(np.linalg.det(u @ vt))]) @ vt


def robust(a, b, c, rounds):
    w = np.ones(len(a))
    for _ in range(rounds):
        q = best(a, b, w)
        w = 1 / (1 + (np.linalg.norm(b - a @ q.T, axis=1) / c) ** 2)
    return q


CASES = [(0.0, 0.0, 0.0), (0.3, -0.2, 1.0), (3.0, 0.4, -0.5), (0.001, 0.002, -0.001), (0.0, 3.14159, 0.0)]


@pytest.fixture(scope="module")
def fitted(spark):
    rng, rows, sets = np.random.default_rng(7), [], {}
    for g, v in enumerate(CASES):
        a = rng.normal(size=(200, 3))
        b = (a / np.linalg.norm(a, axis=1)[:, None]) @ matrix(np.array(v)).T + rng.normal(0, 1e-3, (200, 3))
        b[::10] = rng.normal(size=(20, 3))
        sets[g] = (a / np.linalg.norm(a, axis=1)[:, None], b / np.linalg.norm(b, axis=1)[:, None])
        rows += [(g, tuple(map(float, x)), tuple(map(float, y))) for x, y in zip(a, 2.0 * b)]
    rows += [(0, None, (1.0, 0.0, 0.0)), (1, (0.0, 0.0, 0.0), (1.0, 0.0, 0.0)), (2, (float("nan"), 1.0, 0.0), (1.0, 0.0, 0.0)), (9, None, None)]
    kind = "struct<x:double,y:double,z:double>"
    df = spark.createDataFrame(rows, f"g long, a {kind}, b {kind}").repartition(4)
    return sets, {r.g: r for r in rotfit.fit_rotation(df, ["g"], "a", "b", 0.01, rounds=6).collect()}


def test_rotations_match_singular_values(fitted):
    sets, got = fitted
    assert set(got) == set(sets)
    for g, (a, b) in sets.items():
        q = got[g].q
        v = np.array([q.x, q.y, q.z])
        angle = 2 * np.arctan2(np.linalg.norm(v), q.w)
        mine = matrix(v / max(np.linalg.norm(v), 1e-300) * angle)
        assert np.allclose(mine, robust(a, b, 0.01, 6), atol=1e-6)
        assert np.allclose(mine, matrix(np.array(CASES[g])), atol=1e-3)
        assert got[g].n == 200 and 0.85 < got[g].inliers < 0.95 and got[g].rms < 0.01


def test_mirrored_directions_get_a_rotation(spark):
    rows = [(1, (1.0, 0.0, 0.0), (-1.0, 0.0, 0.0)), (1, (0.0, 1.0, 0.0), (0.0, -1.0, 0.0)), (1, (0.0, 0.0, 1.0), (0.0, 0.0, -0.5))]
    kind = "struct<x:double,y:double,z:double>"
    r = rotfit.fit_rotation(spark.createDataFrame(rows, f"g int, a {kind}, b {kind}"), ["g"], "a", "b", 1.0, rounds=1).first()
    assert abs(np.linalg.norm([r.q.w, r.q.x, r.q.y, r.q.z]) - 1) < 1e-9


F60 = Folding(rate=60.0)


def errors(n, seed=1, noise=2e-5):
    """A shake of 5 Hz on one axis, a slow drift on another, and their steps as seen."""
    t = np.arange(n) / 60
    path = np.stack([1e-3 * np.sin(2 * np.pi * 5 * t), 5e-3 * np.sin(2 * np.pi * 0.1 * t), 0 * t], axis=1)
    return path, np.diff(path, axis=0, prepend=path[:1]) + np.random.default_rng(seed).normal(0, noise, (n, 3))


def test_fast_errors_are_folded_and_slow_ones_left():
    path, step = errors(1500)
    out = corrections.correction(step, np.ones(1500), F60)
    mid = slice(200, -200)
    assert np.sqrt(np.mean((out[mid, 0] - path[mid, 0]) ** 2)) < 0.1 * np.sqrt(np.mean(path[mid, 0] ** 2))
    assert np.abs(out[mid, 1]).max() < 3e-4 and np.abs(out[mid, 2]).max() < 3e-4


def test_outliers_gaps_and_bounds():
    path, step = errors(1500)
    step[700] += 0.02
    trust = np.ones(1500)
    trust[900:1000] = 0.0
    step[950] = np.nan
    out = corrections.correction(step, trust, F60)
    assert np.isfinite(out).all() and np.abs(out[690:720, 0] - path[690:720, 0]).max() < 8e-4
    assert np.abs(out[930:970]).max() < 1e-4 and np.abs(np.diff(out, axis=0)).max() < 2e-3
    big = corrections.correction(step * 100, np.ones(1500), Folding(rate=60.0, step=1.0, jump=1.0))
    assert np.sqrt((big**2).sum(axis=1)).max() <= F60.bound + 1e-12
    assert (corrections.correction(step[:2], np.ones(2), F60) == 0).all() and (corrections.correction(step, 0 * trust, F60) == 0).all()


def test_windows_fold_as_the_whole(spark):
    _, step = errors(3000, noise=1e-5)
    rows = [(1, i * 16_667, i, *map(float, e), 1.0) for i, e in enumerate(step)]
    df = spark.createDataFrame(rows, "clip long, t long, frame long, ex double, ey double, ez double, conf double").repartition(4)
    got = corrections.fold(df, ["clip"], ["t", "frame"], ["ex", "ey", "ez"], "conf", ["cx", "cy", "cz"], F60, core=800, overlap=600)
    parts = np.array([(r.cx, r.cy, r.cz) for r in got.orderBy("frame").collect()])
    assert np.abs(parts - corrections.correction(step, np.ones(3000), F60))[300:-300].max() < 5e-5


def test_rounds_compose_in_order(spark):
    rng = np.random.default_rng(3)
    turns = {(k, r): rng.normal(0, 0.5, 3) for k in range(5) for r in range(3)}
    rows = [(k, r, tuple(map(float, v))) for (k, r), v in turns.items()] + [(0, 9, None)]
    df = spark.createDataFrame(rows, "frame int, round int, v struct<x:double,y:double,z:double>").repartition(3)
    for r in corrections.compose(df, ["frame"], "round", F.col("v")).collect():
        want = np.linalg.multi_dot([matrix(turns[r.frame, i]) for i in range(3)])
        assert np.allclose(matrix(np.array([r.rotvec.x, r.rotvec.y, r.rotvec.z])), want, atol=1e-9)


def test_rounds_are_accepted_by_window(spark):
    rows = [(1, i, 1.0, 0.5 if i < 100 else 1.2 if i < 200 else 0.99) for i in range(300)] + [(2, 0, 1.0, 0.1), (1, 301, None, 1.0)]
    df = spark.createDataFrame(rows, "clip int, place long, b double, a double")
    windows = corrections.accepted_windows(df, ["clip"], "place", F.col("b"), F.col("a"), 100)
    assert {(r.clip, r.window): r.accepted for r in windows.collect()} == {(1, 0): True, (1, 1): False, (1, 2): False, (2, 0): False}
    turn = F.struct(F.lit(1.0).alias("x"), F.lit(0.0).alias("y"), F.lit(-2.0).alias("z"))
    out = {(r.clip, r.place): r for r in corrections.blended(df, windows, ["clip"], "place", turn, 100).collect()}
    assert out[1, 20].share == 1.0 and out[1, 250].share == 0.0 and abs(out[1, 99].share - out[1, 100].share) < 0.05
    assert out[1, 20].rotvec.z == -2.0 and out[2, 0].share == 0.0


def test_runs_of_one_length_are_corrected_at_once():
    rng = np.random.default_rng(8)
    f = Folding(rate=8.0, slow=0.4, bound=0.4, step=0.15, jump=0.3)
    for n in (1, 2, 7, 8, 15, 16, 40):
        error, trust = rng.normal(0, 0.2, (12, n, 3)), rng.random((12, n))
        error[rng.random((12, n)) < 0.1], trust[0], trust[1] = np.nan, 0.0, np.nan
        many = corrections.corrected(error, trust, f)
        assert (many[:2] == 0).all()
        for e, t, got in zip(error, trust, many):
            assert np.allclose(got, corrections.correction(e, t, f), atol=1e-11)


def test_many_short_segments_are_not_solved_one_by_one(spark, monkeypatch):
    from kinesieve.operators import windows

    calls = []
    error = np.random.default_rng(9).normal(0, 0.1, (300, 12, 4))
    error[:, :, 3] = 1.0  # trust
    monkeypatch.setattr(corrections, "solve_windows", lambda df, keys, order, columns, out, solve, *more: calls.append(solve))
    f = Folding(rate=8.0, slow=0.4, bound=0.4, step=0.15, jump=0.3)
    corrections.fold(None, ["clip"], ["t"], ["x", "y", "z"], "trust", ["a", "b", "c"], f)
    runs = []
    monkeypatch.setattr(corrections, "weighted_integrals", lambda v, *more, **named: runs.append(len(v)) or weighted_integrals(v, *more, **named))
    found = calls[0](np.arange(0, 3601, 12), *error.reshape(-1, 4).T)
    assert [len(x) for x in found] == [3600] * 3 and runs == [300]
    offsets = np.array([0, 2, 5, 7, 8])
    assert sorted(i.tolist() for i in windows.equally_long(offsets)) == [[[0, 1], [5, 6]], [[2, 3, 4]], [[7]]]


def test_integrals_are_right_to_rounding():
    """A run whose steps are mostly missing has a system that is nearly singular."""
    rng = np.random.default_rng(10)
    v, w = rng.normal(0, 0.1, (9, 40, 2)), np.where(rng.random((9, 40)) < 0.6, 0.0, rng.random((9, 40)))
    exact = weighted_integrals(v, w, rate=8.0, by=lambda bands, right: solve_systems(bands.astype(np.longdouble), right.astype(np.longdouble)))
    assert np.abs(weighted_integrals(v, w, rate=8.0) - exact).max() < 1e-10
