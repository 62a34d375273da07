"""Paths under limits: against brute force, by their optimality conditions, and window by window."""

import numpy as np
import pytest

from kinesieve.operators import paths, windows
from kinesieve.plans import paths as plans
from tests.conftest import TINY


def brute(x, low, high, calm, known):
    """One axis in a box, by cyclic coordinate descent on the dense problem."""
    n = len(x)
    h = np.diag(np.where(known, 2 * calm.fidelity, 2e-9))
    g = np.zeros(n)
    for k, w in ((1, calm.speed), (2, calm.bend), (3, calm.jerk)):
        d = np.diff(np.eye(n), k, axis=0)
        h += 2 * w * d.T @ d
        g += 2 * w * d.T @ (d @ x)
    u = np.zeros(n)
    for _ in range(60_000):
        before = u.copy()
        for i in range(n):
            u[i] = min(max(u[i] - (g[i] + h[i] @ u) / h[i, i], low[i]), high[i])
        if np.abs(u - before).max() < 1e-10:
            break
    return x + u


def walk(seed, n, step=3.0):
    return np.cumsum(np.random.default_rng(seed).normal(0, step, n))


@pytest.mark.parametrize("seed,n", [(1, 5), (2, 30), (3, 41)])
def test_matches_brute_force(seed, n):
    calm = paths.Calm(fidelity=0.05, speed=0.1, bend=1.0, jerk=1.0)
    x, rng = walk(seed, n), np.random.default_rng(seed + 9)
    up, down = rng.uniform(0.5, 6, n), rng.uniform(0.5, 6, n)
    up[n // 2] = down[n // 2] = paths.LOCKED
    out = paths.limited(np.array([0, n]), [x, up, down, np.zeros(n)], 1, paths.box_sides(1), calm)[0]
    assert np.allclose(out, brute(x, -down, up, calm, np.ones(n, bool)), atol=2e-3)


def conditions(x, sides, room, calm):
    """Stationarity, limits and complementarity of the solution for one window."""
    n, d = x.shape
    whole = np.broadcast_to(sides, (1, n, *sides.shape))
    ones = np.ones((1, n), bool)
    u, force = paths.calm_path(x[None], whole, room[None], ones, ones, calm)
    inside = {k: np.ones((1, n - k, 1)) for k in (1, 2, 3)}
    slope, _ = paths.terms(calm, x[None], u, np.full((1, n, d), 2 * calm.fidelity), inside)
    start, _ = paths.terms(calm, x[None], 0 * u, np.full((1, n, d), 2 * calm.fidelity), inside)
    slack = np.maximum(room, paths.LOCKED)[None] - np.einsum("wnca,wna->wnc", whole, u)
    left = np.abs(slope + np.einsum("wnca,wnc->wna", whole, force)).max() / np.abs(start).max()
    return left, slack.min(), (slack * force).max(), force.min()


def test_conditions_hold_with_joined_axes_and_absolute_terms():
    x = np.stack([walk(5, 400), walk(6, 400)], axis=1)
    turn = np.array([[1, 0], [0, 1], [-1, 0], [0, -1], [0.7, 0.7], [-0.7, 0.7], [0.7, -0.7], [-0.7, -0.7]])
    room = np.full((400, 8), 9.0)
    room[50:60] = 0
    for calm, least in ((paths.Calm(), 1e-7), (paths.Calm(kinks=5.0, twitches=5.0), 1e-3)):
        left, slack, gap, force = conditions(x, turn, room, calm)
        assert left < least and slack > -1e-9 and gap < 1e-6 and force >= 0


def test_limits_hold_over_a_long_clip():
    """23,500 rows: no limit is passed, and the path is far calmer than what was measured."""
    n = 23_500
    x = 40 * np.sin(np.arange(n) / 90) + np.random.default_rng(3).normal(0, 1.0, n)
    room = np.where(np.arange(n) % 1000 < 200, 2.0, 12.0)
    out = paths.limited(np.array([0, n]), [x, room, room, np.zeros(n)], 1, paths.box_sides(1), paths.Calm(fidelity=1e-4))[0]
    assert (np.abs(out - x) - room).max() < 1e-6
    assert np.abs(np.diff(out, 2)).mean() < 0.1 * np.abs(np.diff(x, 2)).mean()


def test_steps_of_kinks_are_few():
    """Absolute bends leave straight pieces."""
    x = np.concatenate((np.zeros(60), np.arange(60.0), np.full(60, 59.0)))
    calm = paths.Calm(fidelity=0.01, speed=0, bend=0, jerk=0, kinks=1.0, blunt=1e-3, steps=80)
    room = np.full(180, 50.0)
    out = paths.limited(np.array([0, 180]), [x, room, room, np.zeros(180)], 1, paths.box_sides(1), calm)[0]
    assert (np.abs(np.diff(out, 2)) > 0.02).sum() <= 8


def rows_of(n, seed, clip=1):
    rng = np.random.default_rng(seed)
    x, k = walk(seed, n), walk(seed + 1, n)
    gone = rng.random(n) < 0.05
    return [(clip, 0, i * 1_000_000_000, i, None if gone[i] else float(x[i]), float(k[i]), float(4 + i % 7), 15.0, 10.0, 1.0 if i % 97 == 0 else 0.0) for i in range(n)]


SCHEMA = "clip_id long, segment_id long, t long, event_id long, value double, k double, value_room double, up double, down double, lock double"


def test_windows_give_what_the_whole_gives(spark):
    df = spark.createDataFrame(rows_of(1500, 4), SCHEMA).repartition(5)
    whole = {r.event_id: r for r in plans.planned(df, core=10_000, overlap=0).collect()}
    parts = {r.event_id: r for r in plans.planned(df, core=300, overlap=150).collect()}
    assert len(whole) == len(parts) == 1500
    for name in ("path_value", "path_k"):
        assert max(abs(whole[i][name] - parts[i][name]) for i in whole) < 0.05
    rows = {r[3]: r for r in rows_of(1500, 4)}
    for i, r in parts.items():
        if rows[i][4] is not None:
            most = paths.LOCKED if rows[i][9] else rows[i][6]
            assert abs(r.path_value - rows[i][4]) <= most + 1e-6


def test_places_are_counted_over_stretches(spark):
    rows = [(c, (i * 7919) % 5000, i) for c in (1, 2) for i in range(400)]
    df = windows.placed(spark.createDataFrame(rows, "clip_id long, t long, event_id long"), ["clip_id"], ["t", "event_id"], stretch=300)
    got = {(r.clip_id, r.event_id): r.place for r in df.collect()}
    for c in (1, 2):
        assert [got[c, e] for _, _, e in sorted(r for r in rows if r[0] == c)] == list(range(400))


def test_odd_segments(spark):
    rows = [(1, 0, 5, 1, 2.0, 3.0, 1.0, 1.0, 1.0, 0.0), (2, 0, 5, 2, None, None, None, None, None, None), (2, 0, 6, 3, None, 1.0, 1.0, 1.0, 1.0, 0.0)]
    rows += [(3, 0, 7 + i, 4 + i, float(i), None if i == 1 else 0.0, None, None, None, None) for i in range(3)]
    got = {r.event_id: (r.path_value, r.path_k) for r in plans.planned(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == 6 and got[2] == (None, None)
    assert np.allclose(got[1], (2, 3), atol=1e-6) and np.allclose(got[5], (1, 0), atol=1e-3)
    assert plans.planned(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query(spark):
    df = plans.planned_path(spark, TINY)
    assert df.count() == 1000 and df.filter("path_value is null").count() == 0


def test_many_windows_are_eliminated_together_as_alone(monkeypatch):
    rng = np.random.default_rng(12)
    for d in (1, 2, 3):
        count, n = 520, 17
        bands = rng.normal(size=(count, d, paths.BAND + 1, n))
        bands[:, :, 0] = 30
        for b in range(paths.BAND + 1):
            bands[:, :, b, :b] = 0
        half = rng.normal(size=(count, n, d, d))
        joint, right = half @ np.swapaxes(half, 2, 3), rng.normal(size=(count, n, d))
        few = np.concatenate([paths.eliminate(bands[i : i + 4], joint[i : i + 4], right[i : i + 4]) for i in range(0, count, 4)])
        with monkeypatch.context() as patch:
            patch.setattr(np.linalg, "inv", None)  # no dense blocks
            assert np.allclose(paths.eliminate(bands, joint, right), few, atol=1e-12)
