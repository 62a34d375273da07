"""Registered queries that SQL cannot express, over whole tables against plain NumPy."""

import json

import numpy as np
import pandas as pd
import pytest

from kinesieve.operators import solve
from kinesieve.plans import measures, solvers
from tests.conftest import SMALL

REACH = np.sqrt((1920**2 + 1080**2) / 12)


@pytest.fixture(scope="module")
def pieces():
    """(clip, segment) -> its rows in order, cut where a step is over five times the clip's median."""
    df = pd.read_parquet(f"{SMALL}/events.parquet")
    df["t"] = df["ts"].astype("datetime64[us]").astype("int64")
    df["k"] = df["props"].map(lambda x: float(json.loads(x)["k"]) if x else np.nan)
    out = {}
    for clip, part in df.sort_values(["t", "event_id"]).groupby("user_id"):
        steps = np.diff(part["t"])
        segment = np.concatenate(([0], np.cumsum(steps > 5 * np.median(steps)))) if len(part) > 1 else np.zeros(1, int)
        for s in np.unique(segment):
            out[clip, int(s)] = part[segment == s]
    return out


def measured(part):
    """(known, energy, bands' energies, hf by axis, speed, jump) of a segment's rows."""
    steps = np.stack([(part["value"] - 60) / 50, (part["k"] - 50) / 50, part["value"] / 1e5, part["k"] / 1e5], axis=1)
    known = np.isfinite(steps).all(axis=1)
    steps = np.nan_to_num(steps)
    path = np.cumsum(steps, axis=0)
    low = {f: np.stack([solve.zero_phase(p, f, 1.0) for p in path.T], axis=1) for f in (0.05, 0.2, 0.45)}
    scale = np.array([1, 1, REACH, REACH])
    fast = (path - low[0.05]) * scale
    bands = [(((low[b] - low[a]) * scale) ** 2).sum(axis=1) for a, b in ((0.05, 0.2), (0.2, 0.45))]
    slow = np.gradient(low[0.05][:, :2], axis=0) if len(path) > 1 else np.zeros((1, 2))
    near = np.array([[np.median(np.pad(s, 3, mode="edge")[i : i + 7]) for s in steps[:, :2].T] for i in range(len(steps))])
    return known, (fast**2).sum(axis=1), *bands, *(fast.T**2), np.hypot(*slow.T), np.hypot(*(steps[:, :2] - near).T)


def by_clip(pieces):
    out = {}
    for (clip, s), part in pieces.items():
        out.setdefault(clip, []).append(measured(part))
    return out


def test_signal_metrics(spark, pieces):
    rows = {r.clip_id: r for r in solvers.signal_metrics(spark, SMALL).collect()}
    want = by_clip(pieces)
    assert set(rows) == {c for c, segments in want.items() if any(m[0].any() for m in segments)}
    for clip, r in rows.items():
        known, hf, b0, b1, tx, ty, rot, logs, speed, jump = (np.concatenate(x) for x in zip(*want[clip]))
        assert r.n == known.sum()
        for name, x in (("hf", hf), ("band_0", b0), ("band_1", b1), ("hf_tx", tx), ("hf_ty", ty), ("hf_rot", rot), ("hf_logs", logs)):
            assert np.isclose(r[name], np.sqrt(x[known].mean()), atol=1e-9), (clip, name)
        calm = known & (speed < 0.3)
        assert np.isclose(r.calm_share, calm.sum() / known.sum())
        assert (r.calm_hf is None) == (calm.sum() < 60) and (r.calm_hf is None or np.isclose(r.calm_hf, np.sqrt(hf[calm].mean())))
        assert (r.jumps_half, r.jumps_one) == ((jump[known] > 0.5).sum(), (jump[known] > 1).sum()) and np.isclose(r.jump_max, jump[known].max())


def test_window_metrics(spark, pieces):
    rows, told = {r.clip_id: r for r in solvers.window_metrics(spark, SMALL).collect()}, 0
    for clip, segments in by_clip(pieces).items():
        rms, speeds = [], []
        for known, hf, *_, speed, _ in segments:
            for i in range(0, len(known) - 3, 4):
                use = known[i : i + 4]
                if use.any():
                    rms.append(np.sqrt(hf[i : i + 4][use].mean()))
                    speeds.append(speed[i : i + 4][use].mean())
        if not rms:
            assert clip not in rows
            continue
        r, rms, speeds = rows[clip], np.array(rms), np.array(speeds)
        assert r.windows == len(rms)
        assert np.allclose([r["median"], r.p90, r.most, r.least], [np.median(rms), np.percentile(rms, 90), rms.max(), rms.min()])
        if len(rms) >= 4 and rms.std() > 0 and speeds.std() > 0:
            told += 1
            calm, active = speeds <= np.percentile(speeds, 50) + 1e-12, speeds >= np.percentile(speeds, 75) - 1e-12
            assert np.allclose([r.corr, r.median_calm, r.median_active], [np.corrcoef(rms, speeds)[0, 1], np.median(rms[calm]), np.median(rms[active])])
        else:
            assert r["corr"] is None and r.median_calm is None and r.median_active is None
    assert told > 50


def test_jump_guard(spark, pieces):
    """By its definition, row by row: every row fades by its distance to each cut."""
    got = {r.event_id: r.guarded for r in solvers.jump_guard(spark, SMALL).collect()}
    faded = 0
    for part in pieces.values():
        path, support = part["value"].to_numpy(float) - 60, part["k"].to_numpy(float) / 100
        want = path.copy()
        if len(path) >= 8:
            whole = np.interp(np.arange(len(path)), np.flatnonzero(np.isfinite(path)), path[np.isfinite(path)]) if np.isfinite(path).any() else path
            step = np.diff(whole)
            for i in range(len(path)):
                for j, s in enumerate(step):
                    around = np.pad(step, 3, mode="edge")[j : j + 7]
                    if abs(i - j - 0.5) < 12 and abs(s - np.median(around)) > 120 and not support[j + 1] >= 0.5:
                        want[i] = min(want[i], path[i] * np.sin(np.pi * abs(i - j - 0.5) / 24) ** 2, key=abs)
                        faded += 1
        for event, x in zip(part["event_id"], want):
            assert (got[event] is None and np.isnan(x)) or np.isclose(got[event], x, atol=1e-9)
    assert faded > 100


@pytest.mark.parametrize("name", ["bootstrap_ratio_ci", "bootstrap_difference_ci"])
def test_bootstrap_intervals(spark, duck, name):
    """The plain figures are exact; the intervals are as wide as the linear approximation says."""
    df = duck.execute("SELECT l_returnflag AS g, l_extendedprice::DOUBLE AS f, l_extendedprice::DOUBLE * (1 - l_discount::DOUBLE) AS n FROM lineitem").df()
    rows = {r.l_returnflag: r for r in getattr(measures, name)(spark, SMALL).collect()}
    assert set(rows) == set(df["g"].unique())
    for g, part in df.groupby("g"):
        f, n, r = part["f"].to_numpy(), part["n"].to_numpy(), rows[g]
        ratio = n.mean() / f.mean()
        plain, error = (ratio, (n - ratio * f) / f.mean()) if "ratio" in name else ((f - n).mean(), f - n)
        assert r.n == len(part) and np.isclose(r[2], plain)
        half = 1.96 * error.std() / np.sqrt(len(part))
        assert r.lo < plain < r.hi and 0.75 < (r.hi - r.lo) / (2 * half) < 1.3
