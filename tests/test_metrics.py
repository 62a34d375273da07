import numpy as np
from pyspark.sql import functions as F

from kinesieve.operators import metrics, solve

SCHEMA = "clip long, seg long, i long, tx double, ty double, rot double, logs double"


def signals(n=400):
    rng = np.random.default_rng(12)
    rows = []
    for clip, seg in ((1, 0), (1, 1), (2, 0)):
        steps = rng.normal(size=(n, 4)) * [0.6, 0.4, 1e-3, 1e-3]
        steps[n // 8, 0] += 6
        rows += [(clip, seg, i, *map(float, s)) for i, s in enumerate(steps)]
    rows[7] = (*rows[7][:3], None, *rows[7][4:])
    return rows


def test_metric_row_against_numpy(spark):
    df = spark.createDataFrame(signals(), SCHEMA)
    paths = metrics.filtered_paths(df.repartition(5), ["clip", "seg"], ["i"], 30.0)
    got = {r["clip"]: r for r in metrics.metric_row(paths, ["clip"], 1920, 1080, calm_speed=8.0).collect()}
    reach = np.sqrt((1920**2 + 1080**2) / 12)
    for clip in (1, 2):
        parts = {k: [] for k in ("hf", "b0", "b1", "speed", "jump", "known", "tx")}
        for seg in sorted({r[1] for r in signals() if r[0] == clip}):
            steps = np.array([[np.nan if x is None else x for x in r[3:]] for r in signals() if r[:2] == (clip, seg)])
            parts["known"].append(np.isfinite(steps).all(1))
            steps = np.nan_to_num(steps)
            path = np.cumsum(steps, 0)
            low = {f: np.stack([solve.zero_phase(p, f, 30.0) for p in path.T], 1) for f in (2.0, 8, 30)}
            weight = np.array([1, 1, reach, reach])
            for name, x in (("hf", path - low[2.0]), ("b0", low[8] - low[2.0]), ("b1", low[30] - low[8])):
                parts[name].append(((x * weight) ** 2).sum(1))
            parts["tx"].append((path - low[2.0])[:, 0] ** 2)
            parts["speed"].append(np.hypot(*np.gradient(low[2.0][:, :2], axis=0).T) * 30)
            medians = np.stack([[np.median(np.pad(s, 3, mode="edge")[i : i + 7]) for i in range(len(s))] for s in steps[:, :2].T], 1)
            parts["jump"].append(np.hypot(*(steps[:, :2] - medians).T))
        all_ = {k: np.concatenate(v) for k, v in parts.items()}
        use = all_["known"]
        r = got[clip]
        assert r["n"] == use.sum()
        for name, key in (("hf", "hf"), ("band_0", "b0"), ("band_1", "b1"), ("hf_tx", "tx")):
            assert np.isclose(r[name], np.sqrt(all_[key][use].mean()))
        calm = use & (all_["speed"] < 8.0)
        assert np.isclose(r["calm_share"], calm.sum() / use.sum())
        assert np.isclose(r["calm_hf"], np.sqrt(all_["hf"][calm].mean())) if calm.sum() >= 60 else r["calm_hf"] is None
        assert r["jumps_one"] == (all_["jump"][use] > 1).sum() and np.isclose(r["jump_max"], all_["jump"][use].max())


def test_few_calm_rows_are_null(spark):
    df = spark.createDataFrame(signals(40), SCHEMA).filter("clip = 2")
    paths = metrics.filtered_paths(df, ["clip", "seg"], ["i"], 30.0)
    row = metrics.metric_row(paths, ["clip"], 1920, 1080, calm_speed=1e9).first()
    assert row["calm_hf"] is None and row["calm_share"] == 1.0
    windows = metrics.window_rms(paths, ["clip"], F.col("i"), 10, 1920, 1080).collect()
    assert len(windows) == 4 and all(w["n"] == 10 for w in windows)


def test_jumps_without_support_fade():
    rng = np.random.default_rng(1)
    path = np.cumsum(rng.normal(size=200)) * 0.01
    path[100:] += 5
    support = np.full(200, 0.9)
    assert np.array_equal(solve.guarded_jumps(path, support, 1.0), path)
    support[100] = 0.1
    out = solve.guarded_jumps(path, support, 1.0)
    assert np.abs(np.diff(out)).max() < 0.7 and np.array_equal(out[:80], path[:80]) and np.allclose(out[130:], path[130:])
    support[100] = np.nan
    assert np.array_equal(solve.guarded_jumps(path, support, 1.0), out)
    path[30] = np.nan
    assert np.isnan(solve.guarded_jumps(path, support, 1.0)[30])


def test_sources_cover_greedily():
    offset = np.array([-1, 1, 5])
    gain = np.zeros((2, 3, 4))
    gain[0] = [[1, 1, 0, 0], [0, 0, 0, 0], [1, 1, 1, 1]]
    gain[1] = [[0, 0, 0, 0], [1, 1, 0, 0], [1, 1, 0, 0]]
    # near candidates first: 0.5 / 1.5 against 1 / 3.5, then what is still open
    assert solve.chosen_sources(gain, offset, 2.0, 1.0, 0.1)[0] == [0, 2]
    # the second row keeps offset 5, which the first one used, if the bonus makes up for its distance
    assert solve.chosen_sources(gain, offset, 2.0, 1.0, 0.1)[1] == [1]
    assert solve.chosen_sources(gain, offset, 2.0, 3.0, 0.1)[1] == [2]
    assert solve.chosen_sources(gain, offset, 2.0, 1.0, 0.9) == [[], []]
