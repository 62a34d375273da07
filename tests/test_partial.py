"""Sums of arrays by group against plain ones, in one piece and in many."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinesieve.operators import fits, partial
from kinesieve.operators.fits import Unknown


@pytest.mark.parametrize("most", [1 << 23, 100])
def test_sums_by_group(spark, monkeypatch, most):
    monkeypatch.setattr(partial, "HELD", most)
    df = spark.range(200_000).select((F.col("id") % 70_001).alias("a"), F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("b"), F.col("id").cast("double").alias("x"))
    parts = lambda c: (c[0] % 3 > 0, [np.ones(int((c[0] % 3 > 0).sum())), c[0][c[0] % 3 > 0]])
    got = partial.added(df, ["a", "b"], 2, parts)
    want = df.filter("x % 3 > 0").groupBy("a", "b").agg(F.count("*").alias("n"), F.sum("x").alias("x"))
    assert got.join(want, ["a", "b"], "full").filter("not (s0 <=> n) or not (s1 <=> x)").count() == 0


def test_own_unknowns_of_many_groups_at_once():
    """Each group's equations as they are without its own unknowns, also where these are not determined."""
    rng, own = np.random.default_rng(2), [Unknown("a", prior=0.1, sigma=2.0), Unknown("b")]
    rows = []
    for i in range(50):
        j = rng.normal(size=(6, 4)) * (1, 1, 1, i % 5 > 0)
        rows.append(((j.T @ j)[np.triu_indices(4)], j.T @ rng.normal(size=6), rng.normal(size=2), 1.0, 6))
    groups = pd.DataFrame(rows, columns=["a", "g", "own", "loss", "n"])
    a, g, steps = np.zeros((2, 2)), np.zeros(2), []
    for r in groups.to_dict("records"):
        full = fits.matrix(r["a"], 4)
        mine, right, _ = fits.with_prior(full[2:, 2:], r["g"][2:], r["own"], own)
        mine = mine + 1e-3 * np.diag(np.maximum(np.diag(mine), 1e-12))
        solve = lambda y: np.linalg.lstsq(mine, y, rcond=None)[0]  # noqa: B023, E731
        a, g = a + full[:2, :2] - full[:2, 2:] @ solve(full[2:, :2]), g + r["g"][:2] - full[:2, 2:] @ solve(right)
        steps.append(r["own"] - solve(right + full[2:, :2] @ np.array([0.3, -0.2])))
    got = fits.eliminated(groups, 2, own, 1e-3)
    assert np.allclose(got[0], a) and np.allclose(got[1], g) and np.allclose(fits.own_steps(groups, 2, own, 1e-3, np.array([0.3, -0.2])), steps)
