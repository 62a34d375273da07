"""Robust non-linear least squares whose normal equations are sums in Spark.

A model gives a row's residuals as expressions of the unknowns, which are columns or numbers. Derivatives
are differences at given steps. A model of many parts may be written over arrays instead (Batched), also of rows
that hold many observations (Packed). Residuals count by a Cauchy loss, log(1 + |r|^2 / c^2), through its weights;
unknowns are held near a prior. Every round is one aggregation of the rows, with partial sums before the
shuffle, so a group of any share of the rows is fine; what follows works on one row a group. Steps are
damped after Levenberg and Marquardt and only taken where they lower the cost.

fit_groups: every group has its own unknowns. fit_shared: some unknowns are shared by all groups; a
group's own ones are eliminated from its equations, what is left is summed to one small system, solved
on the driver, and the own ones follow from the shared ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinesieve.operators.partial import added
from kinesieve.sources.rounds import settled

Model = Callable[[list[Column]], list[Column]]


@dataclass(frozen=True)
class Unknown:
    """A value to find: where it starts, the step of its derivative, its prior and bounds."""

    name: str
    start: float = 0.0
    step: float = 1e-4
    prior: float | None = None
    sigma: float = 1e6
    low: float = -1e300
    high: float = 1e300


@dataclass(frozen=True)
class Batched:
    """A model over many rows at once: residuals(columns, values) gets an array for each of `columns`
    and of the unknowns, and returns one for each residual. Missing numbers are NaN."""

    columns: dict[str, Column]
    residuals: Callable[[dict[str, np.ndarray], list[np.ndarray]], list[np.ndarray]]


@dataclass(frozen=True)
class Packed:
    """A model over rows that hold many observations each. opened(columns) gives arrays of observations by name and
    each observation's row, those of a row one after another; residuals() as of Batched, by observations."""

    columns: dict[str, Column]
    opened: Callable[[list[np.ndarray]], tuple[dict[str, np.ndarray], np.ndarray]]
    residuals: Callable[[dict[str, np.ndarray], list[np.ndarray]], list[np.ndarray]]


def products(r: np.ndarray, step: np.ndarray, c: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which rows take part, and what each adds to (n, loss, a, g); r: residuals (set, residual, row)."""
    j = (r[1:] - r[0]) / step[:, None, None]
    fine = (np.abs(r[0]) < 1e300).all(axis=0) & (np.abs(j) < 1e300).all(axis=(0, 1))
    r, j = (r[0], j) if fine.all() else (r[0][:, fine], j[:, :, fine])
    share = (r * r).sum(axis=0) / (c * c)
    w = 1 / (1 + share)
    dot = lambda x, y: np.einsum("ij,ij->j", x, y)
    weighed = [w * x for x in j]
    entry = [dot(weighed[a], j[b]) for a, b in zip(*np.triu_indices(len(j)))]
    return fine, [np.ones(len(w)), np.log1p(share) * c * c, *entry, *[dot(x, r) for x in weighed]]


def over_arrays(names: list[str], residuals: Callable, step: np.ndarray) -> Callable[[list[np.ndarray]], np.ndarray]:
    """Residuals (set, residual, row) from columns and unknowns: at the unknowns, then with a step of each."""

    def run(columns: list[np.ndarray]) -> np.ndarray:
        own, at = dict(zip(names, columns)), columns[len(names) :]
        return np.array([residuals(own, [v + step[j] if i == j else v for j, v in enumerate(at)]) for i in range(-1, len(at))])

    return run


def over_packed(count: int, opened: Callable, residuals: Callable, step: np.ndarray, c: float, part: Callable | None) -> Callable[[list[np.ndarray]], tuple]:
    """From `count` columns and the unknowns: what stretches of observations of one row and part add to the sums."""

    def run(columns: list[np.ndarray]) -> tuple:
        own, row = opened(columns[:count])
        at = [x[row] for x in columns[count:]]
        r = np.array([residuals(own, [v + step[j] if i == j else v for j, v in enumerate(at)]) for i in range(-1, len(at))])
        fine, found = products(r, step, c)
        row, of = row[fine], part(own)[fine] if part else np.zeros(int(fine.sum()), np.int64)
        first = np.ones(len(row), bool)
        first[1:] = (row[1:] != row[:-1]) | (of[1:] != of[:-1])
        first = np.flatnonzero(first)
        return row[first], [np.add.reduceat(x, first) if len(first) else x for x in found], *([of[first]] if part else [])

    return run


def sums(rows: DataFrame, keys: list[str], model: Model | Batched | Packed, values: list[Column], unknowns: list[Unknown], c: float, part: Callable | None = None) -> DataFrame:
    """(keys, n, loss, a, g): per group the upper triangle of J'WJ by rows and J'Wr, at `values`.

    Rows with a residual that is null or not finite take no part. part(arrays): whole numbers by which the
    observations of a packed model are told apart further, as `part` beside the keys.
    """
    k, step = len(unknowns), np.array([u.step for u in unknowns])
    number = lambda x: F.coalesce(x.cast("double"), F.lit(float("nan")))
    p = 2 + k * (k + 1) // 2 + k
    more = {"part": "long"} if part else {}
    if isinstance(model, Packed):
        given = [*model.columns.values(), *map(number, values)]
        found = added(rows.select(*keys, *[x.alias(f"__{i}") for i, x in enumerate(given)]), keys, p, over_packed(len(model.columns), model.opened, model.residuals, step, c, part), more)
        return equations(found, [*keys, *more], k)
    if isinstance(model, Batched):
        given, residuals = [*model.columns.values(), *values], over_arrays(list(model.columns), model.residuals, step)
    else:
        tried = [model([v + u.step if i == j else v for j, (u, v) in enumerate(zip(unknowns, values))]) for i in range(-1, k)]
        given, residuals = [x for one in tried for x in one], lambda columns: np.array(columns).reshape(k + 1, -1, len(columns[0]))
    flat = rows.select(*keys, *[number(x).alias(f"__{i}") for i, x in enumerate(given)])
    return equations(added(flat, keys, p, lambda columns: products(residuals(columns), step, c)), keys, k)


def equations(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The sums by name."""
    p = 2 + k * (k + 1) // 2 + k
    total = [F.col(f"s{i}") for i in range(p)]
    return found.select(*keys, total[0].cast("long").alias("n"), total[1].alias("loss"), F.array(*total[2 : p - k]).alias("a"), F.array(*total[p - k :]).alias("g"))


def matrix(upper: list[float], k: int) -> np.ndarray:
    out = np.zeros((k, k))
    out[np.triu_indices(k)] = upper
    return out + np.triu(out, 1).T


def with_prior(a: np.ndarray, g: np.ndarray, x: np.ndarray, unknowns: list[Unknown]) -> tuple[np.ndarray, np.ndarray, float]:
    """Equations and cost of the priors added."""
    hold = np.array([0.0 if u.prior is None else u.sigma**-2 for u in unknowns])
    off = x - np.array([u.prior or 0.0 for u in unknowns])
    return a + np.diag(hold), g + hold * off, float(hold @ off**2)


def clipped(x: np.ndarray, unknowns: list[Unknown]) -> np.ndarray:
    return np.clip(x, [u.low for u in unknowns], [u.high for u in unknowns])


def damped_step(a: np.ndarray, g: np.ndarray, damping: float) -> np.ndarray:
    size = np.maximum(np.diag(a), 1e-12)
    return -np.linalg.lstsq(a + damping * np.diag(size) + 1e-12 * size.max() * np.eye(len(a)), g, rcond=None)[0]


def damped_steps(a: np.ndarray, g: np.ndarray, damping: np.ndarray) -> np.ndarray:
    """As damped_step(), of many groups."""
    k = a.shape[1]
    size = np.maximum(np.diagonal(a, axis1=1, axis2=2), 1e-12)
    u, s, v = np.linalg.svd(a + (damping[:, None] * size + 1e-12 * size.max(axis=1, keepdims=True))[:, :, None] * np.eye(k))
    share = np.where(s > np.finfo(float).eps * k * s[:, :1], 1 / np.where(s > 0, s, 1.0), 0.0)
    return -np.einsum("nij,ni->nj", v, share * np.einsum("nij,ni->nj", u, g))


def matrices(upper: np.ndarray, k: int) -> np.ndarray:
    """As matrix(), of many groups."""
    i, j = np.triu_indices(k)
    out = np.zeros((len(upper), k, k))
    out[:, i, j] = out[:, j, i] = upper
    return out


def stacked(lists: pd.Series, size: int) -> np.ndarray:
    """Lists as rows, zeros where there is none."""
    none = np.zeros(size)
    return np.stack([none if x is None else x for x in lists]) if len(lists) else np.zeros((0, size))


STATE = "x array<double>, best array<double>, cost double, a array<double>, g array<double>, n long, damping double, move double"


def fit_groups(rows: DataFrame, keys: list[str], model: Model | Batched | Packed, unknowns: list[Unknown], c: float, rounds: int = 12, starts: DataFrame | None = None) -> DataFrame:
    """(keys, best, cost, n, a, g, move): each group's unknowns; a and g are the equations there, move
    the last step tried. starts: (keys, x) in place of the unknowns' own starts.

    Groups without usable rows keep their start with n = 0. Keys must not be null, nor have the names
    of the result's or the sums' columns.
    """
    k = len(unknowns)
    kinds = ", ".join(f"{c_} {rows.schema[c_].dataType.simpleString()}" for c_ in keys)
    if starts is None:
        starts = rows.select(*keys).distinct().withColumn("x", F.array(*[F.lit(float(u.start)) for u in unknowns]))
    empty = F.lit(None).cast("array<double>")
    state = starts.select(*keys, "x", F.col("x").alias("best"), F.lit(float("inf")).alias("cost"), empty.alias("a"), empty.alias("g"), F.lit(0).cast("long").alias("n"), F.lit(1e-3).alias("damping"), F.lit(float("inf")).alias("move"))

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pdf[keys].assign(**stepped(pdf, unknowns))

    for _ in range(rounds):
        values = [F.col(f"__x{i}") for i in range(k)]
        here = sums(rows.join(state.select(*keys, *[F.col("x")[i].alias(f"__x{i}") for i in range(k)]), keys), keys, model, values, unknowns, c)
        here = here.select(*keys, F.col("n").alias("new_n"), "loss", F.col("a").alias("new_a"), F.col("g").alias("new_g"))
        state = settled(state.join(here, keys, "left").mapInPandas(step, f"{kinds}, {STATE}"), "fit")
    return state.drop("x", "damping")


def stepped(groups: pd.DataFrame, unknowns: list[Unknown]) -> dict:
    """The state of many groups after a round: the new equations are taken where their cost is lower."""
    k = len(unknowns)
    hold = np.array([0.0 if u.prior is None else u.sigma**-2 for u in unknowns])
    middle = np.array([u.prior or 0.0 for u in unknowns])
    size = k * (k + 1) // 2
    x, best = np.stack(groups["x"]), np.stack(groups["best"])
    cost, damping = (groups[c].to_numpy(float) for c in ("cost", "damping"))
    fresh = groups["new_n"].notna().to_numpy()
    total = groups["loss"].to_numpy(float) + (x - middle) ** 2 @ hold
    better = fresh & (total <= cost)
    known = better | groups["a"].notna().to_numpy()
    a, g, best = (np.where(better[:, None], new, old) for new, old in (
        (stacked(groups["new_a"], size), stacked(groups["a"], size)), (stacked(groups["new_g"], k), stacked(groups["g"], k)), (x, best),
    ))
    n = np.where(better, groups["new_n"].fillna(0).to_numpy(float), groups["n"].to_numpy(float)).astype(np.int64)
    cost = np.where(better, total, cost)
    damping = np.where(better, np.maximum(damping / 5, 1e-9), np.where(fresh, np.minimum(damping * 8, 1e9), damping))
    tried = clipped(best + damped_steps(matrices(a, k) + np.diag(hold), g + hold * (best - middle), damping), unknowns)
    x = np.where(known[:, None], tried, x)
    move = np.where(known, np.abs(x - best).max(axis=1), 0.0)
    given = lambda rows: [r if there else None for r, there in zip(rows, known)]
    return {"x": list(x), "best": list(best), "cost": cost, "a": given(a), "g": given(g), "n": np.where(known, n, 0), "damping": damping, "move": move}


REDUCED = "a array<double>, g array<double>, loss double, n long"


def fit_shared(
    rows: DataFrame, keys: list[str], model: Callable[[list[Column], list[Column]], list[Column]],
    shared: list[Unknown], own: list[Unknown], c: float, rounds: int = 12,
) -> tuple[np.ndarray, DataFrame]:
    """The shared unknowns, and (keys, own, n) of every group. model(shared, own) gives the residuals.

    A group without usable rows keeps its start, with n = 0. Keys must not be null, nor have the names
    of the result's or the sums' columns.
    """
    k, m = len(shared), len(own)
    every = shared + own
    kinds = ", ".join(f"{c_} {rows.schema[c_].dataType.simpleString()}" for c_ in keys)
    best = np.array([u.start for u in shared])
    trial, cost, damping = best, np.inf, 1e-3
    state = begun = rows.select(*keys).distinct().withColumn("own", F.array(*[F.lit(float(u.start)) for u in own]))
    kept = system = None

    def reduced(damping: float) -> Callable:
        """Each group's equations without its own unknowns, added up over a batch of groups."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            a, g, loss, n = np.zeros((k, k)), np.zeros(k), 0.0, 0
            for pdf in batches:
                if len(pdf):
                    s, right, lost = eliminated(pdf, k, own, damping)
                    a, g, loss, n = a + s, g + right, loss + lost, n + int(pdf["n"].sum())
            yield pd.DataFrame({"a": [a.ravel()], "g": [g], "loss": [loss], "n": [n]})

        return run

    def following(shift: np.ndarray, damping: float) -> Callable:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    yield pdf[keys].assign(own=list(own_steps(pdf, k, own, damping, shift)))

        return run

    for _ in range(rounds):
        at = [F.lit(float(x)) for x in trial] + [F.col(f"__own{i}") for i in range(m)]
        mine = state.select(*keys, *[F.col("own")[i].alias(f"__own{i}") for i in range(m)])
        here = sums(rows.join(mine, keys), keys, lambda v: model(v[:k], v[k:]), at, every, c)
        here = settled(state.join(here, keys), "fit-groups")
        parts = here.mapInPandas(reduced(damping), REDUCED)
        total = parts.agg(*[F.sum(F.col("a")[i]) for i in range(k * k)], *[F.sum(F.col("g")[i]) for i in range(k)], F.sum("loss"), F.sum("n")).first()
        if total[-1] is None:
            break
        loss = total[-2]
        hold, right, held = with_prior(np.array(total[: k * k]).reshape(k, k), np.array(total[k * k : k * k + k]), trial, shared)
        if loss + held <= cost:
            best, cost, kept, system, damping = trial, loss + held, here, (hold, right), max(damping / 5, 1e-9)
        else:
            damping = min(damping * 8, 1e9)
            parts = kept.mapInPandas(reduced(damping), REDUCED)
            total = parts.agg(*[F.sum(F.col("a")[i]) for i in range(k * k)], *[F.sum(F.col("g")[i]) for i in range(k)]).first()
            hold, right, _ = with_prior(np.array(total[: k * k]).reshape(k, k), np.array(total[k * k :]), best, shared)
            system = (hold, right)
        trial = clipped(best + damped_step(*system, damping), shared)
        state = settled(kept.mapInPandas(following(trial - best, damping), f"{kinds}, own array<double>"), "fit-own")
    if kept is None:
        return best, begun.withColumn("n", F.lit(0).cast("long"))
    found = kept.select(*keys, F.col("own").alias("__found"), "n")
    return best, begun.join(found, keys, "left").select(*keys, F.coalesce("__found", "own").alias("own"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def split(groups: pd.DataFrame, k: int, own: list[Unknown], damping: float) -> tuple:
    """The equations of many groups in blocks, the own ones with priors and damping, and the own ones' inverse."""
    m = len(own)
    i, j = np.triu_indices(k + m)
    full = np.zeros((len(groups), k + m, k + m))
    full[:, i, j] = full[:, j, i] = np.stack(groups["a"])
    g = np.stack(groups["g"])
    hold = np.array([0.0 if u.prior is None else u.sigma**-2 for u in own])
    off = np.stack(groups["own"]) - np.array([u.prior or 0.0 for u in own])
    mine = full[:, k:, k:] + np.diag(hold)
    size = np.maximum(np.diagonal(mine, axis1=1, axis2=2), 1e-12)
    # the least solution where an own unknown is not determined
    inverse = np.linalg.pinv(mine + damping * size[:, :, None] * np.eye(m), rcond=np.finfo(float).eps * m)
    return full[:, :k, :k], full[:, :k, k:], inverse, g[:, :k], g[:, k:] + hold * off, off**2 @ hold


def eliminated(groups: pd.DataFrame, k: int, own: list[Unknown], damping: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Equations of the shared unknowns and the cost, added up over groups."""
    a, across, inverse, g, right, held = split(groups, k, own, damping)
    back = across @ inverse
    a = (a - back @ across.transpose(0, 2, 1)).sum(axis=0)
    return a, (g - (back @ right[:, :, None])[:, :, 0]).sum(axis=0), float(groups["loss"].sum() + held.sum())


def own_steps(groups: pd.DataFrame, k: int, own: list[Unknown], damping: float, shift: np.ndarray) -> np.ndarray:
    _, across, inverse, _, right, _ = split(groups, k, own, damping)
    step = -(inverse @ (right + shift @ across)[:, :, None])[:, :, 0]
    return clipped(np.stack(groups["own"]) + step, own)
