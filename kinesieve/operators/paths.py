"""Smooth paths under limits: the calmest path that stays within given distances of a measured one.

The path p of a measured x minimises, per row and axis,

    fidelity |p - x|^2 + speed |D1 p|^2 + bend |D2 p|^2 + jerk |D3 p|^2 + kinks |D2 p| + twitches |D3 p|

under linear limits on the distance, sides . (p - x) <= room, any number a row, which may join axes. |.|
is rounded off below `blunt`. A primal-dual interior-point method solves many windows at once; its
systems have a band of three rows, and are eliminated by blocks that touch only their neighbours.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from kinesieve.operators.solve import solve_systems
from kinesieve.operators.windows import STRETCH, alike, solve_windows

#: Coefficients of the first to third difference (fixed values).
DIFFERENCES = {1: (-1.0, 1.0), 2: (1.0, -2.0, 1.0), 3: (-1.0, 3.0, -3.0, 1.0)}
BAND = 3
#: Rows of a block of the elimination; from so many windows on rows are eliminated one by one over all of them.
ROWS, MANY = 12, 8
#: Room of a locked row, and of a row without limit.
LOCKED, FREE = 1e-3, 1e6


@dataclass(frozen=True)
class Calm:
    """Weights of a path's terms, and below which size an absolute difference counts as a square."""

    fidelity: float = 1e-3
    speed: float = 0.01
    bend: float = 1.0
    jerk: float = 10.0
    kinks: float = 0.0
    twitches: float = 0.0
    blunt: float = 0.01
    steps: int = 40


def difference(x: np.ndarray, k: int) -> np.ndarray:
    """The k-th difference along the rows of (windows, rows, axes)."""
    return np.diff(x, k, axis=1)


def transposed(y: np.ndarray, k: int, n: int) -> np.ndarray:
    """The difference operator's transpose, applied to values of n - k rows."""
    out = np.zeros((y.shape[0], n, y.shape[2]))
    for i, c in enumerate(DIFFERENCES[k]):
        out[:, i : n - k + i] += c * y
    return out


def add_band(bands: np.ndarray, weight: np.ndarray, k: int) -> None:
    """Adds D' diag(weight) D to bands (windows, axes, BAND + 1, rows); [b, i] is the entry (i, i - b)."""
    c, n = DIFFERENCES[k], bands.shape[3]
    w = np.moveaxis(weight, 2, 1)
    for b in range(k + 1):
        for i in range(k + 1 - b):
            bands[:, :, b, i + b : n - k + i + b] += c[i] * c[i + b] * w


def eliminate(bands: np.ndarray, joint: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Solves (band per axis + joint (windows, rows, axes, axes) per row) x = right, for each window."""
    count, n, d = right.shape
    if count >= MANY:
        return eliminate_rows(bands, joint, right)
    m, more = ROWS * d, -n % ROWS
    blocks = (n + more) // ROWS
    wide = np.concatenate((bands, np.zeros((*bands.shape[:3], more))), axis=3).reshape(count, d, BAND + 1, blocks, ROWS)
    own, before = np.zeros((count, blocks, ROWS, d, ROWS, d)), np.zeros((count, blocks, ROWS, d, ROWS, d))
    at = np.arange(ROWS)
    for a in range(d):
        for b in range(BAND + 1):
            own[:, :, at[b:], a, at[b:] - b, a] = own[:, :, at[b:] - b, a, at[b:], a] = wide[:, a, b, :, b:]
            before[:, :, at[:b], a, ROWS + at[:b] - b, a] = wide[:, a, b, :, :b]
    pad = np.broadcast_to(np.eye(d), (count, more, d, d))
    own[:, :, at, :, at, :] += np.moveaxis(np.concatenate((joint, pad), axis=1).reshape(count, blocks, ROWS, d, d), 2, 0)
    own, before = own.reshape(count, blocks, m, m), before.reshape(count, blocks, m, m)
    known = np.concatenate((right, np.zeros((count, more, d))), axis=1).reshape(count, blocks, m, 1)
    inverse = np.empty_like(own)
    inverse[:, 0] = np.linalg.inv(own[:, 0])
    for i in range(1, blocks):
        link = before[:, i] @ inverse[:, i - 1]
        known[:, i] -= link @ known[:, i - 1]
        inverse[:, i] = np.linalg.inv(own[:, i] - link @ np.swapaxes(before[:, i], 1, 2))
    out = np.empty_like(known)
    out[:, -1] = inverse[:, -1] @ known[:, -1]
    for i in range(blocks - 2, -1, -1):
        out[:, i] = inverse[:, i] @ (known[:, i] - np.swapaxes(before[:, i + 1], 1, 2) @ out[:, i + 1])
    return out.reshape(count, blocks * ROWS, d)[:, :n]


def eliminate_rows(bands: np.ndarray, joint: np.ndarray, right: np.ndarray) -> np.ndarray:
    """As eliminate(), row by row over all windows at once: a row's axes are neighbours in one band."""
    count, n, d = right.shape
    wide = np.zeros((BAND * d + 1, n * d, count))
    for b in range(BAND + 1):
        wide[b * d] = bands[:, :, b].transpose(2, 1, 0).reshape(n * d, count)
    for a in range(d):
        for b in range(a + 1):
            wide[a - b, a::d] += joint[:, :, a, b].T
    out = solve_systems(wide, right.reshape(count, n * d).T[:, None])
    return out[:, 0].T.reshape(count, n, d)


def terms(calm: Calm, x: np.ndarray, u: np.ndarray, trust: np.ndarray, inside: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Gradient of the objective at x + u, and the bands of a curvature that bounds it."""
    count, n, d = u.shape
    bands = np.zeros((count, d, BAND + 1, n))
    bands[:, :, 0] += np.moveaxis(trust, 2, 1)
    slope = trust * u
    for k, square, absolute in ((1, calm.speed, 0.0), (2, calm.bend, calm.kinks), (3, calm.jerk, calm.twitches)):
        if n > k and square + absolute > 0:
            y = difference(x + u, k)
            weight = 2 * square + absolute / np.sqrt(y * y + calm.blunt**2)
            weight = weight * inside[k]
            slope += transposed(weight * y, k, n)
            add_band(bands, weight, k)
    return slope, bands


def calm_path(x: np.ndarray, sides: np.ndarray, room: np.ndarray, mask: np.ndarray, known: np.ndarray, calm: Calm) -> tuple[np.ndarray, np.ndarray]:
    """The distance u = p - x and the limits' multipliers, for windows of n rows.

    x (windows, rows, axes); sides (windows, rows, limits, axes) and room (windows, rows, limits); mask:
    the rows that exist; known: those that were measured and so bind the path to them.
    """
    count, n, d = x.shape
    trust = np.repeat(np.where(known, 2 * calm.fidelity, 2e-9)[:, :, None], d, axis=2)
    inside = {k: (mask[:, k:] if n > k else mask[:, :0])[:, :, None].astype(float) for k in DIFFERENCES}
    u = np.zeros_like(x)
    slack = np.maximum(room, LOCKED)
    slope, _ = terms(calm, x, u, trust, inside)
    scale = np.maximum(np.abs(slope).max(axis=(1, 2)), 1e-6)[:, None, None]
    force = np.broadcast_to(scale * 0.1, slack.shape).copy()
    for step in range(calm.steps):
        slope, bands = terms(calm, x, u, trust, inside)
        gap = (slack * force).mean(axis=(1, 2))
        aim = 0.15 * gap[:, None, None]
        joint = np.einsum("wnca,wnc,wncb->wnab", sides, force / slack, sides)
        right = -slope - np.einsum("wnca,wnc->wna", sides, aim / slack)
        du = eliminate(bands, joint, right)
        ds = -np.einsum("wnca,wna->wnc", sides, du)
        dl = (aim - force * (slack + ds)) / slack
        reach = np.ones(count)
        for value, change in ((slack, ds), (force, dl)):
            with np.errstate(divide="ignore", invalid="ignore"):
                most = np.where(change < 0, -value / change, np.inf).min(axis=(1, 2))
            reach = np.minimum(reach, 0.99 * most)
        reach = reach[:, None, None]
        u, slack, force = u + reach * du, slack + reach * ds, force + reach * dl
        if step > 8 and np.abs(reach * du).max() < 1e-5 and gap.max() < 1e-9 * max(1.0, float(scale.max())):
            break
    return u, force


def bridged(x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Missing values of each window by linear interpolation, and which rows were not missing."""
    known = np.isfinite(x) & mask
    at = np.arange(x.shape[1])
    out = np.zeros_like(x)
    for row, good, values in zip(out, known, x):
        if good.any():
            row[:] = np.interp(at, at[good], values[good])
    return out, known


def box_sides(d: int) -> np.ndarray:
    """Limits (2 d, axes) of a box: each axis up and down."""
    return np.concatenate((np.eye(d), -np.eye(d)))


def limited(offsets: np.ndarray, values: list[np.ndarray], axes: int, sides: np.ndarray, calm: Calm) -> list[np.ndarray]:
    """The paths of many windows. values: the axes, then the room of each of `sides` (missing: no limit),
    then a lock (positive: the path stays where it was measured)."""
    out = [np.empty(len(values[0])) for _ in range(axes)]
    lock = values[-1]
    for index, mask, _ in alike(offsets):
        measured = [bridged(v[index], mask) for v in values[:axes]]
        x = np.stack([m[0] for m in measured], axis=2)
        known = np.logical_and.reduce([m[1] for m in measured])
        room = np.stack([np.nan_to_num(v[index], nan=FREE) for v in values[axes:-1]], axis=2)
        room = np.where(known[:, :, None], np.maximum(room, LOCKED), FREE)
        room = np.where((np.nan_to_num(lock[index]) > 0)[:, :, None] & known[:, :, None], LOCKED, room)
        whole = np.broadcast_to(sides, (*x.shape[:2], *sides.shape))
        u, _ = calm_path(x, whole, room, mask, known, calm)
        lost = ~known.any(axis=1)
        for a in range(axes):
            found = np.where(lost[:, None], np.nan, x[:, :, a] + u[:, :, a])
            out[a][index[mask]] = found[mask]
    return out


def plan_path(
    df: DataFrame, keys: list[str], order: list[str], axes: list[str], rooms: list[str], lock: str, out: list[str],
    sides: np.ndarray | None = None, calm: Calm = Calm(), core: int = 1024, overlap: int = 256, stretch: int = STRETCH,
) -> DataFrame:
    """Every row (keys, order) with its path, one column of `out` for each axis.

    rooms: for each of `sides` (a box if not given) the column that says how far the path may go
    that way; null is no limit, and under LOCKED (or where `lock` is positive) the path stays in place.
    Rows missing an axis are bridged and bind nothing; a segment without any is null. Windows of
    `core` rows see `overlap` rows beyond both ends: with a memory shorter than that, what they own
    is what the whole segment would give.
    """
    if sides is None:
        sides = box_sides(len(axes))
    columns = [*axes, *rooms, lock]
    return solve_windows(df, keys, order, columns, out, lambda offsets, *values: limited(offsets, list(values), len(axes), sides, calm), core, overlap, stretch)
