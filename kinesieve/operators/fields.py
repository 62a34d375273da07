"""Polynomial fields over a picture, frame by frame, and what of them jitters.

A frame's field is a robust fit of displacements (dx, dy) at positions (x, y) by a polynomial, from sums per
frame. The coefficients are velocities; summed over time they are paths, of which a band between two
frequencies is kept. Two fits from halves of the rows tell how much of that is noise: each coefficient is
shrunk by the share of power that the halves do not agree on. Where a frame had few rows, and at the ends of a
run, the field fades out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinesieve.operators.corrections import averaged
from kinesieve.operators.fits import Unknown, fit_groups
from kinesieve.operators.solve import rebuilt_velocity, zero_phase4
from kinesieve.operators.windows import STRETCH, solve_windows


def terms(order: int) -> list[tuple[int, int]]:
    """Powers of x and y, constant first, lower orders before higher ones."""
    return [(n - j, j) for n in range(order + 1) for j in range(n + 1)]


def basis(x: Column, y: Column, order: int, size: float) -> list[Column]:
    """The polynomial's terms at a position, in units of `size`."""
    power = lambda v, n: F.lit(1.0) if n == 0 else v / size if n == 1 else F.pow(v / size, n)
    return [power(x, i) * power(y, j) for i, j in terms(order)]


def value(coefficients: Column, phi: list[Column], axis: int) -> Column:
    """A field's displacement along an axis: coefficients are those of x, then those of y."""
    out = coefficients[axis * len(phi)] * phi[0]
    for i in range(1, len(phi)):
        out = out + coefficients[axis * len(phi) + i] * phi[i]
    return out


def fit_fields(rows: DataFrame, keys: list[str], order: int, size: float, c: float, rounds: int = 6) -> DataFrame:
    """(keys, n, field): the field of each group of rows (x, y, dx, dy); displacements further than `c` from
    it count less. Rows with a missing or not finite number take no part."""
    phi = basis(F.col("x"), F.col("y"), order, size)
    both = [Unknown(f"{axis}{i}", step=1.0) for axis in "xy" for i in range(len(phi))]

    def model(v: list[Column]) -> list[Column]:
        k = len(phi)
        return [F.col(d) - sum((v[a * k + i] * phi[i] for i in range(1, k)), v[a * k] * phi[0]) for a, d in enumerate(("dx", "dy"))]

    found = fit_groups(rows, keys, model, both, c, rounds)
    return found.select(*keys, "n", F.when(F.col("n") > 0, F.col("best")).alias("field"))


@dataclass(frozen=True)
class Band:
    """`rate`: frames a second; the band kept; below `swap` Hz the direct estimates hold, above the sums
    of changes; `few`, `enough`: rows with which the field starts to show and shows in full."""

    rate: float = 60.0
    low: float = 1.5
    high: float = 12.0
    swap: float = 1.0
    few: float = 60.0
    enough: float = 200.0
    edge: float = 0.25
    noise_span: float = 1.0


def banded(speed: np.ndarray, change: np.ndarray, band: Band) -> np.ndarray:
    """The part of a coefficient's path within the band, one value a frame."""
    if len(speed) < 16:
        return np.zeros(len(speed))
    path = np.cumsum(rebuilt_velocity(speed, change, band.swap, band.rate))
    fast = path - zero_phase4(path, band.low, band.rate)
    return zero_phase4(fast, band.high, band.rate) if band.high < 0.475 * band.rate else fast


def shrinkage(signal: np.ndarray, noise: np.ndarray, half: int) -> np.ndarray:
    """Share of a signal's power around each frame that is not noise's, smooth over time."""
    power, lost = averaged(signal**2, half), averaged(noise**2, half)
    return averaged(np.clip(1 - lost / np.maximum(power, 1e-300), 0.0, 1.0), half)


def shown(support: np.ndarray, band: Band) -> np.ndarray:
    """How much of the field shows: by the rows around a frame, and less towards the ends of a run."""
    n = len(support)
    have = averaged(np.nan_to_num(support), max(1, round(0.25 * band.rate)))
    full = np.clip((have - band.few) / max(band.enough - band.few, 1e-9), 0.0, 1.0)
    end = np.minimum(np.arange(n), np.arange(n)[::-1]) / max(1, round(band.edge * band.rate))
    return full * (0.5 - 0.5 * np.cos(np.pi * np.minimum(end, 1.0)))


def solve_fields(
    frames: DataFrame, keys: list[str], order: list[str], count: int, band: Band, halves: bool = False, core: int = 4096, overlap: int = 1024, stretch: int = STRETCH,
) -> DataFrame:
    """(keys, order, field, shown) of every frame: the coefficients' paths within the band.

    frames(keys, order, speed, change, support[, first, second]): `count` coefficients of the field of a
    step and of its change against the step before (arrays, null where not measured), the rows they are from,
    and with `halves` the fields of two halves of these rows. Keys name a run of consecutive frames; runs of
    under 16 have no field.
    """
    names = ["speed", "change", *(["first", "second"] if halves else [])]
    flat = frames.select(*keys, *order, F.col("support").cast("double").alias("support"), *[F.col(n)[i].alias(f"{n}_{i}") for n in names for i in range(count)])
    columns = ["support", *[f"{n}_{i}" for n in names for i in range(count)]]

    def one(values: list[np.ndarray]) -> list[np.ndarray]:
        shows = shown(values[0], band)
        part = [values[1 + k * count : 1 + (k + 1) * count] for k in range(len(names))]
        half = max(1, round(band.noise_span * band.rate / 2))
        nothing = np.full(len(shows), np.nan)
        out = []
        for i in range(count):
            path = banded(part[0][i], part[1][i], band)
            if halves:
                noise = (banded(part[2][i], nothing, band) - banded(part[3][i], nothing, band)) / 2
                path = path * shrinkage(path, noise, half)
            out.append(path * shows)
        return [*out, shows]

    def solve(offsets: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
        runs = [one([v[i:j] for v in values]) for i, j in zip(offsets, offsets[1:])]
        return [np.concatenate(x) for x in zip(*runs)] if runs else [np.zeros(0)] * (count + 1)

    out = [f"field_{i}" for i in range(count)]
    solved = solve_windows(flat, keys, order, columns, [*out, "shown"], solve, core, overlap, stretch)
    return solved.select(*keys, *order, F.array(*out).alias("field"), "shown")


def on_grid(solved: DataFrame, width: float, height: float, across: int, down: int, order: int, size: float) -> DataFrame:
    """The field's displacement (dx, dy) at a grid's corners, which span the picture around its centre."""
    at = lambda n, i, span: F.lit(0.0) if n == 1 else (F.col(i) / (n - 1) - 0.5) * span
    rows = solved.withColumn("column", F.explode(F.sequence(F.lit(0), F.lit(across - 1)))).withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))
    phi = basis(at(across, "column", width), at(down, "row", height), order, size)
    return rows.withColumns({"dx": value(F.col("field"), phi, 0), "dy": value(F.col("field"), phi, 1)})


def similarity_part(field: Column, count: int) -> Column:
    """Of a first-order field, shift, turn and scale alone: the change along y follows that along x."""
    return F.array(field[0], field[1], -field[count + 1], field[count], field[count + 1], field[1])
