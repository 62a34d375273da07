"""How a picture was rendered from another: a turn of the camera, its motion while rows were read, and a focal
length, as expressions; and a fit of these from matched points.

A source point's ray r was taken at its row's time tau (-1/2 to 1/2 of the readout). The render shows
f * x / z of Q (r + tau * (spin x r)), with the picture's centre added.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinesieve.functions.lens import project, unprojected
from kinesieve.functions.rotation import let, qconj, qexp, qmul, qrotate, vec
from kinesieve.operators.fits import Batched, Unknown, fit_groups
from kinesieve.operators.rotfit import fit_rotation
from kinesieve.sources.rounds import settled


def row_share(v: Column, height: float) -> Column:
    """When a row was read, in shares of the readout around its middle."""
    return (v + 0.5) / height - 0.5


def swept(ray: Column, spin: Column, tau: Column) -> Column:
    """The ray as it lies at the middle of the readout, to first order of the spin."""
    x, y, z = spin.y * ray.z - spin.z * ray.y, spin.z * ray.x - spin.x * ray.z, spin.x * ray.y - spin.y * ray.x
    return vec(ray.x + tau * x, ray.y + tau * y, ray.z + tau * z)


def turned_by(q: Column, v: Column) -> Column:
    """v turned by q, both named values: v + w t + u x t with t = 2 u x v, u the vector part of q."""
    cross = lambda a, b: vec(a.y * b.z - a.z * b.y, a.z * b.x - a.x * b.z, a.x * b.y - a.y * b.x)
    return let(cross(q, v), lambda h: let(cross(q, h), lambda k: vec(*[v[c] + 2 * (q.w * h[c] + k[c]) for c in "xyz"])))


def shown_at(ray: Column, tau: Column, q: Column, spin: Column, focal: Column, centre: tuple[float, float]) -> Column:
    """Where the render shows a ray; null behind its camera."""
    flat = lambda r: F.when(r.z > 1e-6, F.struct((focal * r.x / r.z + centre[0]).alias("u"), (focal * r.y / r.z + centre[1]).alias("v")))
    return let(swept(ray, spin, tau), lambda s: let(turned_by(q, s), flat))


def source_of(pixel: Column, lens: Column, q: Column, spin: Column, focal: Column, centre: tuple[float, float], height: float, steps: int = 6) -> Column:
    """The source point of a render's pixel: the row that it is read from depends on where it lies, and is
    found by going back and forth a few times."""
    ray = vec((pixel.u - centre[0]) / focal, (pixel.v - centre[1]) / focal, F.lit(1.0))

    def found(r: Column) -> Column:
        at = lambda tau: project(swept(r, spin, -tau), lens)
        tau = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(0.0), lambda t, _: row_share(at(t).v, height))
        return let(tau, at)

    return let(qrotate(qconj(q), ray), found)


def fit_render(matches: DataFrame, keys: list[str], lens: Column, height: float, centre: tuple[float, float], focal: float, c: float = 0.7, rounds: int = 10) -> DataFrame:
    """(keys, n, q, spin, focal, cost, move): the render model of each group of matches (source and render,
    structs of u and v). First a robust rotation between the rays, at the given focal length; then turn,
    spin and focal length together. Matches behind the camera or missing take no part.
    """
    seen = matches.filter("source is not null and render is not null")
    ray = F.pandas_udf(unprojected, "x double, y double, z double")(F.col("source.u"), F.col("source.v"), *[lens[k] for k in ("fx", "fy", "cx", "cy", "k1", "k2", "k3", "k4")])
    other = vec((F.col("render.u") - centre[0]) / focal, (F.col("render.v") - centre[1]) / focal, F.lit(1.0))
    rows = seen.select(*keys, "render", ray.alias("ray"), other.alias("other"), row_share(F.col("source.v"), height).alias("tau"))
    rows = settled(rows, "rays").filter((F.col("ray.z") > 0.08) & ~F.isnan("ray.z"))
    first = fit_rotation(rows, keys, "ray", "other", 4 * c / focal).select(*keys, F.col("q").alias("first"))
    first = settled(first, "first-turns")
    columns = {**{x: F.col(f"ray.{x}") for x in "xyz"}, "tau": F.col("tau"), "u": F.col("render.u"), "v": F.col("render.v"), **{f"first_{x}": F.col("first")[x] for x in "wxyz"}}
    unknowns = [*[Unknown(f"turn_{x}", step=1e-6) for x in "xyz"], *[Unknown(f"spin_{x}", step=1e-5, prior=0.0, sigma=0.1) for x in "xyz"], Unknown("scale", step=1e-6)]
    found = fit_groups(rows.drop("other").join(first, keys), keys, Batched(columns, left_over(focal, centre)), unknowns, c, rounds).join(first, keys)
    v = [F.col("best")[i] for i in range(7)]
    return found.select(*keys, "n", let(qexp(vec(v[0], v[1], v[2])), lambda e: qmul(e, F.col("first"))).alias("q"), vec(v[3], v[4], v[5]).alias("spin"), (focal * F.exp(v[6])).alias("focal"), "cost", "move")


def left_over(focal: float, centre: tuple[float, float]) -> Callable[[dict[str, np.ndarray], list[np.ndarray]], list[np.ndarray]]:
    """What shown_at() leaves over of matches, for many at once: the unknowns are a turn before the first one, spin
    and the logarithm of the focal length's share."""

    def residuals(m: dict[str, np.ndarray], values: list[np.ndarray]) -> list[np.ndarray]:
        turn, spin, ray = values[:3], values[3:6], [m[x] for x in "xyz"]
        angle = np.sqrt(sum(t * t for t in turn))
        share = np.where(angle > 0, np.sin(angle / 2) / np.where(angle > 0, angle, 1.0), 0.5)
        e, f = (np.cos(angle / 2), *[share * t for t in turn]), [m[f"first_{x}"] for x in "wxyz"]
        w = e[0] * f[0] - e[1] * f[1] - e[2] * f[2] - e[3] * f[3]
        q = [e[0] * f[i] + e[i] * f[0] + a - b for i, a, b in zip((1, 2, 3), *zip(*[(e[j] * f[k], e[k] * f[j]) for j, k in ((2, 3), (3, 1), (1, 2))]))]
        cross = lambda a, b: [a[j] * b[k] - a[k] * b[j] for j, k in ((1, 2), (2, 0), (0, 1))]
        s = [r + m["tau"] * d for r, d in zip(ray, cross(spin, ray))]
        h = cross(q, s)
        x, y, z = (a + 2 * (w * b + d) for a, b, d in zip(s, h, cross(q, h)))
        scale = focal * np.exp(values[6]) / np.where(z > 1e-6, z, np.nan)
        return [m["u"] - scale * x - centre[0], m["v"] - scale * y - centre[1]]

    return residuals
