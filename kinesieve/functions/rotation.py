"""Rotation algebra as column expressions: quaternions are struct<w,x,y,z>, vectors struct<x,y,z>.

Hamilton convention; x right, y down, z forward.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once: Spark would put a copy of it at each place that
    uses it, and expressions that build on each other would grow without end."""
    return F.transform(F.array(value), body)[0]


def quat(w: Column, x: Column, y: Column, z: Column) -> Column:
    return F.struct(w.alias("w"), x.alias("x"), y.alias("y"), z.alias("z"))


def vec(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), z.alias("z"))


def qmul(a: Column, b: Column) -> Column:
    return quat(
        a.w * b.w - a.x * b.x - a.y * b.y - a.z * b.z,
        a.w * b.x + a.x * b.w + a.y * b.z - a.z * b.y,
        a.w * b.y - a.x * b.z + a.y * b.w + a.z * b.x,
        a.w * b.z + a.x * b.y - a.y * b.x + a.z * b.w,
    )


def qconj(q: Column) -> Column:
    return quat(q.w, -q.x, -q.y, -q.z)


def qnorm(q: Column) -> Column:
    return F.sqrt(q.w * q.w + q.x * q.x + q.y * q.y + q.z * q.z)


def qnormalize(q: Column) -> Column:
    n = qnorm(q)
    return quat(q.w / n, q.x / n, q.y / n, q.z / n)


def qexp(v: Column) -> Column:
    """The unit quaternion of a rotation vector."""
    angle = F.sqrt(v.x * v.x + v.y * v.y + v.z * v.z)
    # the quotient is exact for any angle but zero, where half of the vector is left
    k = F.when(angle > 0, F.sin(angle / 2) / angle).otherwise(0.5)
    return quat(F.cos(angle / 2), k * v.x, k * v.y, k * v.z)


def qlog(q: Column) -> Column:
    """The shortest rotation vector of a unit quaternion."""
    sign = F.when(q.w < 0, -1.0).otherwise(1.0)
    s = F.sqrt(q.x * q.x + q.y * q.y + q.z * q.z)
    tiny = s < 1e-12
    k = F.when(tiny, F.lit(2.0)).otherwise(2 * F.atan2(s, F.abs(q.w)) / F.when(tiny, F.lit(1.0)).otherwise(s))
    return vec(sign * k * q.x, sign * k * q.y, sign * k * q.z)


def qrotate(q: Column, v: Column) -> Column:
    turned = qmul(qmul(q, quat(F.lit(0.0), v.x, v.y, v.z)), qconj(q))
    return vec(turned.x, turned.y, turned.z)


def qdot(a: Column, b: Column) -> Column:
    return a.w * b.w + a.x * b.x + a.y * b.y + a.z * b.z


def slerp(a: Column, b: Column, u: Column) -> Column:
    """From a to b along the shorter arc. Written with weights of a and b: a product of exponential
    and logarithm would repeat its parts thousandfold in one expression."""
    dot = qdot(a, b)
    angle = F.acos(F.least(F.abs(dot), F.lit(1.0)))
    tiny = F.abs(dot) > 1 - 1e-12
    scale = F.when(tiny, F.lit(1.0)).otherwise(F.sin(angle))
    wa = F.when(tiny, 1 - u).otherwise(F.sin((1 - u) * angle) / scale)
    wb = F.when(dot < 0, -1.0).otherwise(1.0) * F.when(tiny, u).otherwise(F.sin(u * angle) / scale)
    return quat(wa * a.w + wb * b.w, wa * a.x + wb * b.x, wa * a.y + wb * b.y, wa * a.z + wb * b.z)


def matrix_of(q: Column) -> Column:
    """Rotation matrix, nine values by rows."""
    w, x, y, z = q.w, q.x, q.y, q.z
    return F.array(
        1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y),
        2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x),
        2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y),
    )


def wrap_angle(a: Column) -> Column:
    """Into [-pi, pi)."""
    pi = 3.141592653589793
    return a + pi - F.floor((a + pi) / (2 * pi)) * (2 * pi) - pi


def smoothstep(x: Column) -> Column:
    t = F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    return t * t * (3 - 2 * t)


def ramp_weight(value: Column, low: float, high: float) -> Column:
    """Squared ramp from low to high; nothing for missing values."""
    t = F.least(F.greatest((value - low) / (high - low), F.lit(0.0)), F.lit(1.0))
    return F.coalesce(t * t, F.lit(0.0))


def temporal_weight(distance: Column, tau: float) -> Column:
    return 1 / (1 + F.abs(distance) / tau)


def cauchy_weight(residual: Column, c: float) -> Column:
    return 1 / (1 + (residual / c) * (residual / c))
