"""3 x 3 matrices as column expressions: arrays of nine doubles by rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinesieve.functions.rotation import let, quat, vec


def matmul(a: Column, b: Column) -> Column:
    return F.array(*(sum((a[3 * i + k] * b[3 * k + j] for k in (1, 2)), a[3 * i] * b[j]) for i in range(3) for j in range(3)))


def transpose(m: Column) -> Column:
    return F.array(*(m[3 * j + i] for i in range(3) for j in range(3)))


def matvec(m: Column, v: Column) -> Column:
    return vec(*(m[3 * i] * v.x + m[3 * i + 1] * v.y + m[3 * i + 2] * v.z for i in range(3)))


def skew(v: Column) -> Column:
    """The matrix whose product with u is the cross product of v and u."""
    nil = F.lit(0.0)
    return F.array(nil, -v.z, v.y, v.z, nil, -v.x, -v.y, v.x, nil)


def from_vector(v: Column, first: Column, second: Column) -> Column:
    """The identity plus `first` times the skew matrix of v plus `second` times its square."""
    x, y, z = v.x, v.y, v.z
    return F.array(
        1 - second * (y * y + z * z), second * x * y - first * z, second * x * z + first * y,
        second * x * y + first * z, 1 - second * (x * x + z * z), second * y * z - first * x,
        second * x * z - first * y, second * y * z + first * x, 1 - second * (x * x + y * y),
    )


def with_angle(v: Column, body) -> Column:
    """body(v, its length, the length's square)."""
    return let(v, lambda u: let(u.x * u.x + u.y * u.y + u.z * u.z, lambda square: let(F.sqrt(square), lambda angle: body(u, angle, square))))


def rodrigues(v: Column) -> Column:
    """The rotation matrix of a rotation vector."""

    def body(u: Column, angle: Column, square: Column) -> Column:
        some = angle > 1e-7
        s = F.when(some, F.sin(angle) / angle).otherwise(1 - square / 6)
        c = F.when(some, (1 - F.cos(angle)) / square).otherwise(0.5 - square / 24)
        return let(F.struct(s.alias("s"), c.alias("c")), lambda k: from_vector(u, k.s, k.c))

    return with_angle(v, body)


def right_jacobian_inverse(v: Column) -> Column:
    """Takes a small change of a rotation, made on its right, to the change of its rotation vector."""

    def body(u: Column, angle: Column, square: Column) -> Column:
        c = F.when(angle > 1e-4, (1 - angle / 2 / F.tan(angle / 2)) / square).otherwise(F.lit(1 / 12))
        return let(c, lambda k: from_vector(u, F.lit(0.5), k))

    return with_angle(v, body)


def quat_of_matrix(m: Column) -> Column:
    """The unit quaternion with w >= 0, from the largest of its four components, so that no quotient
    is of small numbers."""

    def body(m: Column, big: Column, trace: Column) -> Column:
        # one of the four is `big`; twice its component's square root divides the others
        half = F.sqrt(F.when(big == trace, 1 + trace).otherwise(1 + 2 * big - trace)) / 2
        a, b, c = m[7] - m[5], m[2] - m[6], m[3] - m[1]
        d, e, f = m[1] + m[3], m[2] + m[6], m[5] + m[7]

        def parts(h: Column) -> Column:
            k = 4 * h
            return (
                F.when(big == trace, F.array(h, a / k, b / k, c / k))
                .when(big == m[0], F.array(a / k, h, d / k, e / k))
                .when(big == m[4], F.array(b / k, d / k, h, f / k))
                .otherwise(F.array(c / k, e / k, f / k, h))
            )

        return let(half, parts)

    found = let(m, lambda m: let(m[0] + m[4] + m[8], lambda trace: let(F.greatest(trace, m[0], m[4], m[8]), lambda big: body(m, big, trace))))
    return let(found, lambda p: F.when(p[0] < 0, quat(-p[0], -p[1], -p[2], -p[3])).otherwise(quat(p[0], p[1], p[2], p[3])))


def view_change(focal: Column, cx: Column, cy: Column, m: Column) -> Column:
    """The homography of pixels under a rotation m of a pinhole camera: K m^T K^-1."""

    def body(m: Column) -> Column:
        # row i of the transpose is column i of m
        rows = [[focal * m[3 * j + i] + centre * m[3 * j + 2] for j in range(3)] for i, centre in ((0, cx), (1, cy))]
        rows.append([m[3 * j + 2] for j in range(3)])
        return F.array(*(x for a, b, c in rows for x in (a / focal, b / focal, c - (a * cx + b * cy) / focal)))

    return let(m, body)


def horizon_angles(m: Column, down: Column) -> Column:
    """(roll, elevation, g) of a camera-to-world matrix: g is `down` in the camera's axes."""
    return let(matvec(transpose(m), down), lambda u: F.struct(F.atan2(u.x, u.y).alias("roll"), F.asin(F.greatest(F.least(u.z, F.lit(1.0)), F.lit(-1.0))).alias("elevation"), u.alias("g")))


def roll_gradient(g: Column, floor: float = 0.04) -> Column:
    """How the roll angle follows a small turn of the camera; the square of the part of g across the
    axis counts as `floor` at least, as roll has no meaning straight down."""
    across = F.greatest(g.x * g.x + g.y * g.y, F.lit(floor))
    return let(across, lambda n: vec(-g.z * g.x / n, -g.z * g.y / n, F.lit(1.0)))
