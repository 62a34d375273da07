"""The rotation that best turns one set of directions into another, group by group.

The weighted sums of products of the two directions, nine numbers, are all that the best rotation
depends on: it is the eigenvector of the largest eigenvalue of a symmetric four by four matrix made from
them, found by squaring that matrix. So a fit is one aggregation with partial sums, and a few expressions
for each group; robust fits repeat it with weights by what the last one left over.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinesieve.functions.rotation import let, matrix_of, qlog, quat
from kinesieve.operators.partial import added
from kinesieve.sources.rounds import settled

AXES = ("x", "y", "z")
#: Each squaring doubles the number of correct digits once the largest eigenvalue leads.
SQUARINGS = 24


def product(a: Column, b: Column) -> Column:
    """Of two matrices of sixteen numbers by rows."""
    return F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: sum((a[F.floor(i / 4).cast("int") * 4 + k] * b[i % 4 + 4 * k] for k in range(1, 4)), a[F.floor(i / 4).cast("int") * 4] * b[i % 4]))


def scaled(a: Column) -> Column:
    """Divided by its largest number."""
    return let(F.greatest(F.array_max(F.transform(a, F.abs)), F.lit(1e-300)), lambda m: F.transform(a, lambda x: x / m))


def leading(a: Column) -> Column:
    """The eigenvector of the largest eigenvalue, which no other is near in size, as a quaternion."""
    power = F.aggregate(F.sequence(F.lit(1), F.lit(SQUARINGS)), scaled(a), lambda m, _: scaled(product(m, m)))

    def longest(p: Column) -> Column:
        columns = F.array(*[F.struct((p[j] * p[j] + p[4 + j] * p[4 + j] + p[8 + j] * p[8 + j] + p[12 + j] * p[12 + j]).alias("n"), *[p[4 * i + j].alias(f"c{i}") for i in range(4)]) for j in range(4)])
        return let(F.array_max(columns), lambda c: let(F.sqrt(c.n) * F.when(c.c0 < 0, -1.0).otherwise(1.0), lambda n: quat(*[c[f"c{i}"] / n for i in range(4)])))

    return let(power, longest)


def turned(m: dict[str, Column]) -> Column:
    """The unit quaternion of the rotation that turns a into b, from the sums m["xy"] = sum w a_x b_y and
    so on."""
    t = m["xx"] + m["yy"] + m["zz"]
    v = [m["yz"] - m["zy"], m["zx"] - m["xz"], m["xy"] - m["yx"]]
    rows = [[t, *v]]
    for i, p in enumerate(AXES):
        rows.append([v[i], *[m[p + q] + m[q + p] - (t if p == q else F.lit(0.0)) for q in AXES]])
    flat = F.array(*[c.cast("double") for r in rows for c in r])
    # added to the diagonal, this makes every eigenvalue positive and the largest one largest in size
    size = lambda k: F.aggregate(k, F.lit(0.0), lambda s, c: s + F.abs(c))
    return let(flat, lambda k: let(size(k), lambda s: leading(F.transform(k, lambda c, i: F.when(i % 5 == 0, c + s).otherwise(c)))))


def unit(v: list[np.ndarray]) -> list[np.ndarray]:
    size = np.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
    return [x / size for x in v]


def compared(rows: DataFrame, keys: list[str], found: DataFrame | None, c: float, quality: bool = False) -> DataFrame:
    """Sums over rows (keys, given, a_x .. b_z), weighted by how far b is from a as found(keys, q) turns it:
    (n, weight, nine products), or with `quality` (n, weight, of squared distances, inliers)."""
    if found is not None:
        turn = found.select(*keys, matrix_of(F.col("q")).alias("__m")).select(*keys, *[F.col("__m")[i].alias(f"__m{i}") for i in range(9)])
        rows = rows.join(turn, keys)

    def parts(columns: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        w, a, b = columns[0], unit(columns[1:4]), unit(columns[4:7])
        fine = (w > 0) & np.isfinite(sum(a)) & np.isfinite(sum(b))
        if not fine.all():
            columns, w, a, b = [x[fine] for x in columns], w[fine], [x[fine] for x in a], [x[fine] for x in b]
        r = np.zeros(len(w))
        if len(columns) > 7:
            m = columns[7:]
            r = sum((m[3 * i] * a[0] + m[3 * i + 1] * a[1] + m[3 * i + 2] * a[2] - b[i]) ** 2 for i in range(3))
            w = w / (1 + r / (c * c))
        if quality:
            return fine, [np.ones(len(w)), w, w * r, (np.sqrt(r) < 3 * c).astype(float)]
        return fine, [np.ones(len(w)), w, *[w * x * y for x in a for y in b]]

    return added(rows, keys, 4 if quality else 11, parts)


def best_turns(sums: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, q) from the sums of compared()."""
    named = sums.select(*keys, F.col("s0").cast("long").alias("n"), *[F.col(f"s{2 + 3 * i + j}").alias(p + q) for i, p in enumerate(AXES) for j, q in enumerate(AXES)])
    return named.select(*keys, "n", turned({p + q: F.col(p + q) for p in AXES for q in AXES}).alias("q"))


def fit_rotation(rows: DataFrame, keys: list[str], a: str, b: str, c: float, weight: str | None = None, rounds: int = 5) -> DataFrame:
    """(keys, n, q, rotvec, rms, inliers): per group the rotation from directions `a` to `b` (structs of
    x, y, z, of any length but zero), robust against single wrong ones: distances between unit vectors
    beyond `c` count less. rms: of the distances, weighted as in the fit; inliers: the share within 3 c.

    Rows with a null, zero or not finite direction take no part; a group without any is missing. Keys
    must not be null. Of less than two different directions some rotation is returned.
    """
    number = lambda x: F.coalesce(x.cast("double"), F.lit(float("nan")))
    parts = {f"__{name}{p}": F.col(v)[p] for name, v in (("a", a), ("b", b)) for p in AXES}
    given = F.lit(1.0) if weight is None else F.col(weight)
    own = rows.select(*keys, number(given).alias("__given"), *[number(v).alias(k) for k, v in parts.items()])
    found = settled(best_turns(compared(own, keys, None, c), keys), "rotations")
    for _ in range(rounds - 1):
        found = settled(best_turns(compared(own, keys, found, c), keys), "rotations")
    left = compared(own, keys, found, c, quality=True).select(*keys, F.sqrt(F.col("s2") / F.col("s1")).alias("rms"), (F.col("s3") / F.col("s0")).alias("inliers"))
    return found.join(left, keys).select(*keys, "n", "q", qlog(F.col("q")).alias("rotvec"), "rms", "inliers")
