"""The time between two clocks, from what one sensor measured and what positions say.

Observations(keys, track, t, y, row, exposure) are positions along tracks; samples(keys, t, v) are what the
sensor's path predicts for them. An observation is read at t + offset + readout * row + slope * exposure, and a
track's step should be the gain times the sensor's step between the two readings. A coarse and a
fine sweep find the offset, a robust fit refines it together with readout, gain and slope, and blocks left out in
turn tell how far it can be trusted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinesieve.functions.rotation import let
from kinesieve.operators.fits import Packed, Unknown, damped_steps, fit_groups, matrices, sums
from kinesieve.operators.partial import added
from kinesieve.operators.solve import segment_starts, whole_segments
from kinesieve.sources.rounds import settled

#: What is known of an observation, the two of a step, and the columns of steps().
READ, SIDES, PACKED = ("t", "y", "row", "exposure"), ("was", "now"), ("n", "m", "numbers", "spans", "samples")
#: Steps in a row, and samples that leave a task at once.
TOGETHER, AT_ONCE = 64, 1 << 20


@dataclass(frozen=True)
class Timing:
    """Times in the unit of t. `reach`: how far the offset may lie from zero; `loss`: the residual from
    which on errors count less; `block`: length of the parts left out in turn."""

    reach: float
    loss: float
    block: float
    coarse: int = 20
    fine: int = 8
    rounds: int = 10
    least: int = 30
    contrast: float = 0.02


def ahead(x: np.ndarray, low: np.ndarray, high: np.ndarray, at: np.ndarray, after: bool) -> np.ndarray:
    """By rows: the first of the places [low, high) in x, sorted there, that is at or after `at` (or after it); high if none."""
    most, left = len(x) - 1, int((high - low).max(initial=0))
    while left:
        middle = (low + high) >> 1
        found = x[np.minimum(middle, most)]
        passed = (low < high) & ((found <= at) if after else (found < at))
        low, high = np.where(passed, middle + 1, low), np.where(passed, high, np.minimum(middle, high))
        left >>= 1
    return low


def with_samples(observations: DataFrame, samples: DataFrame, keys: list[str], reach: float, width: float) -> DataFrame:
    """Each observation with `near`, the samples within `reach` of it and one more to either side, if
    they lie within `width`. Joined by cells of time, each with the samples that its observations may look at.

    Observations are left out if no sample lies in the stretches of `width` that these limits fall in.
    """
    halo = reach + 2.01 * width
    cell = 4 * halo
    place = lambda t: F.floor(t / cell).cast("long")
    asked = observations.filter(" and ".join(f"`{c}` is not null" for c in [*keys, "track", "t"])).withColumn("t", F.col("t").cast("double")).filter(~F.isnan("t"))
    names, kinds = asked.columns, {f.name: f.dataType.simpleString() for f in asked.schema}
    held = samples.select(*keys, F.col("t").cast("double").alias("t"), F.col("v").cast("double").alias("__v")).filter("__v is not null and t is not null and not isnan(t)")
    held = held.withColumns({"__cell": F.explode(F.sequence(place(F.col("t") - halo), place(F.col("t") + halo))), "__seen": F.lit(False)})
    rows = asked.withColumns({"__cell": place(F.col("t")), "__seen": F.lit(True)}).unionByName(held, allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, starts in whole_segments(batches, [*keys, "__cell"]):
            t, v, seen = (batch[c].to_numpy(zero_copy_only=False) for c in ("t", "__v", "__seen"))
            cell_of = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
            count = np.bincount(cell_of[~seen], minlength=len(starts) - 1)
            at = np.flatnonzero(seen)
            low = np.array(starts)[cell_of[at]]  # a cell begins with its samples
            high, x = low + count[cell_of[at]], t[at]
            stretch = np.floor(t / width)
            first = ahead(stretch, low, high, np.floor((x - reach - width) / width), False)
            some = (first < high) & (stretch[np.minimum(first, len(t) - 1)] <= np.floor((x + reach + width) / width))
            at, low, high, x = at[some], low[some], high[some], x[some]
            begin, end = ahead(t, low, high, x - reach, False), ahead(t, low, high, x + reach, True)
            begin = begin - ((begin > low) & (t[np.maximum(begin - 1, 0)] >= x - reach - width))
            end = end + ((end < high) & (t[np.minimum(end, len(t) - 1)] <= x + reach + width))
            for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(np.cumsum(end - begin) // AT_ONCE)) + 1):
                if len(part):
                    yield pa.RecordBatch.from_arrays([*[batch[c].take(pa.array(at[part])) for c in names], lists(t, v, begin[part], end[part])], [*names, "near"])

    found = rows.repartition(*keys, "__cell").sortWithinPartitions(*keys, "__cell", "__seen", "t", "__v")
    return found.mapInArrow(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in names], "near array<struct<t: double, v: double>>"]))


def lists(t: np.ndarray, v: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """The samples from `begin` to `end` of each row as a list."""
    offsets = np.concatenate(([0], np.cumsum(end - begin)))
    taken = np.repeat(begin - offsets[:-1], end - begin) + np.arange(offsets[-1])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(t[taken]), pa.array(v[taken])], ["t", "v"]))


def read_at(near: Column, t: Column) -> Column:
    """The samples' value at a time, linear between them and held at the ends."""
    last = F.size(near)

    def between(i: Column) -> Column:
        return let(F.element_at(near, F.greatest(i, F.lit(1))), lambda a: let(F.element_at(near, F.least(i + 1, last)), lambda b: mixed(a, b)))

    def mixed(a: Column, b: Column) -> Column:
        return a.v + F.least(F.greatest(F.coalesce((t - a.t) / F.nullif(b.t - a.t, F.lit(0.0)), F.lit(0.0)), F.lit(0.0)), F.lit(1.0)) * (b.v - a.v)

    return F.when(last > 0, let(F.size(F.filter(near, lambda s: s.t <= t)), between))


def steps(observations: DataFrame, keys: list[str]) -> DataFrame:
    """Steps between consecutive observations of a track, up to `TOGETHER` of a clip in a row.

    (keys, n, m, numbers, spans, samples): n steps with the numbers of both observations and where their samples
    lie in the row's m ones, which are kept once, all as bytes.
    """
    order = [*keys, "track", *READ]
    kinds = ", ".join(f"`{c}` {observations.schema[c].dataType.simpleString()}" for c in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                rows = pa.concat_batches([*before, batch])
                before = [rows.slice(rows.num_rows - 1)]
                now = np.setdiff1d(np.arange(rows.num_rows), segment_starts(rows, [*keys, "track"]), assume_unique=True)
                if len(now):
                    yield packed(rows, now, keys)

    rows = observations.select(*keys, "track", *[F.col(c).cast("double").alias(c) for c in READ], "near")
    found = rows.repartition(*keys, "track").sortWithinPartitions(*order)
    return found.mapInArrow(run, f"{kinds}, n long, m long, numbers binary, spans binary, samples binary")


def packed(rows: pa.RecordBatch, now: np.ndarray, keys: list[str]) -> pa.RecordBatch:
    """The steps to the rows `now` from those before them, as rows of steps()."""
    clip = np.zeros(rows.num_rows, np.int64)
    clip[segment_starts(rows, keys)] = 1
    clip = np.cumsum(clip)[now]
    opens = np.flatnonzero(np.diff(clip, prepend=-1))
    within = np.arange(len(now)) - np.repeat(opens, np.diff(opens, append=len(now)))
    first = np.flatnonzero(within % TOGETHER == 0)
    n = np.diff(first, append=len(now))
    row = np.repeat(np.arange(len(first)), n)
    numbers = np.stack([rows[c].to_numpy(zero_copy_only=False)[i] for i in (now - 1, now) for c in READ], axis=1)
    # each row's samples, once: of the observations of its steps
    of, read = np.divmod(np.unique(np.concatenate([row * rows.num_rows + now - 1, row * rows.num_rows + now])), rows.num_rows)
    near = rows["near"]
    size = near.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    start = np.cumsum(size) - size
    count = size[read]
    ends = np.cumsum(count)
    taken = np.repeat(start[read] - ends + count, count) + np.arange(count.sum())
    own = near.flatten()
    t, v = (own.field(c).to_numpy(zero_copy_only=False)[taken] for c in ("t", "v"))
    group = np.repeat(of, count)
    sort = np.lexsort((v, t, group))
    new = np.ones(len(sort), bool)
    new[1:] = (group[sort[1:]] != group[sort[:-1]]) | (t[sort[1:]] != t[sort[:-1]]) | (v[sort[1:]] != v[sort[:-1]])
    place = np.empty(len(sort), np.int64)
    place[sort] = np.cumsum(new) - 1
    kept = sort[new]
    m = np.bincount(group[kept], minlength=len(first))
    begin = np.cumsum(m) - m
    low, high = np.zeros(len(read), np.int64), np.zeros(len(read), np.int64)
    some = count > 0
    low[some] = place[ends[some] - count[some]] - begin[of[some]]
    high[some] = place[ends[some] - 1] + 1 - begin[of[some]]
    at = [np.searchsorted(of * rows.num_rows + read, row * rows.num_rows + i) for i in (now - 1, now)]
    spans = np.stack([x[i] for i in at for x in (low, high)], axis=1).astype(np.int32)
    bytes_of = lambda x, size: pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.concatenate(([0], np.cumsum(size))).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))])
    fields = [rows[c].take(pa.array(now[first])) for c in keys]
    held = bytes_of(np.stack([t[kept], v[kept]], axis=1), m * 16)
    return pa.RecordBatch.from_arrays([*fields, pa.array(n), pa.array(m), bytes_of(numbers, n * 64), bytes_of(spans, n * 16), held], [*keys, *PACKED])


def opened(columns: list[np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The arrays of many rows of steps(), one after another, and each step's row."""
    n, m = (x.astype(np.int64) for x in columns[:2])
    numbers, spans, samples = (np.frombuffer(b"".join(x), kind).reshape(-1, size) for x, kind, size in zip(columns[2:], (np.float64, np.int32, np.float64), (8, 4, 2)))
    row = np.repeat(np.arange(len(n)), n)
    places = spans.T + (np.cumsum(m) - m)[row]
    own = {f"{side}_{c}": x for (side, c), x in zip([(side, c) for side in SIDES for c in READ], np.ascontiguousarray(numbers.T))}
    own |= {f"{side}_{c}": x for (side, c), x in zip([(side, c) for side in SIDES for c in ("low", "high")], places)}
    return own | {"at": np.ascontiguousarray(samples[:, 0]), "v": np.ascontiguousarray(samples[:, 1])}, row


def read_all(at: np.ndarray, v: np.ndarray, low: np.ndarray, high: np.ndarray, t: np.ndarray) -> np.ndarray:
    """As read_at(), by rows: from the samples `low` to `high` of sorted times."""
    if not len(at):
        return np.full(len(t), np.nan)
    first = ahead(at, low, high, t, True)
    a, b = np.minimum(np.maximum(first - 1, low), len(at) - 1), np.maximum(np.minimum(first, high - 1), 0)
    wide = at[b] - at[a]
    share = np.where(wide != 0, (t - at[a]) / np.where(wide != 0, wide, 1.0), 0.0)
    return np.where(low < high, v[a] + np.minimum(np.maximum(share, 0.0), 1.0) * (v[b] - v[a]), np.nan)


def residuals(own: dict[str, np.ndarray], values: list) -> list[np.ndarray]:
    """Of each step what the sensor's one leaves."""
    offset, readout, gain, slope = values

    def read(side: str) -> np.ndarray:
        t = own[f"{side}_t"] + offset + readout * own[f"{side}_row"] + slope * own[f"{side}_exposure"]
        return read_all(own["at"], own["v"], own[f"{side}_low"], own[f"{side}_high"], t)

    return [own["now_y"] - own["was_y"] - (1 + gain) * (read("now") - read("was"))]


def sweep(rows: DataFrame, keys: list[str], centre: Column, span: float, points: int, loss: float) -> DataFrame:
    """(keys, x, interior, lowest, usual): the offset with the lowest mean loss on a grid around
    `centre`, refined by the parabola through its neighbours."""
    places = np.arange(-points, points + 1)
    count = len(places) + 1

    def parts(columns: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        own, row = opened(columns[:-1])
        lost = np.zeros((count, len(columns[0])))
        middle, fine = columns[-1][row], True
        for i, place in enumerate(places):
            r = residuals(own, [middle + place * (span / points), 0.0, 0.0, 0.0])[0]
            fine = np.abs(r) < 1e300  # the same steps at every place
            lost[i] = np.bincount(row[fine], np.log1p(r[fine] * r[fine] / loss**2), len(columns[0]))
        lost[-1] = np.bincount(row[fine], minlength=len(columns[0]))
        return np.ones(len(columns[0]), bool), list(lost)

    def lowest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        order = np.lexsort((places, np.abs(places)))  # of equal costs the one nearest to the centre
        for pdf in batches:
            n = pdf[f"s{count - 1}"].to_numpy()
            cost = pdf[[f"s{i}" for i in range(count - 1)]].to_numpy() / np.where(n > 0, n, np.nan)[:, None]
            best = order[np.argmin(cost[:, order], axis=1)]
            sides = np.pad(cost, ((0, 0), (1, 1)), constant_values=np.nan)
            left, here, right = (sides[np.arange(len(n)), best + i] for i in range(3))
            bend = left - 2 * here + right
            shift = np.where(bend > 0, np.clip((left - right) / np.where(bend > 0, 2 * bend, 1.0), -1.0, 1.0), 0.0)
            x = pdf["__centre"].to_numpy() + (places[best] + shift) * (span / points)
            yield pdf[keys].assign(x=x, interior=~np.isnan(bend), lowest=here, usual=np.median(cost, axis=1))

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keys)
    costs = added(rows.select(*keys, *PACKED, centre.alias("__at"), centre.alias("__centre")), [*keys, "__centre"], count, parts)
    return costs.mapInPandas(lowest, f"{kinds}, x double, interior boolean, lowest double, usual double")


def fit_timing(observations: DataFrame, samples: DataFrame, keys: list[str], timing: Timing, width: float) -> DataFrame:
    """(keys, n, coarse, fine, offset, readout, gain, slope, sigma, accepted) of each clip.

    sigma: the offset's standard error by leaving out blocks of time in turn. An offset is accepted if both
    sweeps have their lowest point inside, the coarse one stands out by `contrast`, there are `least`
    steps, and the offset is over twice its error. Missing observations are left out before.
    """
    known = observations.filter("t is not null and y is not null").withColumns({"row": F.coalesce("row", F.lit(0.0)), "exposure": F.coalesce("exposure", F.lit(0.0))})
    rows = settled(steps(with_samples(known, samples, keys, timing.reach * 2, width), keys), "timing")
    coarse = sweep(rows, keys, F.lit(0.0), timing.reach, timing.coarse, timing.loss)
    coarse = settled(coarse, "coarse")
    near = rows.join(coarse.select(*keys, F.col("x").alias("__x")), keys)
    fine = settled(sweep(near, keys, F.col("__x"), 2 * timing.reach / timing.coarse, timing.fine, timing.loss), "fine")
    wide = timing.reach * 1.5
    unknowns = [
        Unknown("offset", step=timing.reach / 500, low=-wide, high=wide),
        Unknown("readout", step=timing.reach / 200, prior=0.0, sigma=timing.reach / 2, low=-wide, high=wide),
        Unknown("gain", step=1e-3, prior=0.0, sigma=0.03, low=-0.2, high=0.2),
        Unknown("slope", step=1e-2, prior=0.0, sigma=0.5, low=-2.0, high=2.0),
    ]
    zero = F.lit(0.0)
    model = Packed({c: F.col(c) for c in PACKED}, opened, residuals)
    starts = fine.select(*keys, F.array(F.col("x"), zero, zero, zero).alias("x"))
    fitted = fit_groups(rows, keys, model, unknowns, timing.loss, timing.rounds, starts)
    errors = left_out(rows, keys, fitted, model, unknowns, timing)
    out = fitted.join(coarse.select(*keys, F.col("x").alias("coarse"), F.col("interior").alias("in_coarse"), "lowest", "usual"), keys)
    out = out.join(fine.select(*keys, F.col("x").alias("fine"), F.col("interior").alias("in_fine")), keys).join(errors, keys, "left")
    offset = F.col("best")[0]
    stands_out = F.col("usual") - F.col("lowest") > timing.contrast * F.greatest("lowest", F.lit(1e-9))
    accepted = F.col("in_coarse") & F.col("in_fine") & stands_out & (F.col("n") >= timing.least) & (F.abs(offset) > 2 * F.col("sigma"))
    return out.select(
        *keys, "n", "coarse", "fine", offset.alias("offset"), F.col("best")[1].alias("readout"), F.col("best")[2].alias("gain"),
        F.col("best")[3].alias("slope"), "sigma", F.coalesce(accepted, F.lit(False)).alias("accepted"),
    )


def left_out(rows: DataFrame, keys: list[str], fitted: DataFrame, model: Packed, unknowns: list[Unknown], timing: Timing) -> DataFrame:
    """(keys, sigma): the jackknife error of the offset, from the equations with each block's taken out."""
    k = len(unknowns)
    known = rows.join(fitted.select(*keys, "best"), keys)
    block = lambda own: np.floor(own["now_t"] / timing.block).astype(np.int64)
    parts = sums(known, keys, model, [F.col("best")[i] for i in range(k)], unknowns, timing.loss, block)
    whole = fitted.select(*keys, F.col("a").alias("all_a"), F.col("g").alias("all_g"))
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keys)
    hold = np.diag([0.0 if u.prior is None else u.sigma**-2 for u in unknowns])

    def run(batches):
        for pdf in batches:
            if len(pdf):
                a = matrices(np.stack(pdf["all_a"]) - np.stack(pdf["a"]), k) + hold
                g = np.stack(pdf["all_g"]) - np.stack(pdf["g"])
                yield pdf[keys].assign(shift=damped_steps(a, g, np.zeros(len(pdf)))[:, 0])

    shifts = parts.join(whole, keys).mapInPandas(run, f"{kinds}, shift double")
    blocks = F.count("*")
    spread = F.sqrt(F.var_pop("shift") * (blocks - 1))
    return shifts.groupBy(*keys).agg(F.when(blocks >= 3, spread).alias("sigma"))
