"""Render plans: for every output frame and row sample, the matrix from output rays to source rays.

A row is read at its own time within the frame's read-out, and over its exposure, so each row asks for the
camera's orientation at one or at many times. Orientations come from samples around each time. To split a
clip of any length, time is cut into cells. A frame belongs to one cell, which gets the samples as far as the frame's
rows reach, and the last sample before and the first one after these, carried from cell to cell in a
table of one row per cell.

Defined cases: outside of the samples the nearest one is held; samples without a time or a whole orientation count as absent;
frames without time, or of a clip without samples, have null matrices; frames without exposure are not averaged; of samples at
one time the one with the largest tie counts; rows without a clip have no plan; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinesieve.operators.orientation import product, turn_of
from kinesieve.operators.solve import whole_segments

#: Exposures in seconds from which averaging begins and is whole, and the longest that counts.
NONE_UP_TO, WHOLE_FROM, LONGEST = 0.0020, 0.0035, 0.05
#: Samples a second from which exposures are averaged at all, and how often the taps may double.
HIGH_RATE, DOUBLINGS = 500.0, 4
#: Order of a quaternion's numbers; the kind of a frame among the rows of a cell; times asked for at once.
QUATERNION, FRAME, TAPS_AT_ONCE = "wxyz", 9, 1 << 17


@dataclass(frozen=True)
class Clock:
    """How frame times map to sample times, and the camera's fixed turn against the sensor."""

    offset: float = 0.0
    skew: float = 0.0
    readout: float = 0.0
    turn: tuple[float, float, float] = (0.0, 0.0, 0.0)
    exposure_scale: float = 1.0


def averaged_time(exposure: Column) -> Column:
    """Seconds over which a row's orientation is averaged; short exposures not at all."""
    e = F.least(F.greatest(F.coalesce(F.nanvl(exposure, F.lit(0.0)), F.lit(0.0)), F.lit(0.0)), F.lit(LONGEST))
    return e * F.least(F.greatest((e - NONE_UP_TO) / (WHOLE_FROM - NONE_UP_TO), F.lit(0.0)), F.lit(1.0))


def tap_count(window: Column, taps: int, rate: float) -> Column:
    """`taps`, doubled until there is one for each sample of the window."""
    level = F.ceil(F.log2((F.ceil(window * rate) + 1) / F.lit(float(taps))))
    return (taps * F.pow(F.lit(2.0), F.least(F.greatest(level, F.lit(0)), F.lit(DOUBLINGS)))).cast("int")


def reach_of(clock: Clock) -> float:
    """Seconds of sensor time by which a row may ask for samples around its frame's time."""
    return (abs(clock.readout) + LONGEST * abs(clock.exposure_scale)) / 2 * abs(1 + clock.skew)


def dealt(cells: DataFrame, samples: DataFrame, key: str, time: Callable[[Column], Column], reach: float, cell: float) -> DataFrame:
    """(key, cell, t, tie, q): samples (key, t, tie, q) for each of `cells` (key, cell) that may look at them.

    A cell gets those within `reach` of it by time(t), and the last one before and the first one after these.
    Cells are `cell` long and should hold some thousand rows."""
    numbers = [F.col("t").cast("double"), *[F.col("q")[c].cast("double") for c in QUATERNION]]
    known = F.forall(F.array(*numbers), lambda x: x.isNotNull() & ~F.isnan(x)) & F.col(key).isNotNull()
    some = samples.filter(known).select(key, numbers[0].alias("t"), "tie", F.struct(*[x.alias(c) for x, c in zip(numbers[1:], QUATERNION)]).alias("q"))
    low, high = (F.floor((time(F.col("t")) + side * reach) / cell).cast("long") for side in (-1, 1))
    copies = some.withColumns({"low": low, "high": high}).withColumn("cell", F.explode(F.sequence("low", "high")))
    row = F.struct("t", "tie", "q")
    ends = copies.select(key, "cell", F.when(F.col("cell") == F.col("low"), row).alias("early"), F.when(F.col("cell") == F.col("high"), row).alias("late"), F.lit(False).alias("asked"))
    asked = cells.select(key, "cell", *[F.lit(None).cast(ends.schema[c].dataType).alias(c) for c in ("early", "late")], F.lit(True).alias("asked"))
    early = F.min_by("early", F.when(F.col("early").isNotNull(), F.struct("early.t", -F.col("early.tie"))))
    late = F.max_by("late", F.when(F.col("late").isNotNull(), F.struct("late.t", "late.tie")))
    ends = ends.unionByName(asked).groupBy(key, "cell").agg(early.alias("early"), late.alias("late"), F.max("asked").alias("asked"))
    by_cell = W.partitionBy(key).orderBy("cell")
    before = F.last("late", True).over(by_cell.rowsBetween(W.unboundedPreceding, -1))
    after = F.first("early", True).over(by_cell.rowsBetween(1, W.unboundedFollowing))
    carried = ends.select(key, "cell", "asked", F.array(before, after).alias("rows")).filter("asked").select(key, "cell", F.explode("rows").alias("row")).filter("row is not null")
    return copies.select(key, "cell", "t", "tie", "q").unionByName(carried.select(key, "cell", "row.*"))


def asking(frames: DataFrame, key: str, clock: Clock, rate: float, taps: int, cell: float) -> DataFrame:
    """Frames (key, cell, t, frame, span, n, q): the seconds over which a frame's rows are averaged, at how many times
    (0: not averaged), and the output's orientation."""
    timed = frames.select(
        key, F.nanvl("t", F.lit(None).cast("double")).alias("t"), "frame", (averaged_time(F.col("exposure")) * clock.exposure_scale).alias("span"),
        F.struct(*[F.col("virtual")[c].cast("double").alias(c) for c in QUATERNION]).alias("q"),
    ).filter(F.col(key).isNotNull() & F.col("frame").isNotNull())
    if rate >= HIGH_RATE:
        most = timed.groupBy(key).agg((F.max("span") * rate >= 1).alias("averages"))
        timed = timed.join(most, key).withColumn("n", F.when(F.col("averages"), tap_count(F.col("span"), taps, rate)).otherwise(0)).drop("averages")
    else:
        timed = timed.withColumn("n", F.lit(0))
    return timed.withColumn("cell", F.coalesce(F.floor((F.col("t") * (1 + clock.skew) + clock.offset) / cell).cast("long"), F.lit(0)))


@dataclass(frozen=True)
class Track:
    """Samples of many cells one after another: times, orientations (rows, 4), and where each cell's begin."""

    t: np.ndarray
    q: np.ndarray
    offsets: np.ndarray

    @classmethod
    def of(cls, rows: np.ndarray, cell: np.ndarray, t: np.ndarray, q: np.ndarray, cells: int) -> Track:
        """From sorted rows; of those at one time the last counts."""
        last = np.ones(len(rows), bool)
        last[:-1] = (t[rows[1:]] != t[rows[:-1]]) | (cell[rows[1:]] != cell[rows[:-1]])
        rows = rows[last]
        return cls(t[rows], q[rows], np.searchsorted(cell[rows], np.arange(cells + 1)))

    def at(self, cell: np.ndarray, t: np.ndarray) -> np.ndarray:
        """(rows, 4): the orientation between the samples around t, NaN where a cell has none."""
        out = np.full((len(t), 4), np.nan)
        some = (self.offsets[cell] < self.offsets[cell + 1]) & ~np.isnan(t)
        if not some.all():
            if some.any():
                out[some] = self.at(cell[some], t[some])
            return out
        low, high = self.offsets[cell], self.offsets[cell + 1]
        first, last, left = low, high - 1, int((high - low).max()) if len(t) else 0
        while left:  # low: how many samples are at or before t
            middle = (low + high) >> 1
            inside = (low < high) & (self.t[np.minimum(middle, last)] <= t)
            low, high = np.where(inside, middle + 1, low), np.where(inside, high, np.minimum(middle, high))
            left >>= 1
        a, b = np.maximum(low - 1, first), np.minimum(low, last)
        wide = self.t[b] - self.t[a]
        share = np.where(wide > 0, (t - self.t[a]) / np.where(wide > 0, wide, 1.0), 0.0)
        return slerped(self.q[a], self.q[b], share)


def slerped(a: np.ndarray, b: np.ndarray, u: np.ndarray) -> np.ndarray:
    """As rotation.slerp(), over rows."""
    dot = (a * b).sum(axis=1)
    angle = np.arccos(np.minimum(np.abs(dot), 1.0))
    tiny = np.abs(dot) > 1 - 1e-12
    scale = np.where(tiny, 1.0, np.sin(angle))
    wa = np.where(tiny, 1 - u, np.sin((1 - u) * angle) / scale)
    wb = np.where(dot < 0, -1.0, 1.0) * np.where(tiny, u, np.sin(u * angle) / scale)
    return wa[:, None] * a + wb[:, None] * b


def matrices(q: np.ndarray) -> np.ndarray:
    """Rotation matrices (rows, 3, 3) of quaternions of any length but zero."""
    with np.errstate(divide="ignore", invalid="ignore"):
        w, x, y, z = (q / np.sqrt((q * q).sum(axis=1))[:, None]).T
    entries = (
        1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y),
        2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x),
        2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y),
    )
    return np.stack(entries, axis=1).reshape(-1, 3, 3)


def cameras(samples: Track, corrections: Track | None, cell: np.ndarray, middle: np.ndarray, span: np.ndarray, n: np.ndarray, clock: Clock) -> np.ndarray:
    """(rows, 4): the camera's orientation at each row's middle if n is 0, else the sum of those at its n taps,
    each with the sign that is nearer to the middle's. Any length; NaN where there is none."""
    first = np.concatenate(([0], np.cumsum(n + 1)))
    row = np.repeat(np.arange(len(n)), n + 1)
    tap = np.arange(first[-1]) - first[row] - 1  # -1 is the middle
    seen = middle[row] + span[row] * np.where(tap >= 0, (tap + 0.5) / np.maximum(n[row], 1) - 0.5, 0.0)
    q = samples.at(cell[row], seen * (1 + clock.skew) + clock.offset)
    if any(clock.turn):
        q = product(q, turn_of(np.array([clock.turn], float)))
    if corrections is not None:
        more = corrections.at(cell[row], seen)
        q = np.where(np.isnan(more[:, :1]), q, product(q, more))
    sign = np.where((q * q[first[row]]).sum(axis=1) < 0, -1.0, 1.0)
    sign[(tap < 0) & (n[row] > 0)] = 0.0
    return np.add.reduceat(q * sign[:, None], first[:-1], axis=0)


def row_matrices(frames: DataFrame, samples: DataFrame, key: str, height: int, n_rows: int = 32, clock: Clock | None = None, rate: float = 0.0, taps: int = 9, corrections: DataFrame | None = None, cell: float = 8.0) -> DataFrame:
    """(key, frame, row, m): nine values by rows that take a ray of the output frame to the source's camera.

    frames: (key, frame, t, exposure, virtual), with `virtual` the output's orientation, one row per frame.
    samples: (key, t, tie, q) in sensor time, `rate` a second. corrections: the same in frame time; they
    turn the camera further.
    """
    if n_rows < 2:
        raise ValueError("a plan has at least two rows")
    clock = clock or Clock()
    reach = reach_of(clock) * 1.001 + cell / 100  # times are rounded
    asks = asking(frames, key, clock, rate, taps, cell)
    cells = asks.select(key, "cell")
    sides = [dealt(cells, samples, key, lambda t: t, reach, cell)]
    if corrections is not None:
        sides.append(dealt(cells, corrections, key, lambda t: t * (1 + clock.skew) + clock.offset, reach, cell))
    rows = asks.select(key, "cell", F.lit(FRAME).alias("kind"), "t", F.lit(None).cast("long").alias("tie"), "q", "frame", "span", "n")
    for kind, side in enumerate(sides):
        rows = rows.unionByName(side.withColumns({"kind": F.lit(kind), "tie": F.col("tie").cast("long")}), allowMissingColumns=True)
    rows = rows.select(key, "cell", "kind", "t", "tie", *[F.col("q")[c].alias(f"q{c}") for c in QUATERNION], "frame", "span", "n")
    at = (np.arange(n_rows) * ((height - 1) / (n_rows - 1)) + 0.5) / height - 0.5
    name, tables = rows.columns, len(sides)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, starts in whole_segments(batches, [key, "cell"]):
            column = {c: batch[c].to_numpy(zero_copy_only=False) for c in name if c not in (key, "cell", "frame")}
            cell_of = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
            t, q = column["t"].astype(float), np.stack([column[f"q{c}"] for c in QUATERNION], axis=1).astype(float)
            tracks = [Track.of(np.flatnonzero(column["kind"] == kind), cell_of, t, q, len(starts) - 1) for kind in range(tables)]
            asked = np.flatnonzero(column["kind"] == FRAME)
            ends = np.cumsum((column["n"][asked].astype(np.int64) + 1) * n_rows)
            for part in np.split(asked, np.flatnonzero(np.diff(ends // TAPS_AT_ONCE)) + 1):
                if len(part):
                    yield plan(batch, part, tracks, cell_of, t, q, column)

    def plan(batch: pa.RecordBatch, asked: np.ndarray, tracks: list[Track], cell_of: np.ndarray, t: np.ndarray, q: np.ndarray, column: dict[str, np.ndarray]) -> pa.RecordBatch:
        of = np.repeat(asked, n_rows)
        middle = t[of] + clock.readout * np.tile(at, len(asked))
        camera = cameras(tracks[0], tracks[1] if len(tracks) > 1 else None, cell_of[of], middle, column["span"][of], column["n"][of].astype(np.int64), clock)
        m = (np.swapaxes(matrices(camera), 1, 2) @ np.repeat(matrices(q[asked]), n_rows, axis=0)).reshape(-1, 9)
        lost = pa.array(np.isnan(m).any(axis=1))
        values = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * 9, pa.int32()), pa.array(m.ravel()), mask=lost)
        taken = pa.array(of)
        return pa.RecordBatch.from_arrays([batch[key].take(taken), batch["frame"].take(taken), pa.array(np.tile(np.arange(n_rows, dtype=np.int32), len(asked))), values], [key, "frame", "row", "m"])

    kinds = {c: frames.schema[c].dataType.simpleString() for c in (key, "frame")}
    return rows.repartition(key, "cell").sortWithinPartitions(key, "cell", "kind", "t", "tie").mapInArrow(run, f"{key} {kinds[key]}, frame {kinds['frame']}, row int, m array<double>")
