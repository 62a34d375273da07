"""Solvers over overlapping windows of rows: a clip of any length is many windows, solved side by side.

Rows get their place in a segment from counts per stretch of time, so no task numbers a whole clip. A
window owns `core` rows and also sees `overlap` rows to either side, which a solver of short memory needs
for the rows that it owns. Many windows come to a solver in one call, as flat arrays with offsets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A stretch of time within which rows are numbered together: ten days in microseconds.
STRETCH = 864_000_000_000


def placed(df: DataFrame, keys: list[str], order: list[str], stretch: int = STRETCH) -> DataFrame:
    """The rows with `place`, 0, 1, ... in order within the keys. The first of `order` is the time."""
    df = df.withColumn("__stretch", F.floor(F.col(order[0]) / stretch).cast("long"))
    counts = df.groupBy(*keys, "__stretch").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*keys).orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(*keys, "__stretch", F.coalesce(before, F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy(*keys, "__stretch").orderBy(*order)) - 1
    return df.join(starts, [*keys, "__stretch"]).withColumn("place", (F.col("__start") + inside).cast("long")).drop("__stretch", "__start")


def windows_of(df: DataFrame, keys: list[str], order: list[str], columns: list[str], core: int, overlap: int, stretch: int = STRETCH) -> DataFrame:
    """(keys, window, rows): every window that owns rows, with its rows in order; each row's `owned`."""
    place, own = F.col("place"), F.floor(F.col("place") / core)
    seen = F.sequence(F.floor((place - overlap) / core).cast("long"), F.floor((place + overlap) / core).cast("long"))
    rows = placed(df, keys, order, stretch).withColumn("window", F.explode(seen)).filter("window >= 0")
    row = F.struct("place", (own == F.col("window")).alias("owned"), *order, *[F.col(c).cast("double").alias(f"value_{i}") for i, c in enumerate(columns)])
    return rows.groupBy(*keys, "window").agg(F.sort_array(F.collect_list(row)).alias("rows")).filter(F.exists("rows", lambda x: x.owned))


def solve_windows(
    df: DataFrame, keys: list[str], order: list[str], columns: list[str], out: list[str], solve: Callable[..., list[np.ndarray]],
    core: int, overlap: int, stretch: int = STRETCH,
) -> DataFrame:
    """Every row (keys, order) with the columns of `out`.

    solve(offsets, *columns) gets the rows of many windows one after another, nulls as NaN, and
    returns an array over these rows for each column of `out`; NaN is null. Keys must not be null.
    """
    windows = windows_of(df, keys, order, columns, core, overlap, stretch)
    kinds = [f"{c} {df.schema[c].dataType.simpleString()}" for c in (*keys, *order)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["rows"]
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
            offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)
            rows = lists.flatten()
            values = [rows.field(f"value_{i}").to_numpy(zero_copy_only=False).astype(float) for i in range(len(columns))]
            found = solve(offsets, *values)
            at = np.flatnonzero(rows.field("owned").to_numpy(zero_copy_only=False))
            which = np.repeat(np.arange(len(lengths)), lengths)[at]
            made = [batch[k].take(pa.array(which)) for k in keys] + [rows.field(c).take(pa.array(at)) for c in order]
            made += [pa.array(x[at], from_pandas=True) for x in found]
            yield pa.RecordBatch.from_arrays(made, [*keys, *order, *out])

    return windows.drop("window").mapInArrow(run, ", ".join([*kinds, *[f"{c} double" for c in out]]))


def alike(offsets: np.ndarray, most: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Windows of about one length together: (index (windows, rows) into the flat arrays, mask of the
    rows that exist, which windows). Rows beyond a window's end repeat its last one."""
    lengths = np.diff(offsets)
    order = np.argsort(lengths, kind="stable")
    i = 0
    while i < len(order):
        size = int(lengths[order[i]])
        j = i + 1
        while j < len(order) and lengths[order[j]] <= size * 1.25 + 8 and (j - i + 1) * lengths[order[j]] <= most:
            j += 1
        part = order[i:j]
        reach = np.arange(int(lengths[part[-1]]))
        mask = reach < lengths[part][:, None]
        yield offsets[part][:, None] + np.minimum(reach, lengths[part][:, None] - 1), mask, part
        i = j


def equally_long(offsets: np.ndarray, most: int = 1 << 16) -> Iterator[np.ndarray]:
    """Windows of one length together: index (windows, rows) into the flat arrays."""
    lengths = np.diff(offsets)
    for size in np.unique(lengths):
        starts, some = offsets[:-1][lengths == size], max(1, most // max(int(size), 1))
        for i in range(0, len(starts), some):
            yield starts[i : i + some, None] + np.arange(size)
