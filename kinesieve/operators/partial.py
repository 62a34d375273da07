"""Sums by group of what arrays of rows give, with partial sums in the tasks before the shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers of the sums that a task holds before it hands them on.
HELD = 1 << 23


def grouped(columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """(a row of each group, each row's group) of rows by equal keys."""
    code, kinds = np.zeros(len(columns[0]), np.int64), 1
    for column in columns:
        found = column.dictionary_encode()
        if kinds * len(found.dictionary) >= 1 << 31:
            _, code = np.unique(code, return_inverse=True)
            kinds = int(code.max(initial=0)) + 1
        code = code * len(found.dictionary) + found.indices.to_numpy(zero_copy_only=False)
        kinds *= len(found.dictionary)
    _, first, group = np.unique(code, return_index=True, return_inverse=True)
    return first, group


def added_up(keys: list[pa.Array], numbers: list[np.ndarray]) -> tuple[list[pa.Array], list[np.ndarray]]:
    """The sums of the numbers by equal keys."""
    first, group = grouped(keys)
    return [k.take(pa.array(first)) for k in keys], [np.bincount(group, x, len(first)) for x in numbers]


def merged(parts: list[tuple]) -> tuple[list[pa.Array], list[np.ndarray]]:
    """Sums of several batches by key."""
    if len(parts) == 1:
        return parts[0]
    keys = [pa.concat_arrays(x) for x in zip(*(part[0] for part in parts))]
    return added_up(keys, [np.concatenate(x) for x in zip(*(part[1] for part in parts))])


def added(rows: DataFrame, keys: list[str], count: int, parts: Callable[[list[np.ndarray]], tuple], more: dict[str, str] | None = None) -> DataFrame:
    """(keys, more, s0, s1, ...): `count` sums of each group. parts() gets the columns of many rows, those of keys
    left out, as arrays of numbers, and returns which rows take part and what each of these adds to the sums.

    It may name rows by their places instead, one as often as it likes, and return keys of its own beside them;
    `more` gives their names and kinds. A group of which no row takes part is missing. Keys must not be null.
    """
    more = more or {}
    names = [f"s{i}" for i in range(count)]
    values, most = [c for c in rows.columns if c not in keys], HELD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = 0, []  # `held`: groups of the first part, which was merged before
        for batch in batches:
            with np.errstate(all="ignore"):
                fine, found, *found_keys = parts([batch[c].to_numpy(zero_copy_only=False) for c in values])
            if fine.dtype == bool and not fine.all():
                fine = np.flatnonzero(fine)
            if not len(fine):
                continue
            own = [batch[c] if fine.dtype == bool else batch[c].take(pa.array(fine)) for c in keys]
            waiting.append(added_up([*own, *map(pa.array, found_keys)], found))
            if sum(len(x[1][0]) for x in waiting) >= max(2 * held, 1 << 16):
                waiting = [merged(waiting)]
                held = len(waiting[0][1][0])
                if held * count > most:
                    yield pa.RecordBatch.from_arrays([*waiting[0][0], *map(pa.array, waiting[0][1])], [*keys, *more, *names])
                    held, waiting = 0, []
        if waiting:
            found = merged(waiting)
            yield pa.RecordBatch.from_arrays([*found[0], *map(pa.array, found[1])], [*keys, *more, *names])

    kinds = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keys]
    found = rows.select(*keys, *values).mapInArrow(run, ", ".join([*kinds, *[f"`{c}` {kind}" for c, kind in more.items()], *[f"{c} double" for c in names]]))
    return found.groupBy(*keys, *more).agg(*[F.sum(c).alias(c) for c in names])
