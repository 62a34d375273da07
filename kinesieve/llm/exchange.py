"""Corpus-wide look-ups by chunk: every chunk asks once for each of its distinct 64-bit keys.

A chunk is a bounded piece of the corpus. It sends its distinct keys, sorted and cut into
buckets, each with a small value (a count, say). Spark shuffles the pieces by bucket, where the
values of equal keys are combined, and shuffles the answers back by chunk. However often a key
occurs, it is sent once per chunk, so frequent keys make no hot task, and tasks hold one bucket
or one chunk at a time. The number of buckets follows the size of the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinesieve.llm.kernels import U64, mix

REQUEST = "chunk long, bucket int, n long, keys binary, vals binary"
REPLY = "chunk long, bucket int, reply binary"


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(column))).first()[0] or 0


def bucket_count(size: int, per_bucket: int = 2 << 20, least: int = 32) -> int:
    return max(least, -(-size // per_bucket))


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as compressed differences."""
    steps = np.diff(keys, prepend=U64(0))
    return zstandard.compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpack_sorted(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(blob), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, -1).T).view(U64).ravel(), dtype=U64)


def pack(values: np.ndarray, level: int = 1) -> bytes:
    return zstandard.compress(np.ascontiguousarray(values).tobytes(), level)


def unpack(blob: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(blob), dtype)


def by_hash(keys: np.ndarray, n_buckets: int) -> np.ndarray:
    return (mix(keys) % U64(n_buckets)).astype(np.int64)


def cut(keys: np.ndarray, n_buckets: int, place: Callable = by_hash) -> tuple[np.ndarray, np.ndarray]:
    """The order that puts sorted keys into buckets (sorted in each), and the buckets' bounds."""
    at = place(keys, n_buckets)
    order = np.argsort(at, kind="stable")
    return order, np.searchsorted(at[order], np.arange(n_buckets + 1))


def requests(chunk: int, keys: np.ndarray, vals: np.ndarray, n_buckets: int, place: Callable = by_hash) -> Iterator[tuple]:
    """Rows of REQUEST for the sorted distinct keys of a chunk."""
    order, bounds = cut(keys, n_buckets, place)
    keys, vals = keys[order], vals[order]
    for b in range(n_buckets):
        i, j = bounds[b], bounds[b + 1]
        if j > i:
            yield chunk, b, int(j - i), pack_sorted(keys[i:j]), pack(vals[i:j])


def aligned(replies: dict[int, np.ndarray], keys: np.ndarray, n_buckets: int, place: Callable = by_hash, dtype=np.float32) -> np.ndarray:
    """The answers in the order of the sorted keys that requests() was given."""
    order, bounds = cut(keys, n_buckets, place)
    out = np.zeros(len(keys), dtype)
    for b, values in replies.items():
        out[order[bounds[b] : bounds[b + 1]]] = values
    return out


def answer(asked: DataFrame, val_dtype, combine: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """One REPLY row for every REQUEST row.

    combine(keys, which, vals) gets a bucket's distinct sorted keys, and for each single request
    the position of its key and its value; it returns an array with one answer for each key.
    """

    def reduce(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = np.concatenate([unpack_sorted(x) for x in pdf["keys"]])
        vals = np.concatenate([unpack(x, val_dtype) for x in pdf["vals"]])
        distinct, which = np.unique(keys, return_inverse=True)
        answers = combine(distinct, which, vals)[which]
        ends = np.cumsum(pdf["n"].to_numpy())
        parts = np.split(answers, ends[:-1])
        return pd.DataFrame({"chunk": pdf["chunk"], "bucket": pdf["bucket"], "reply": [pack(x) for x in parts]})

    return asked.groupBy("bucket").applyInPandas(reduce, REPLY)
