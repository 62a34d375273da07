import hashlib
from collections import Counter

import numpy as np
import pytest

from kinesieve.llm import bwt
from tests.conftest import TINY

SCHEMA = "doc_id long, text string"


def brute(rows, length=400):
    data = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(t[i : i + length] for _, t in data for i in range(len(t) - length + 1))
    out = []
    for d, t in data:
        gone = np.zeros(len(t) + 1, np.int64)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length if i + length <= len(t) else len(t)] -= 1
        mark = np.cumsum(gone)[: len(t)] > 0
        rest = bytes(np.frombuffer(t, np.uint8)[~mark])
        spans = int((np.diff(np.concatenate(([0], mark.astype(int)))) == 1).sum())
        out.append((d, len(t), int(mark.sum()), spans, hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **more):
    df = bwt.remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(3), **more)
    return sorted((tuple(r)[:5] for r in df.collect()), key=str)


def test_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{TINY}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(10_000 + d, t[:-200] + "x" + t[-150:]) for d, t in rows[:40]]
    assert run(spark, rows, chunk_bytes=100_000) == brute(rows)


def test_odd_texts(spark):
    rng = np.random.default_rng(3)
    some = "".join(rng.choice(list("abcdefgh "), 3000))
    rows = [(1, None), (2, ""), (3, "a" * 2000), (4, "ab" * 900), (5, some), (5, some), (None, some[100:505]), (7, some[:399]), (8, "x" + some[7:407] + "y"), (9, "é" * 450), (10, "a" * 401)]
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_many_edges(spark, seed):
    rng = np.random.default_rng(seed)
    base = "".join(rng.choice(list("abcd"), 6000))
    rows = []
    for d in range(60):
        i = int(rng.integers(0, 4000))
        part = list(base[i : i + int(rng.integers(300, 1900))])
        for _ in range(int(rng.integers(0, 3))):
            part[int(rng.integers(0, len(part)))] = "z"
        rows.append((d, "".join(rng.choice(list("efgh"), int(rng.integers(0, 300)))) + "".join(part)))
    assert run(spark, rows, chunk_bytes=5000) == brute(rows)
    both = bwt.remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(3), chunk_bytes=5000).collect()
    repeated = {n: {r[0] for r in brute(rows, n) if r[2]} for n in {250, *(r.common_bytes for r in both)} if n}
    # a repeated string of 250 bytes holds a whole phrase, and a common run is a repeated string
    assert repeated[250] <= {r.doc_id for r in both if r.common_bytes}
    assert all(r.doc_id in repeated[r.common_bytes] for r in both if r.common_bytes)


def test_empty_and_extra_columns(spark):
    assert run(spark, []) == []
    df = spark.createDataFrame([(1, "q" * 500, "a", 2)], SCHEMA + ", bucket string, chunk int")
    assert bwt.remove_repeats(df).collect()[0][:4] == (1, 500, 500, 1)


def test_merged_order_is_the_sorted_one(spark):
    """Names of blocks against the suffixes of all shards, sorted by their first phrases."""
    rng = np.random.default_rng(9)
    parts = ["".join(rng.choice(list("abcdefgh"), 700)) for _ in range(6)]
    texts = ["".join(parts[i] for i in rng.integers(0, 6, 4)) for _ in range(25)]
    rows = list(enumerate(texts))
    for passes in (1, 2, 4):
        parsed, now = bwt.merged_shards(spark.createDataFrame(rows, SCHEMA).repartition(3), 400, bwt.window_of(400), 8, 6000, passes)
        assert parsed.select("chunk").distinct().count() > 3
        before = {r.chunk: bwt.Shard.from_state(r["keys"]) for r in parsed.filter("bucket = -2").collect()}
        every = []
        for r in now.filter("bucket = -2").collect():
            shard, own = bwt.Shard.from_state(r["keys"]), before[r.chunk]
            for i in np.flatnonzero(shard.block >= 0).tolist():
                run = [tuple(own.symbol[:, j].tolist()) for j in range(i, i + passes)]
                every.append((run, int(shard.block[i]), int(shard.sizes[passes - 1, i])))
        assert len(every) > 100
        every.sort(key=lambda x: x[1])
        assert [x[0] for x in every] == sorted(x[0] for x in every)
        count = Counter(str(x[0]) for x in every)
        assert len({x[1] for x in every}) == len(count) and all(count[str(run)] == size for run, _, size in every)


def test_ids_beside_nulls(spark):
    big = (1 << 60) + 1
    df = spark.createDataFrame([(big, "a"), (None, "b"), (3, "c")], SCHEMA).coalesce(1)
    assert {r.doc_id for r in bwt.remove_repeats(df).collect()} == {big, None, 3}
