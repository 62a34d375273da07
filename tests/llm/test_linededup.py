import time
from collections import defaultdict

import numpy as np

from kinesieve.llm import linededup
from tests.conftest import TINY

SCHEMA = "doc_id long, text string"


def brute(rows, least=40, docs=5):
    lower = str.maketrans(linededup.UPPER, linededup.LOWER)
    key = lambda x: x.strip(linededup.BLANKS).translate(lower)
    held = defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            if d is not None and len(key(x)) >= least:
                held[key(x)].add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if d is None or len(held[key(x)]) < docs or max(held[key(x)]) == d]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept) if len(kept) < len(lines) else t))
    return sorted(out, key=str)


def run(spark, rows):
    df = linededup.filter_lines(spark.createDataFrame(rows, SCHEMA).repartition(3))
    return sorted(map(tuple, df.select("doc_id", "n_lines", "n_dropped", "text").collect()), key=str)


def test_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{TINY}/documents.parquet").select("doc_id", "text").collect()]
    assert run(spark, rows) == brute(rows)


def test_odd_texts(spark):
    rng = np.random.default_rng(1)
    line = "This Line is long enough to be counted, whatever case"
    rows = [(d, "\n".join(["  " + line.upper() + "\t", "short", f"own {d} " + "z" * 50, line, ""][: int(rng.integers(1, 6))])) for d in range(12)]
    rows += [(100, None), (101, ""), (102, "\n"), (None, line), (3, line), (3, line), (200, "x" * 40 + "\r"), *[(300 + i, "é" * 40) for i in range(5)], *[(400 + i, "é" * 39) for i in range(5)]]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_columns_pass(spark):
    df = spark.createDataFrame([(1, "a", 7, "k")], SCHEMA + ", h1 int, keys string")
    row = linededup.filter_lines(df).first()
    assert (row.h1, row["keys"], row.n_lines, row.n_dropped) == (7, "k", 1, 0)


def test_own_columns_of_the_results_names_stay(spark):
    line = "a line that is long enough to be counted here"
    df = spark.createDataFrame([(i, line, "mine", -1, 5) for i in range(5)], SCHEMA + ", n_lines string, N_Dropped int, lost_keys int")
    got = linededup.filter_lines(df).orderBy("doc_id")
    assert linededup.count_names(df) == ("n_lines_", "n_dropped_")
    assert got.columns == [*df.columns, "n_lines_", "n_dropped_"]
    assert [tuple(r)[1:] for r in got.collect()] == [("", "mine", -1, 5, 1, 1)] * 4 + [(line, "mine", -1, 5, 1, 0)]


def test_long_texts_lose_very_many_lines(spark):
    """Some 20,000 lost keys and 40,000 lines a document, in seconds."""
    shared = [f"shared line number {i:06d} of a very long list of lines" for i in range(20_000)]
    rows = [(d, "\n".join(x for i, s in enumerate(shared) for x in (s, f"own {d} {i}"))) for d in range(5)]
    begin = time.time()
    got = run(spark, rows)
    assert time.time() - begin < 60
    assert [(d, n, k) for d, n, k, _ in got] == [(d, 40_000, 20_000 if d < 4 else 0) for d in range(5)]
    assert got == brute(rows)


def test_runs_are_merged_by_level(spark):
    runs = linededup.LineRuns(spark, fanout=2)
    for b in range(5):
        runs.add(spark.createDataFrame([(100 - 10 * b - i, 1, i % 2) for i in range(4)], "doc_id long, h1 long, h2 long"))
    assert sorted((k, len(v)) for k, v in runs.levels.items() if v) == [(0, 1), (2, 1)]
    got = {r.h2: (r.n_docs, r.keeper) for r in runs.merged(runs.rows()).collect()}
    assert got == {0: (10, 100), 1: (10, 99)}
